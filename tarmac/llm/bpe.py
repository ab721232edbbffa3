"""Byte-level BPE encoding and decoding over a trie of distinct words.

Words (pre-tokens) of a batch are found by vector operations on character classes; each distinct word is encoded once. The
distinct words, in order, are the depth-first walk of their trie: what a word shares with the one before it is the path to
their common node. Each node holds one state, the last token of its prefix's encoding: the token that ends there and forms
a right pair with the last token of the prefix before it. There is exactly one, since a token sequence is the encoding
exactly if each two neighbours encode to themselves. So the states of shared prefixes are computed once, and following
the last tokens back from a word's node gives its encoding. Words stay known within a task, up to a fixed number.

Null and empty texts encode to no ids. Repeated rows, ties and further columns need no care: each row is encoded by itself. A
long text is one step of a task, at a few dozen bytes of memory a character. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import by_bytes, give_back, id_text

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct words that a task remembers; beyond, it starts anew, which changes no result.
KNOWN_WORDS = 500_000
_codecs: dict = {}
_classes: dict = {}
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The endings that the vocabulary's word pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_class() -> np.ndarray:
    """The class of each code point as the tokenizers library's patterns see it, whose Unicode tables are its own. Planes from
    the fourth on hold neither letters, numbers nor white space."""
    if "all" not in _classes:
        from tokenizers import Regex, pre_tokenizers

        points = np.array([*range(0xD800), *range(0xE000, 0x40000)])
        every = "".join(map(chr, points.tolist()))
        table = np.full(0x110000, OTHER, np.uint8)
        for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
            found = np.ones(len(points), bool)
            for _, (begin, end) in pre_tokenizers.Split(Regex(name + "+"), "removed").pre_tokenize_str(every):
                found[begin:end] = False
            table[points[found]] = kind
        _classes["all"] = table
    return _classes["all"]


def word_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word of the pattern starts, in code points; offsets: where rows start, and the end.

    Words are runs of letters, numbers or other characters, each with one space before it if there is one, and the white
    space left between them, whose last character stands alone if a word follows without taking it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_class()[points]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    change = row_start.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    change[n] = True
    start = change[:n].copy()
    # The last of a run of white space, where a word follows in the row.
    last = (kind == SPACE) & change[1:] & ~row_start[1:]
    start |= last
    blank = last & (points == 0x20)
    start[1:] &= ~blank[:-1]
    # Apostrophes that begin a run: their endings are words of their own.
    for at in np.flatnonzero((points == 0x27) & change[:n]):
        if at and blank[at - 1] and not row_start[at]:
            continue
        limit = offsets[np.searchsorted(offsets, at, "right")]
        after = "".join(map(chr, points[at + 1 : min(limit, at + 3)]))
        for x in CONTRACTIONS:
            if after.startswith(x):
                start[at + 1] = False
                if at + 1 + len(x) < limit and not (kind[at + 1 + len(x)] == SPACE):
                    start[at + 1 + len(x)] = True
                break
    return np.flatnonzero(start)


class Codec:
    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        at = byte_characters()
        raw = lambda token: bytes(at[c] for c in token)
        vocabulary = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_of = vocabulary
        self.bytes_of = {i: b for b, i in vocabulary.items()} | {i: x.encode() for x, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.order = dict.fromkeys(vocabulary.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (vocabulary[raw(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[left, right] = rank
            token = vocabulary[self.bytes_of[left] + self.bytes_of[right]]
            if token in self.halves:
                raise ValueError("a token of this vocabulary is made by two merges")
            self.order[token], self.halves[token] = rank, (left, right)
        #: The longest token that ends with these one or two bytes.
        self.longest: dict[bytes, int] = {}
        for b in vocabulary:
            for end in (b[-1:], b[-2:]):
                self.longest[end] = max(self.longest.get(end, 0), len(b))
        self.fits: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.known: dict[bytes, tuple[int, ...]] = {}
        size = max(self.bytes_of) + 1
        parts = [self.bytes_of.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether the text of these two tokens encodes to them.

        Goes back in time: the token made last is undone, which leaves its inner half at the border. If the two halves at
        the border could have merged before the next undone merge, the encoding would have gone over the border.
        """
        first, second = left, right
        rank, order, halves, limit = self.rank, self.order, self.halves, 1 << 60
        fits = True
        while True:
            if rank.get((left, right), limit) < limit:
                fits = False
                break
            if order[left] < 0 and order[right] < 0:
                break
            if order[left] > order[right]:
                limit = order[left]
                left = halves[left][1]
            else:
                limit = order[right] + 1  # of equal merges the left one goes first
                right = halves[right][0]
        self.fits[first][second] = fits
        return fits

    def walk(self, words: list[bytes]) -> None:
        """Makes the words known. They come in order, which is a depth-first walk of their trie."""
        id_of, longest, fits, pair_fits, known = self.id_of.get, self.longest.get, self.fits, self.pair_fits, self.known
        # Of each node on the path: the last token, its length, and what is known of the tokens that may follow it.
        last, size, after = [-1], [0], [{}]
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], after[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                k = longest(word[end - 2 : end] if end > 1 else word[:1], 1)
                if k >= end:
                    k = end
                    if (token := id_of(word[:end])) is not None:
                        last.append(token)
                        size.append(end)
                        after.append(fits[token])
                        continue
                    k -= 1
                while True:
                    if (token := id_of(word[end - k : end])) is not None:
                        ok = after[end - k].get(token)
                        if ok or ok is None and pair_fits(last[end - k], token):
                            break
                    k -= 1
                last.append(token)
                size.append(k)
                after.append(fits[token])
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            known[word] = tuple(ids)
            before = word

    def forget(self) -> None:
        """Gives back what a task has learnt: its worker goes on to other work."""
        self.known.clear()
        self.fits.clear()
        give_back()

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        fresh = sorted({w for w in words if w not in self.known})
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known.clear()
            self.fits.clear()
            fresh = sorted(set(words))
        self.walk(fresh)
        return [self.known[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            rest = [text]
            for content in self.added:
                if content in text:
                    rest = [y for x in rest for y in ([x] if x in self.added else _split(x, content))]
            for x in rest:
                parts.append("" if x in self.added else x)
                special.append(self.added.get(x, -1))
                owner.append(i)
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        starts = word_starts(points, offsets)
        ends = np.append(starts[1:], len(points))
        codes, item = K.factorize(K.value_hashes(points * K.U(0xD6E8FEB86659FD93) + K.U(1), starts, ends), ends - starts)
        words = [whole[s:e].encode() for s, e in zip(starts[item].tolist(), ends[item].tolist(), strict=True)]
        found = self.encode_words(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        own = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        ids = K.gather(own, (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        at = np.concatenate([[0], np.cumsum(sizes[codes])])[np.searchsorted(starts, offsets)]
        if max(special, default=-1) >= 0:
            pieces = [np.array([special[j]], np.uint32) if special[j] >= 0 else ids[at[j] : at[j + 1]] for j in range(len(parts))]
            ids = np.concatenate(pieces)
            at = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        first = np.searchsorted(np.array(owner + [len(texts)]), np.arange(len(texts) + 1)) if parts else np.zeros(1, np.int64)
        return ids, at[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these ids, special ones included."""
        return K.gather(self.flat, self.start[ids], self.size[ids])


def _split(text: str, content: str) -> list[str]:
    out = []
    for i, x in enumerate(text.split(content)):
        out += [content] * bool(i) + [x]
    return out


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def digests(batch: pa.RecordBatch, path: str, keep_ids: bool = False) -> pa.RecordBatch:
    c, texts = codec(path), batch.column("text").to_pylist()
    ids, at = c.encode(texts)
    data = c.decode(ids)
    ends = np.concatenate([[0], np.cumsum(c.size[ids])])[at]
    little = ids.astype("<u4", copy=False)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    decoded = [data[s:e].tobytes().decode("utf-8", "replace").encode() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array([sha(little[s:e].tobytes()) for s, e in spans]), pa.array(list(map(sha, decoded)))]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep_ids:
        columns, names = [*columns, K.list_column(ids.astype(np.int32), at)], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the text decoded from them, and with keep_ids the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield digests(batch, path, keep_ids)
        codec(path).forget()

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA + ", ids array<int>" * keep_ids)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            ids, at = codec(path).encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), K.list_column(ids.astype(np.int32), at)], ["doc_id", "ids"])
        codec(path).forget()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each list of ids; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
