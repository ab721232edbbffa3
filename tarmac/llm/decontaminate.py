"""Benchmark decontamination: n-gram seeds, then local alignment.

Words are lower-cased runs of letters and digits. Each benchmark item is sought by all its n-grams, common ones too: which
of them an edited or partial copy keeps is not known beforehand, and those of a copy found often are common by it. Where one
occurs in a text, Smith-Waterman alignment scores the item against the words around it, so that edited and paraphrased
copies count too. The score is the alignment's share of a whole copy's. What common n-grams hit by chance is mostly passed
over unaligned, by a bound that no alignment exceeds: words of the item count as matches, others as misses, wherever they are.

The benchmark is taken in blocks of a fixed size, which bounds what is sent to executors at any size of the benchmark; every
block is held against all documents. Null and empty texts, and items of fewer words than a seed has, match nothing. Equal
items match alike, repeated rows of documents each give their own rows, further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_bytes, id_text, written

#: Words of a seed.
SEED_WORDS = 4
#: Alignment: a match, a mismatch or gap; the item words that make a whole copy, and the score that counts as one.
MATCH, MISS = 2, -1
WHOLE_WORDS = 32
LEAST_SCORE = 0.5
#: Words of an item that are aligned at once.
PIECE_WORDS = 512
#: Hits of seeds that are looked at at once, and words around them; a row's hits, and a window, stay together.
STEP_HITS, STEP_WORDS = 1 << 19, 1 << 21
#: Text bytes of the benchmark that are sent to executors at once.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, score double, n_matched long, first_byte long, last_byte long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, each row's first word, and the words' starts and ends in the lower-cased row."""
    data, offsets = K.buffer(pc.utf8_lower(texts))
    starts, ends, first = K.words(data, offsets, K.NOT_ALPHANUMERIC)
    shift = np.repeat(offsets[:-1], np.diff(first))
    return K.range_hashes(data, starts, ends), first, starts - shift, ends - shift


def seed_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each n-gram, and the word where it starts; none cross rows."""
    n = SEED_WORDS
    if len(hashes) < n:
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    at = np.flatnonzero(room >= n)
    total = np.zeros(len(at), K.U)
    for j in range(n):
        total += K.mix(hashes[at + j] + K.U(j + 1)) * K.U(2 * j + 3)
    return K.mix(total), at


class Items:
    """A block of benchmark items with their seeds in order."""

    def __init__(self, ids: list, texts: list[str]):
        self.words, first, _, _ = tokens(pa.array(texts, pa.large_string()))
        # Long items are sought in pieces, which bounds an alignment's memory.
        cuts = [range(s, e, PIECE_WORDS) or (s,) for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.ids = [i for i, c in zip(ids, cuts, strict=True) for _ in c]
        self.first = np.array([x for c in cuts for x in c] + [len(self.words)], np.int64)
        seeds, at = seed_hashes(self.words, self.first)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        # The words of each item, as one sorted list of (item, word) hashes.
        self.held = np.unique(self.own(K.rows_of(self.first), self.words))

    @staticmethod
    def own(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return K.mix(words + K.mix(item.astype(K.U) + K.U(1)))

    def bounds(self, item: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each window words[begin:end], none empty, a score that its alignment with the item cannot exceed."""
        out = np.empty(len(item), np.int64)
        held = np.append(self.held, K.U(0))
        n = end - begin
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // STEP_WORDS, prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)], strict=True):
            key = self.own(np.repeat(item[s:e], n[s:e]), K.gather(words, begin[s:e], n[s:e]))
            gain = np.where(held[np.searchsorted(self.held, key)] == key, MATCH, MISS)
            # The best sum of a run: later windows lie lower than earlier ones, so that each has minima of its own.
            total = np.cumsum(gain)
            drop = np.repeat(np.arange(e - s) * (2 * MATCH * (len(gain) + 1)), n[s:e])
            best = total - drop - np.minimum.accumulate(total - gain - drop)
            out[s:e] = np.maximum.reduceat(best, np.cumsum(n[s:e]) - n[s:e])
        return out

    def hits(self, seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the texts, seed of the items) of each equal pair."""
        lo, hi = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, "right")
        n = hi - lo
        return np.repeat(at, n), K.gather(np.arange(len(self.seeds)), lo, n)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: the best score, its matches, and the first and last text word of that alignment.

    A whole row at a time: gaps along the row are a running maximum of scores that fall by one a step.
    """
    n = len(text)
    steps = np.arange(n + 1, dtype=np.int64) * -MISS
    rows = np.zeros((len(item) + 1, n + 1), np.int64)
    for i, word in enumerate(item):
        up = rows[i]
        now = rows[i + 1]
        np.maximum(up[:-1] + np.where(text == word, MATCH, MISS), up[1:] + MISS, out=now[1:])
        np.maximum(now, 0, out=now)
        np.subtract(np.maximum.accumulate(now + steps), steps, out=now)
    i, j = divmod(int(rows.argmax()), n + 1)
    best, last, matched = int(rows[i, j]), j - 1, 0
    while i and j and rows[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if same else MISS):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + MISS:
            i -= 1
        else:
            j -= 1
    return best, matched, j, last


def aligned(best: dict, at: np.ndarray, seed: np.ndarray, words: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: Items) -> None:
    """Puts the best alignment of each row and item of these hits into best, from LEAST_SCORE on."""
    row, item = np.searchsorted(first, at, "right") - 1, items.item[seed]
    # Hits on one diagonal, give or take, are one place; windows around it are aligned once.
    shift = at - (items.at[seed] - items.first[item])
    order = np.lexsort((shift, item, row))
    row, item, shift = row[order], item[order], shift[order]
    size = np.diff(items.first)[item]
    slack = size // 2 + 2
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > slack[1:])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(row)) - 1
    row, item, size, slack = row[heads], item[heads], size[heads], slack[heads]
    begin = np.maximum(first[row], shift[heads] - slack)
    end = np.minimum(first[row + 1], shift[tails] + size + slack)
    whole = MATCH * np.minimum(size, WHOLE_WORDS)
    may = np.flatnonzero(items.bounds(item, words, begin, end) >= LEAST_SCORE * whole)
    for r, k, a, b, full in zip(*(x[may].tolist() for x in (row, item, begin, end, whole)), strict=True):
        own = items.words[items.first[k] : items.first[k + 1]]
        if (r, k) in best and best[r, k][0] >= MATCH * len(own):
            continue
        # Many hits near each other make a long window, which is aligned in overlapping parts.
        for c in range(a, max(a + 1, b - 2 * len(own)), 2 * len(own)):
            score, matched, x, y = align(own, words[c : min(b, c + 4 * len(own) + 4)])
            if score >= LEAST_SCORE * full and score > best.get((r, k), (0,))[0]:
                best[r, k] = (score, min(1.0, score / full), matched, int(starts[c + x]), int(ends[c + y]))


def found(texts: pa.Array, items: Items) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, score, matches, first byte, last byte) of each row and item, by the best alignment, from LEAST_SCORE on."""
    words, first, starts, ends = tokens(texts)
    seeds, at = seed_hashes(words, first)
    n = np.searchsorted(items.seeds, seeds, "right") - np.searchsorted(items.seeds, seeds)
    seeds, at, n = seeds[n > 0], at[n > 0], n[n > 0]
    if not len(at):
        return []
    best: dict[tuple[int, int], tuple] = {}
    row = np.searchsorted(first, at, "right") - 1
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    step = np.add.reduceat(n, heads).cumsum() // STEP_HITS
    heads = heads[np.flatnonzero(np.diff(step, prepend=-1))]
    for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
        aligned(best, *items.hits(seeds[s:e], at[s:e]), words, first, starts, ends, items)
    # Of an item's pieces the best one speaks for it.
    top: dict[tuple, tuple] = {}
    for (r, k), v in sorted(best.items()):
        if v[0] > top.get((r, items.ids[k]), (0,))[0]:
            top[r, items.ids[k]] = (v[0], r, k, *v[1:])
    return [v[1:] for v in top.values()]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"].encode())
        if held >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if texts:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score (LEAST_SCORE to 1), n_matched words, and the bytes of the lower-cased text that the alignment spans."""
    own, out = id_text(docs, id_col, text_col), None
    for items in blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches):
                got = found(batch.column("text"), sent.value)
                columns = list(zip(*got, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(columns[0], pa.int64())), pa.array([sent.value.ids[k] for k in columns[1]], pa.int64()), pa.array(columns[2], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[3:])], SCHEMA_NAMES)

        part = own.mapInArrow(run, SCHEMA)
        out = part if out is None else written(out, "contaminated").union(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no benchmark item."""
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(with_row(batches, at), "__text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in found(batch.column("__text"), sent.value)]] = False
                yield batch.drop_columns(["__text"]).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def with_row(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("__text", batch.column(at))
