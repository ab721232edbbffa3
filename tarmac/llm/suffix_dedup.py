"""Removal of byte strings that occur again anywhere, by a sparse suffix array.

Every byte is covered that lies in a string of WINDOW bytes which also starts elsewhere, in any text. Suffixes are taken at
anchors only: winnowing picks, in every window, the places whose gram of GRAM bytes hashes lowest, so equal windows hold equal
anchors at equal places. Grams that occur once are dropped by a count. The suffixes at the others, with the bytes before them
that a window may reach, are range-partitioned by their leading bytes at sampled splitters; buckets sort them by a multikey
sort of leading bytes and gram hash that refines ties only. Within a run of equal grams, windows at each distance before the
anchor are compared by 64-bit hashes; the farthest and nearest that occur again give the covered stretch, as all of them hold
the anchor. The gram's hash is the last splitter key, so runs never part at a bucket's boundary. A run too large for a bucket
is decided by counting its windows.

Equal texts are one class: a text with a copy is covered whole, and one of the copies in a task stands for it.

Null texts read as empty. Texts shorter than WINDOW lose nothing. Rows of equal or null ids are told apart by their texts.
Further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_bytes, id_text, written

WINDOW = 200
GRAM = 104
#: Places of a gram in a window; bytes before an anchor that a window may hold.
PLACES = WINDOW - GRAM + 1
BEFORE = PLACES - 1
#: Contexts that a bucket compares at once; a larger run is decided by counts.
RUN = 16_000
KNOWN_TEXTS = 200_000


def sliding(x: np.ndarray, width: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best of x[i : i + width] for each i; pad stands beyond the end."""
    n = len(x)
    blocks = -(-(n + width) // width)
    full = np.full(blocks * width, pad, x.dtype)
    full[:n] = x
    ahead = best.accumulate(full.reshape(blocks, width), axis=1).ravel()
    back = best.accumulate(full.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of every anchor."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    up, down = K._power(n)
    sums = np.empty(n + 1, K.U)
    sums[0] = 0
    np.cumsum(K.BYTE_VALUE[data] * up[:-1], out=sums[1:])
    grams = K.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n + 1 - GRAM])
    low = (grams >> K.U(32)).astype(np.uint32) >> 1
    least = sliding(low, PLACES, np.minimum, 0x7FFFFFFF).astype(np.int32)
    # Only windows within a row count; the others are below any hash.
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(low)] - np.arange(len(low))
    least[room < WINDOW] = -1
    # A place is an anchor if its hash is the least of some window that holds it.
    most = sliding(least[::-1], PLACES, np.maximum, -1)[::-1]
    at = np.flatnonzero(most == low.astype(np.int32))
    return at, grams[at]


def firsts(batch: pa.RecordBatch, known: set) -> pa.RecordBatch:
    """The rows whose text the task hasn't met; known: the texts it has, up to KNOWN_TEXTS."""
    keep = []
    for key in zip(batch.column("u1").to_pylist(), batch.column("u2").to_pylist(), strict=True):
        keep.append(key not in known)
        if len(known) < KNOWN_TEXTS:
            known.add(key)
    return batch.filter(pa.array(keep, pa.bool_()))


def anchored(docs: DataFrame) -> DataFrame:
    """(u1, u2, gram, at) of every anchor of docs(doc_id, text, u1, u2); of equal texts in a task the first stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in by_bytes(batches):
            batch = firsts(batch, known)
            data, offsets = K.buffer(pa.concat_arrays([batch.column("text")]))
            place, gram = anchors(data, offsets)
            row = np.searchsorted(offsets, place, "right") - 1
            own = [batch.column(c).take(pa.array(row)) for c in ("u1", "u2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(gram.view(np.int64)), pa.array((place - offsets[row]).astype(np.int32))], ["u1", "u2", "gram", "at"])

    return docs.mapInArrow(run, "u1 long, u2 long, gram long, at int")


def packed(docs: DataFrame) -> DataFrame:
    """(u1, u2, packed): the compressed texts of docs(doc_id, text, u1, u2), for exchanges; of equal ones in a task the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        pack, known = zstd.ZstdCompressor(level=3).compress, set()
        for batch in by_bytes(batches):
            batch = firsts(batch, known)
            texts = [pack(x.as_buffer()) for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("u1"), batch.column("u2"), pa.array(texts, pa.binary())], ["u1", "u2", "packed"])

    return docs.mapInArrow(run, "u1 long, u2 long, packed binary")


CONTEXT = "u1 long, u2 long, at long, gram long, before int, lead long, c1 long, c2 long, context binary"


def contexts(held: DataFrame) -> DataFrame:
    """CONTEXT of each place in held(u1, u2, packed, places): the gram's leading bytes, and what lies before and after the
    gram as far as a window may reach. The gram itself is the same throughout a run, so its hash stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            for u1, u2, z, places in zip(*(batch.column(c).to_pylist() for c in ("u1", "u2", "packed", "places")), strict=True):
                text = unpack(z)
                at = np.unique(np.array([p["at"] for p in places], np.int64))
                gram = dict((p["at"], p["gram"]) for p in places)
                around = [text[max(0, p - BEFORE) : p] + text[p + GRAM : p + WINDOW] for p in at.tolist()]
                lead = np.array([int.from_bytes(text[p : p + 8], "big") for p in at.tolist()], np.uint64) ^ K.U(1 << 63)
                before = np.minimum(at, BEFORE)
                sums = [hashlib.blake2b(x + bytes([min(p, BEFORE)]), digest_size=16).digest() for x, p in zip(around, at.tolist(), strict=True)]
                c = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([u1] * n, pa.int64()), pa.array([u2] * n, pa.int64()), pa.array(at), pa.array([gram[p] for p in at.tolist()], pa.int64()), pa.array(before.astype(np.int32)), pa.array(lead.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(around, pa.binary())], [x.split()[0] for x in CONTEXT.split(", ")])

    return held.mapInArrow(run, CONTEXT)


def multikey_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of words, and the run of equal rows each ordered row is in: key by key, refining only ties."""
    order = np.argsort(words[:, 0], kind="stable")
    run = np.zeros(len(order), np.int64)
    run[1:] = np.cumsum(words[order[1:], 0] != words[order[:-1], 0])
    for k in range(1, words.shape[1]):
        tied = np.zeros(len(order), bool)
        same = run[1:] == run[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        inner = np.lexsort((words[rows, k], run[at]))
        order[at] = rows[inner]
        differs = (run[1:] != run[:-1]) | (tied[1:] & tied[:-1] & (words[order[1:], k] != words[order[:-1], k]))
        run = np.concatenate([[0], np.cumsum(differs)])
    return order, run


def laid_out(context: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows with the anchor at BEFORE and zeros for the gram, and each row's number of bytes from the anchor on."""
    size = np.fromiter(map(len, context), np.int64, len(context))
    out = np.zeros((len(context), BEFORE + WINDOW), np.uint8)
    flat = np.frombuffer(b"".join(context), np.uint8)
    row = np.repeat(np.arange(len(context)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(BEFORE - before, size)
    out[row, column + GRAM * (column >= BEFORE)] = flat
    return out, size - before + GRAM


def window_keys(laid: np.ndarray) -> np.ndarray:
    """Prefix sums of each row; the difference of two columns WINDOW apart is a window's hash, comparable within a column."""
    up, _ = K._power(laid.shape[1])
    sums = np.zeros((len(laid), laid.shape[1] + 1), K.U)
    np.cumsum(K.BYTE_VALUE[laid] * up[:-1], axis=1, out=sums[:, 1:])
    return sums


def resolve(context: list[bytes], before: np.ndarray, count: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts with their numbers of occurrences and their grams' words (leading bytes, hash): the least and most bytes before the anchor of a window that
    occurs again; -1 without one."""
    import pandas as pd

    laid, after = laid_out(context, before)
    order, run_of = multikey_runs(words)
    run = np.empty(len(order), np.int64)
    run[order] = run_of
    sums = window_keys(laid)
    low = np.full(len(context), 1 << 20)
    high = np.full(len(context), -1)
    for k in range(PLACES):
        ok = np.flatnonzero((before >= k) & (after >= WINDOW - k))
        key = K.mix(sums[ok, BEFORE - k + WINDOW] - sums[ok, BEFORE - k]) ^ K.mix(run[ok].astype(K.U) + K.U(1))
        codes, _ = pd.factorize(key)
        seen = np.bincount(codes, count[ok])
        again = ok[seen[codes] >= 2]
        low[again] = np.minimum(low[again], k)
        high[again] = k
    low[high < 0] = -1
    return low, high


def in_buckets(distinct: DataFrame) -> DataFrame:
    """(gram, c1, c2, low, high) of the distinct contexts, sorted in each bucket, runs of equal grams together."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        gram, c1, c2, before, count, context, lead = zip(*rows, strict=True)
        low, high = resolve(list(context), np.array(before, np.int64), np.array(count, np.int64), np.column_stack([lead, gram]))
        some = high >= 0
        columns = [np.array(x, np.int64)[some] for x in (gram, c1, c2, low, high)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "c1", "c2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "c1", "c2", "before", "n", "context", "lead")), strict=True):
                if len(rows) >= RUN and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    spread = distinct.repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram")
    return spread.mapInArrow(run, "gram long, c1 long, c2 long, low long, high long")


def by_counts(distinct: DataFrame) -> DataFrame:
    """As in_buckets, for runs of any size: every window is counted by its hash, with partial counts before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                before = batch.column("before").to_numpy().astype(np.int64)
                laid, after = laid_out(batch.column("context").to_pylist(), before)
                sums = window_keys(laid)
                for k in range(PLACES):
                    ok = np.flatnonzero((before >= k) & (after >= WINDOW - k))
                    key = K.mix(sums[ok, BEFORE - k + WINDOW] - sums[ok, BEFORE - k])
                    own = [batch.column(c).take(pa.array(ok)) for c in ("gram", "c1", "c2", "n")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(ok), k)), pa.array(key.view(np.int64))], ["gram", "c1", "c2", "n", "k", "window"])

    windows = distinct.mapInArrow(run, "gram long, c1 long, c2 long, n long, k long, window long")
    again = written(windows.groupBy("gram", "k", "window").agg(F.sum("n").alias("n")).where("n >= 2").select("gram", "k", "window"), "windows")
    return windows.join(again, ["gram", "k", "window"]).groupBy("gram", "c1", "c2").agg(F.min("k").alias("low"), F.max("k").alias("high"))


def trimmed(held: DataFrame) -> DataFrame:
    """(u1, u2, n_removed, n_spans, kept) for held(u1, u2, packed, spans); kept: the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            for u1, u2, z, spans in zip(*(batch.column(c).to_pylist() for c in ("u1", "u2", "packed", "spans")), strict=True):
                data = np.frombuffer(unpack(z), np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, np.array([s["s"] for s in spans]), 1)
                np.add.at(depth, np.array([s["e"] for s in spans]), -1)
                gone = np.cumsum(depth[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((u1, pa.int64()), (u2, pa.int64()), (int(gone.sum()), pa.int64()), (runs, pa.int64()), (data[~gone].tobytes(), pa.binary()))], ["u1", "u2", "n_removed", "n_spans", "kept"])

    return held.mapInArrow(run, "u1 long, u2 long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay, for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    base = id_text(docs, id_col, text_col).select("doc_id", text.alias("text"))
    base = base.withColumns({"u1": F.xxhash64("text"), "u2": F.xxhash64(F.lit(1), "text")})
    key = ["u1", "u2"]
    narrow = written(base.select("doc_id", *key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    twins = written(narrow.where(f"n_bytes >= {WINDOW}").groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2").select(*key, F.lit(True).alias("twin")), "twins")

    places = anchored(base.where(F.octet_length("text") >= WINDOW))
    again = written(places.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2").select("gram"), "grams")
    wanted = places.join(again, "gram").groupBy(*key).agg(F.collect_set(F.struct("at", "gram")).alias("places"))
    wanted = written(wanted, "places")
    held = written(packed(base.where(F.octet_length("text") >= WINDOW)).join(wanted, key).select(*key, "packed", "places"), "candidates")
    found = written(contexts(held), "contexts")
    around = ["gram", "c1", "c2"]
    distinct = found.groupBy(*around).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("before", "lead", "context")))
    distinct = written(distinct, "distinct-contexts")
    large = written(distinct.groupBy("gram").agg(F.count("*").alias("m")).where(f"m > {RUN}").select("gram"), "large-grams")
    if large.isEmpty():
        resolved = in_buckets(distinct)
    else:
        resolved = in_buckets(distinct.join(large, "gram", "left_anti")).union(by_counts(written(distinct.join(large, "gram", "left_semi").drop("lead"), "large-runs")).select("gram", "c1", "c2", "low", "high"))
    resolved = written(resolved, "resolved")
    spans = found.select(*key, "at", *around).join(resolved, around).select(*key, F.struct((F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low") + WINDOW).alias("e")).alias("span"))
    spans = written(spans.groupBy(*key).agg(F.collect_list("span").alias("spans")), "spans")
    cut = held.join(spans, key).join(twins, key, "left_anti").select(*key, "packed", "spans")
    cut = trimmed(cut).select(*key, "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    cut = written(cut.dropDuplicates(key), "trimmed")
    out = narrow.join(twins, key, "left").join(cut, key, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes", F.when(F.col("twin"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("twin"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(F.col("twin"), F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
