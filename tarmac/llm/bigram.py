"""Language-model scores by a hierarchical Pitman-Yor model with a restaurant for each preceding word.

The context of a token is the word before it in its text (BEGIN for the first). Each word that precedes a training token is a
restaurant, none is left out or merged; all share one parent, the restaurant without context, whose base is uniform over the
known words and one unknown. A pair's customers are its training tokens; its tables are customers of the parent.

Seating is sampled by Gibbs: a pair's tables are drawn, without those it had, from their conditional given the totals of its
restaurant and the parent's seating after the sweep before (lm.seat: exact up to EXACT customers, beyond by the predictive
rule in growing blocks); then the parent's. Restaurants are drawn side by side, so totals are those of the last sweep.
Probabilities are averaged over the sweeps after the burn-in. Draws are hashes of the pair and the sweep, so a lost task draws
the same again.

Documents are read once, in blocks of about BLOCK tokens. A block files its distinct pairs under the bucket of the preceding
word, buckets being ranges of the word's hash, as many as the input has BUCKET_BYTES. A bucket holds whole
restaurants, but those of the most frequent words (of a sample, which decides nothing else) and BEGIN are spread over all
buckets by the word that follows, and the driver adds up their totals. The parent's dishes are in fewer, wider buckets. Each sweep sends, for each distinct word that follows in a bucket, its tables
there to the parent and the parent's seating back. At the end each bucket answers every block with the probability of each of its pairs, and blocks sum
them by document. All of it travels as packed arrays, a row for each block and bucket or pair of buckets; no table of all
words or pairs is ever in one place.

Null and empty texts have one token, the end. Rows of a null id teach nothing. Without training documents every token has
probability 1. Repeated rows and further columns change nothing. A longer text than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_bytes, dropped, give_back, id_text, written
from .lm import BURN_IN, END, SAMPLES, SCHEMA, STRENGTH, seat, stirling, tokens

BEGIN = K.mix(np.array([0xBE61], K.U))[0]
#: Tokens of a block, text bytes for each bucket, and buckets for each of the parent's.
BLOCK = 2_000_000
BUCKET_BYTES = 16 << 20
BUCKETS_TO_PARENT = 8
#: Restaurants that are spread are those of words that make one in so many of a sample of so many text bytes, so many at most.
SPREAD_SHARE, SPREAD_BYTES, SPREAD = 4000, 16 << 20, 64

#: Rows between steps: to whom (a bucket, or a block, which is below 0), what, from whom, after which sweep, its arrays, and sums
#: that the driver adds up.
ROWS = "bucket long, kind int, peer long, sweep int, payload binary, sums array<double>"
PAIRS, STREAM, STATE, ASKED, WORDS, SEATED, TABLES, PARENT, ANSWER = range(9)
_TYPES = ["u1", "u2", "u4", "u8", "f4"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, none negative, as compressed planes of bytes."""
    import zstandard as zstd

    parts = []
    for a in arrays:
        if a.dtype.kind != "f":
            most = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in _TYPES[:4] if most < 1 << 8 * np.dtype(t).itemsize))
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        parts += [np.array([len(a), _TYPES.index(a.dtype.str[1:])], np.int64).tobytes(), planes.tobytes()]
    return zstd.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(payload: pa.Buffer) -> list[np.ndarray]:
    """What pack() got; whole numbers as int64, those of eight bytes unsigned."""
    import zstandard as zstd

    data, at, out = zstd.ZstdDecompressor().decompress(payload), 0, []
    while at < len(data):
        n, kind = np.frombuffer(data, np.int64, 2, at)
        dtype = np.dtype(_TYPES[kind])
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at + 16).reshape(dtype.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
        out.append(a if dtype.str[1:] in ("u8", "f4") else a.astype(np.int64))
        at += 16 + n * dtype.itemsize
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def summed(found: np.ndarray, dtype: type) -> np.ndarray:
    return np.cumsum(found.astype(dtype), dtype=dtype)


def distinct(x: np.ndarray) -> np.ndarray:
    """In order; np.unique is many times slower on large arrays, as it hashes."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin, of ascending ones."""
    own = ((hashes >> K.U(32)) * K.U(buckets)) >> K.U(32)
    return np.searchsorted(own, np.arange(buckets + 1, dtype=K.U))


def rows(found: list[tuple]) -> dict[str, pa.Array]:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
    cols = list(zip(*found, strict=True)) or [()] * len(kinds)
    return {name.split()[0]: pa.array(c, t) for name, c, t in zip(ROWS.split(", "), cols, kinds, strict=True)}


def coded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct words of a block and BEGIN in order, each token's place there, and BEGIN's."""
    code, found = pd.factorize(np.append(words, BEGIN))
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[code]
    return found[order], code[:-1], int(code[-1])


def pair_codes(code: np.ndarray, first: np.ndarray, begin: int, size: int) -> np.ndarray:
    """Each token's pair, as place of the word before it times size plus its own."""
    before = np.empty(len(code), np.int64)
    before[1:] = code[:-1]
    before[first[:-1]] = begin
    return before * size + code


def spread_words(docs: DataFrame, size: int) -> np.ndarray:
    """The words whose restaurants are spread over the buckets; size: text bytes of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words, _ = tokens(batch.column("text"))
            found, n = np.unique(words[words != END], return_counts=True)
            some = n * SPREAD_SHARE >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some])], ["w", "n"])

    sample = docs.select("text").sample(min(1.0, SPREAD_BYTES / max(size, 1)), 5)
    found = sample.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(SPREAD).collect()
    return np.sort(np.append(np.array([r["w"] for r in found], np.int64).view(K.U), BEGIN))


def dealt(pairs: np.ndarray, size: int, at: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's pairs by bucket, those of spread restaurants last in each, and where each bucket's begin. at: where its words
    begin; spread: places of words."""
    buckets = len(at) - 1
    own = np.repeat(np.arange(buckets), np.diff(at))
    before, after = np.divmod(pairs, size)
    late = np.zeros(size, bool)
    late[spread] = True
    late = late[before]
    key = (own[np.where(late, after, before)] * 2 + late).astype(np.uint16 if buckets < 1 << 15 else np.int64)
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key[order], np.arange(buckets + 1) * 2)


def block_rows(block: int, ids: pa.Array, learn: np.ndarray, words: np.ndarray, first: np.ndarray, buckets: int, spread: np.ndarray) -> Iterator[tuple]:
    """A block's own tokens, and for each bucket its pairs."""
    word, code, begin = coded(words)
    size = len(word)
    valid = np.asarray(ids.is_valid())
    at = bounds(word, buckets)
    some = np.flatnonzero(np.isin(spread, word))
    late = np.searchsorted(word, spread[some])
    yield block, STREAM, 0, 0, pack(np.asarray(ids.fill_null(0)).view(K.U), valid, learn, np.diff(first), np.array([size, begin]), at, late, code), []
    taught = np.repeat(learn, np.diff(first))
    unigram = np.bincount(code[taught], minlength=size)
    pairs = np.sort(pair_codes(code, first, begin, size) * 2 + taught)
    taught = pairs & 1
    pairs >>= 1
    fresh = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs, count = pairs[fresh], np.add.reduceat(taught, fresh)
    order, cut = dealt(pairs, size, at, late)
    pairs, count = pairs[order], count[order]
    rank = np.zeros(size, np.int64)
    rank[late] = some + 1
    for b in np.flatnonzero(np.diff(at)):
        mine = slice(cut[b], cut[b + 1])
        before, after = np.divmod(pairs[mine], size)
        before = np.where(rank[before] > 0, at[b + 1] - at[b] + rank[before] - 1, before - at[b])
        follow, after = np.unique(after, return_inverse=True)
        yield int(b), PAIRS, block, 0, pack(steps(word[at[b] : at[b + 1]]), unigram[at[b] : at[b + 1]], steps(word[follow]), steps(before * len(follow) + after), count[mine]), []


def counted(docs: DataFrame, buckets: int, spread: np.ndarray) -> DataFrame:
    """STREAM and PAIRS of the blocks of docs(doc_id, text, learn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = -1 - (TaskContext.get().partitionId() << 32), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, counts, learn = (np.concatenate([x[k] for x in held]) for k in range(3))
            ids = pa.concat_arrays([x[3] for x in held])
            held.clear()
            for row in block_rows(block, ids, learn, words, np.append(0, np.cumsum(counts)), buckets, spread):
                yield pa.RecordBatch.from_pydict(rows([row]))

        for batch in by_bytes(batches):
            words, first = tokens(batch.column("text"))
            learn = np.asarray(batch.column("learn").to_numpy(zero_copy_only=False), bool)
            if held and size + len(words) > BLOCK:
                yield from flush()
                block, size = block - 1, 0
            held.append((words, np.diff(first), learn, batch.column("doc_id").cast(pa.int64())))
            size += len(words)
        if held:
            yield from flush()
        give_back()

    return docs.mapInArrow(run, ROWS)


def by_bucket(found: DataFrame, name: str, step: Callable[[int, dict], Iterator[tuple]]) -> DataFrame:
    """The rows that step(bucket, {(kind, sweep): {peer: arrays' buffer}}) makes of each bucket's rows, written."""

    def run(group: pa.Table) -> pa.Table:
        got: dict[tuple, dict] = {}
        for kind, peer, sweep, payload in zip(*(group.column(c).to_pylist() for c in ("kind", "peer", "sweep")), group.column("payload"), strict=True):
            got.setdefault((kind, sweep), {})[peer] = payload.as_buffer()
        out = pa.table(rows(list(step(group.column("bucket")[0].as_py(), got))))
        del got, group
        give_back()
        return out

    return written(found.groupBy("bucket").applyInArrow(run, ROWS), name, "kind")


def total(found: DataFrame, kind: int) -> np.ndarray:
    """The sums of its rows, a row for each bucket."""
    got = found.where((F.col("kind") == kind) & (F.size("sums") > 0)).select("sums").collect()
    return np.sum([r["sums"] for r in got], axis=0) if got else np.zeros(4)


def read_pairs(payload: pa.Buffer) -> tuple[np.ndarray, ...]:
    """(words of the bucket, their training tokens, words that follow, pairs, their training tokens). A pair is the place of the
    preceding word, spread ones coming after those of the bucket, times the number of words that follow, plus the other's."""
    own, unigram, follow, pairs, count = unpack(payload)
    return summed(own, K.U), unigram, summed(follow, K.U), summed(pairs, np.int64), count


def merged(parents: int, spread: np.ndarray) -> Callable:
    """All blocks' pairs of a bucket: STATE, of each block the pairs and words ASKED for, and to each of the parent's buckets the
    WORDS of its range that follow here, with their number of contexts. A block's own STREAM goes on as it is."""

    def step(bucket: int, got: dict) -> Iterator[tuple]:
        if bucket < 0:
            yield bucket, STREAM, 0, 0, got[STREAM, 0][0].to_pybytes(), []
            return
        found = {block: read_pairs(x) for block, x in got.pop((PAIRS, 0)).items()}
        own, follow = (distinct(np.concatenate([x[k] for x in found.values()])) for k in (0, 2))
        unigram = np.zeros(len(own), np.int64)
        words, places, counts = {}, {}, {}
        for block in list(found):
            x = found.pop(block)
            words[block] = np.searchsorted(own, x[0])
            unigram[words[block]] += x[1]
            a, b = np.divmod(x[3], max(len(x[2]), 1))
            places[block] = np.append(words[block], len(own) + np.arange(len(spread)))[a] * len(follow) + np.searchsorted(follow, x[2])[b]
            counts[block] = x[4]
        # Pairs of held-out texts alone are asked for, but have no customers.
        pairs = distinct(np.concatenate(list(places.values())))
        count = np.zeros(len(pairs), np.int64)
        for block, p in places.items():
            at = np.searchsorted(pairs, p)
            count[at] += counts[block]
            yield bucket, ASKED, block, 0, pack(steps(words[block]), steps(at)), []
        late = [np.bincount(pairs // max(len(follow), 1), x, len(own) + len(spread))[len(own) :] for x in (count, count > 0)]
        yield bucket, STATE, 0, 0, pack(steps(own), unigram, steps(follow), steps(pairs), count), [float(x) for x in (unigram.sum(), (unigram > 0).sum(), (count == 1).sum(), (count == 2).sum(), *late[0], *late[1])]
        seated = np.bincount(pairs[count > 0] % max(len(follow), 1), minlength=len(follow))
        at = bounds(follow, parents)
        for b in np.flatnonzero(np.diff(at)):
            yield int(b), WORDS, bucket, 0, pack(steps(follow[at[b] : at[b + 1]])), []
            yield int(b), SEATED, bucket, 0, pack(seated[at[b] : at[b + 1]]), []

    return step


def parent_step(sweep: int, rate: float, discount: float) -> Callable:
    """The parent's seating of the words of one of its buckets, back to each bucket: PARENT (customers, tables). Before any sweep one table each."""

    def step(bucket: int, got: dict) -> Iterator[tuple]:
        hashes = {peer: summed(unpack(x)[0], K.U) for peer, x in got[WORDS, 0].items()}
        word = distinct(np.concatenate(list(hashes.values())))
        place = {peer: np.searchsorted(word, x) for peer, x in hashes.items()}
        customers = np.zeros(len(word), np.int64)
        for peer, x in got[SEATED, sweep].items():
            customers[place[peer]] += unpack(x)[0]
        if sweep:
            tables = seat(customers, np.full(len(word), rate), discount, stirling(discount), word, np.zeros(len(word), K.U), sweep).astype(np.int64)
        else:
            tables = np.minimum(customers, 1)
        sums = [float(x) for x in (customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())]
        for peer, x in place.items():
            yield peer, PARENT, bucket, sweep, pack(customers[x], tables[x]), sums
            sums = []

    return step


class Restaurants:
    """A bucket's restaurants as merged() made them, and its part of the spread ones."""

    def __init__(self, payload: pa.Buffer, spread: np.ndarray):
        own, self.unigram, self.follow, self.pairs, self.count = read_pairs(payload)
        self.before, self.after = np.divmod(self.pairs, max(len(self.follow), 1))
        self.home, self.own = len(own), np.append(own, spread)

    def totals(self, of_pairs: np.ndarray, spread: np.ndarray | None = None) -> np.ndarray:
        """Of each restaurant; spread: those of the spread ones in all buckets, else of their part here."""
        out = np.bincount(self.before, of_pairs, len(self.own))
        if spread is not None:
            out[self.home :] = spread
        return out


def parent_of(got: dict, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """The parent's (customers, tables) of the words that follow in a bucket, as all buckets sent them."""
    found = [unpack(x) for _, x in sorted(got.get((PARENT, sweep), {}).items())]
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def chance(customers: np.ndarray, tables: np.ndarray, sums: np.ndarray, discount: float, known: float) -> np.ndarray:
    """The parent's probability of words; sums: all its customers and tables."""
    return (customers - discount * tables + (STRENGTH + discount * sums[1]) / (known + 1)) / (STRENGTH + sums[0])


def seat_step(sweep: int, parents: int, sums: np.ndarray, discount: float, parent_discount: float, known: float, spread: np.ndarray, spread_tables: np.ndarray) -> Callable:
    """New tables of a bucket's pairs: TABLES, and to each of the parent's buckets SEATED."""

    def step(bucket: int, got: dict) -> Iterator[tuple]:
        r = Restaurants(got[STATE, 0][0], spread)
        new = np.minimum(r.count, 1)  # a single customer sits at one table
        old = unpack(got[TABLES, sweep - 1][0])[0] if sweep > 1 else new.copy()
        customers, tables = parent_of(got, sweep - 1)
        some = np.flatnonzero(r.count > 1)
        before, after, mine = r.before[some], r.after[some], old[some]
        others = customers[after] - mine
        rate = (STRENGTH + discount * (r.totals(old, spread_tables)[before] - mine)) * chance(others, np.minimum(tables[after], others), sums, parent_discount, known)
        new[some] = seat(r.count[some], rate, discount, stirling(discount), r.follow[after], r.own[before], sweep)
        yield bucket, TABLES, 0, sweep, pack(new), r.totals(new)[r.home :].tolist()
        seated = np.bincount(r.after, new, len(r.follow)).astype(np.int64)
        at = bounds(r.follow, parents)
        for b in np.flatnonzero(np.diff(at)):
            yield int(b), SEATED, bucket, sweep, pack(seated[at[b] : at[b + 1]]), []

    return step


def answers(sums: dict[int, tuple], discount: float, parent_discount: float, known: float, spread: np.ndarray, spread_customers: np.ndarray) -> Callable:
    """To each block ANSWER: its pairs' probabilities, and the training tokens of its words."""

    def step(bucket: int, got: dict) -> Iterator[tuple]:
        r = Restaurants(got[STATE, 0][0], spread)
        customers = STRENGTH + r.totals(r.count, spread_customers)
        q = np.zeros(len(r.pairs))
        for sweep, (both, spread_tables) in sums.items():
            tables = unpack(got[TABLES, sweep][0])[0]
            parent = chance(*parent_of(got, sweep), both, parent_discount, known)
            left = STRENGTH + discount * r.totals(tables, spread_tables)
            q += (r.count - discount * tables + left[r.before] * parent[r.after]) / customers[r.before]
        q = (q / len(sums)).astype(np.float32)
        for block, x in got[ASKED, 0].items():
            words, pairs = unpack(x)
            yield block, ANSWER, bucket, 0, pack(q[np.cumsum(pairs)], r.unigram[np.cumsum(words)]), []

    return step


def scored(n: int, known: int) -> Callable[[pa.Table], pa.Table]:
    """SCHEMA of a block's documents, from its STREAM and ANSWERs."""

    def run(group: pa.Table) -> pa.Table:
        stream, found = None, {}
        for k in range(group.num_rows):
            payload = group.column("payload")[k].as_buffer()
            if group.column("kind")[k].as_py() == STREAM:
                stream = unpack(payload)
            else:
                found[group.column("peer")[k].as_py()] = unpack(payload)
        ids, valid, learn, sizes, (size, begin), at, late, code = stream
        q, count = (np.concatenate([found[b][k] for b in sorted(found)]) for k in (0, 1))
        first = np.append(0, np.cumsum(sizes))
        pairs = pair_codes(code, first, int(begin), int(size))
        order = np.argsort(pairs)
        pairs = pairs[order]
        fresh = np.diff(pairs, prepend=-1) != 0
        place = np.empty(len(pairs), np.int64)
        place[order] = np.cumsum(fresh) - 1
        token = np.empty(len(q))
        token[dealt(pairs[fresh], int(size), at, late)[0]] = np.log10(np.maximum(q.astype(float), 1e-300))
        token = token[place]
        score = np.add.reduceat(token, first[:-1])
        base = np.add.reduceat(np.log10((count + 1) / (n + known + 1))[code], first[:-1])
        hits = np.add.reduceat((count > 0).astype(np.int64)[code], first[:-1])
        out = [pa.array(ids.astype(K.U).view(np.int64), mask=valid == 0), pa.array(learn == 0), pa.array(sizes), pa.array(hits), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / sizes))]
        del stream, found, pairs, order, fresh, place, token, code, group
        give_back()
        return pa.table(out, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every whole text of docs, by a model of the rows where learn holds (held_out: it doesn't); perplexity is the
    text's own."""
    base = id_text(docs, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("learn"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    parents = 1 + (buckets - 1) // BUCKETS_TO_PARENT
    share = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95))
    of = lambda found, *kinds: found.where(F.col("kind").isin(*kinds))

    spread = spread_words(base, size)
    state = by_bucket(counted(base, buckets, spread), "state", merged(parents, spread))
    n, known, once, twice, *late = total(state, STATE)
    spread_customers, spread_tables = np.array(late[: len(late) // 2]), np.array(late[len(late) // 2 :])
    discount = share(once, twice)
    parent = by_bucket(of(state, WORDS, SEATED), "parent", parent_step(0, 0.0, 0.0))
    sums = total(parent, PARENT)
    parent_discount = share(*sums[2:])
    kept, tables = {}, None
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        before = of(state, STATE).unionByName(parent)
        before = before if tables is None else before.unionByName(of(tables, TABLES))
        seated = by_bucket(before, "tables", seat_step(sweep, parents, sums, discount, parent_discount, known, spread, spread_tables))
        spread_tables = total(seated, TABLES)
        rate = (STRENGTH + parent_discount * sums[1]) / (known + 1)
        if sweep - 1 <= BURN_IN:
            dropped(parent, *([tables] if tables is not None else []))
        tables, parent = seated, by_bucket(of(state, WORDS).unionByName(of(seated, SEATED)), "parent", parent_step(sweep, rate, parent_discount))
        sums = total(parent, PARENT)
        if sweep > BURN_IN:
            kept[sweep] = (tables, parent, (sums, spread_tables))
    asked = of(state, ASKED, STATE)
    for t, p, _ in kept.values():
        asked = asked.unionByName(of(t, TABLES)).unionByName(p)
    answered = by_bucket(asked, "answers", answers({k: s for k, (_, _, s) in kept.items()}, discount, parent_discount, known, spread, spread_customers))
    for kind in (STATE, ASKED, WORDS, SEATED):
        part = of(state, kind)
        part.written_to = f"{state.written_to}/kind={kind}"
        dropped(part)
    dropped(*(x for t, p, _ in kept.values() for x in (t, p)))
    return of(state, STREAM).unionByName(answered).groupBy("bucket").applyInArrow(scored(int(n), int(known)), SCHEMA)
