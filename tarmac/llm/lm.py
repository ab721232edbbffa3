"""Language-model scores by a hierarchical Pitman-Yor model.

scores() has a restaurant for each preceding word: see bigram.py, which shares the seating here. The rest of this file is a
smaller model to compare it with, trigger_scores().

Contexts of the smaller model: the most frequent words serve as triggers; the context of a token is the group of the last trigger before it (or
none yet), triggers being grouped by which triggers follow them. Each context is a restaurant; all share one parent, the
restaurant of words without context, whose base is uniform over the known words and one unknown. A word's customers in a
context are its training tokens there; their tables are customers of the parent.

Seating is sampled by Gibbs. Given the rest, a dish's number of tables in a restaurant is drawn from its exact conditional,
by generalised Stirling numbers, up to EXACT customers; further ones are seated by the predictive rule in growing blocks.
Restaurants meet only in their table totals, so words are spread over partitions, and each sweep gathers no more than the
totals. Draws are hashes of word, context and sweep: a lost task draws the same again, and a later sweep can retrace the
earlier ones. Probabilities are averaged over the sweeps after the burn-in.

Scoring asks for the words of each block of documents (a split of the input) once, and looks them up there: what moves grows
with distinct words of blocks, not with tokens. Null and empty texts have one token, the end. Rows of a null id teach
nothing. Without training documents every token has probability 1. Repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import STEP_BYTES, by_bytes, dropped, give_back, id_text, written

TRIGGERS, GROUPS = 64, 9  # group 0: no trigger yet
#: A trigger makes at least one in so many of all words.
SHARE = 4000
END = K.mix(np.array([0xE0D], K.U))[0]
EXACT = 1024
STRENGTH = 1.0
BURN_IN, SAMPLES = 1, 3
#: Words with counts that a task gathers before it sums those of equal words; if over half stay, it hands them on.
GATHER = 600_000
BLOCKS_WITHOUT_FILES = 64


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and each row's first."""
    data, offsets = K.buffer(texts)
    starts, ends, first = K.words(data, offsets)
    rows = len(offsets) - 1
    out = np.empty(len(starts) + rows, K.U)
    out[np.arange(len(starts)) + K.rows_of(first)] = K.range_hashes(data, starts, ends, K.BYTE_VALUE_LOWER)
    out[first[1:] + np.arange(rows)] = END
    return out, first + np.arange(rows + 1)


@dataclass(frozen=True)
class Contexts:
    """triggers in order, and the group of each."""

    triggers: np.ndarray
    group: np.ndarray

    def last(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each token the trigger before it in its row, -1 for none."""
        if not len(self.triggers) or not len(words):
            return np.full(len(words), -1)
        k = np.minimum(np.searchsorted(self.triggers, words), len(self.triggers) - 1)
        hit = self.triggers[k] == words
        at = np.maximum.accumulate(np.where(hit, np.arange(len(words)), -1))
        before = np.concatenate([[-1], at[:-1]])
        begin = np.repeat(first[:-1], np.diff(first))
        return np.where(before >= begin, k[before], -1)

    def of(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        last = self.last(words, first)
        return np.where(last >= 0, self.group[last], 0) if len(self.group) else np.zeros(len(words), np.int64)


def frequent(docs: DataFrame) -> np.ndarray:
    """The TRIGGERS most frequent words, of those that make a SHARE-th of all. A word that does makes as much of some batch, so
    what batches report holds them all, and how batches are cut doesn't matter: the counts of all that may be among the
    first are taken again, over all texts."""

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words, _ = tokens(batch.column("text"))
            found, n = np.unique(words[words != END], return_counts=True)
            some = n * SHARE >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[some].view(np.int64), 0)), pa.array(np.append(n[some], n.sum()))], ["w", "n"])

    sums = written(docs.select("text").mapInArrow(reported, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "reported")
    total = (sums.where("w = 0").first() or {"n": 0})["n"]
    rows = sums.where("w <> 0")
    top = rows.orderBy(F.desc("n"), "w").limit(TRIGGERS).collect()
    # A word's count is less than what was reported and a SHARE-th of all; below the last of the top it can't be among them.
    least = (top[-1]["n"] if len(top) == TRIGGERS else 0) - total / SHARE
    asked = np.sort(np.array([r["w"] for r in rows.where(F.col("n") >= least).collect()], np.int64).view(K.U))
    dropped(sums)
    if not len(asked):
        return asked

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(asked), np.int64)
        for batch in by_bytes(batches):
            words, _ = tokens(batch.column("text"))
            at = np.minimum(np.searchsorted(asked, words), len(asked) - 1)
            n += np.bincount(at[asked[at] == words], minlength=len(asked))
        yield pa.RecordBatch.from_arrays([pa.array(asked[n > 0].view(np.int64)), pa.array(n[n > 0])], ["w", "n"])

    counts = docs.select("text").mapInArrow(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE >= total)
    return np.sort(np.array([r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(TRIGGERS).collect()], np.int64).view(K.U))


def grouped(docs: DataFrame, triggers: np.ndarray) -> Contexts:
    """The triggers in groups, by k-means on which triggers follow."""
    size = len(triggers)
    plain = Contexts(triggers, np.zeros(size, np.int64))
    if not size:
        return plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in by_bytes(batches):
            words, first = tokens(batch.column("text"))
            last = plain.last(words, first)
            k = np.minimum(np.searchsorted(triggers, words), size - 1)
            ok = (triggers[k] == words) & (last >= 0)
            total += np.bincount(last[ok] * size + k[ok], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    follows = np.zeros(size * size)
    for r in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        follows[r["k"]] = r["n"]
    x = follows.reshape(size, size) + 1e-3
    x = np.sqrt(x / x.sum(1, keepdims=True))
    best, rng = None, np.random.default_rng(9)
    for _ in range(12):
        centres = x[rng.choice(size, min(GROUPS - 1, size), replace=False)]
        for _ in range(40):
            own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        loss = ((x - centres[own]) ** 2).sum()
        if best is None or loss < best[0]:
            best = (loss, own)
    return Contexts(triggers, best[1] + 1)


def occurrences(docs: DataFrame, contexts: Contexts) -> DataFrame:
    """(w, block, c0, c1, ...): the words of each block of docs(text, block, learn), with their training tokens by context."""
    names = [f"c{g}" for g in range(GROUPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def summed() -> tuple[np.ndarray, ...]:
            block, word = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.lexsort((word, block))
            block, word = block[order], word[order]
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(fresh)
            counts = np.concatenate([x[2] for x in held])
            held.clear()
            counts = counts[order]
            return block[at], word[at], np.add.reduceat(counts, at, axis=0)

        def flush(block: np.ndarray, word: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(word), 50_000):
                j = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(word[j].view(np.int64)), pa.array(block[j]), *(pa.array(sums[j, g]) for g in range(GROUPS))], ["w", "block", *names])

        for batch in by_bytes(batches):
            words, first = tokens(batch.column("text"))
            group = contexts.of(words, first)
            row = K.rows_of(first)
            learn = np.asarray(batch.column("learn").to_numpy(zero_copy_only=False), bool)[row]
            block = batch.column("block").to_numpy()[row]
            for b in np.unique(block):
                own = block == b
                found, code = np.unique(words[own], return_inverse=True)
                at = (code * GROUPS + group[own])[learn[own]]
                counts = np.bincount(at, minlength=len(found) * GROUPS).reshape(-1, GROUPS)
                held.append((np.full(len(found), b, np.int64), found, counts))
                size += len(found)
            if size > GATHER:
                found = summed()
                size = len(found[1])
                if size > GATHER // 2:
                    yield from flush(*found)
                    size = 0
                else:
                    held.append(found)
        if held:
            yield from flush(*summed())
        give_back()

    return docs.mapInArrow(run, "w long, block long, " + ", ".join(f"{c} long" for c in names))


@lru_cache(maxsize=4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers [customers, tables], to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT):
            stay = out[c] + np.log(np.maximum(c - t * discount, 0))
            out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), np.where(np.isnan(stay), -np.inf, stay))
    return out


def uniform(word: np.ndarray, place: np.ndarray, sweep: int, salt: int = 0) -> np.ndarray:
    """Draws in (0, 1), one for each word and place."""
    seed = K.mix(word + (place.astype(K.U) + K.U(1)) * K.U(0x9E3779B97F4A7C15) + K.U(sweep * 1009 + salt * 7919 + 17))
    return ((seed >> K.U(11)).astype(float) + 0.5) / (1 << 53)


def seat(customers: np.ndarray, rate: np.ndarray, discount: float, table: np.ndarray, word: np.ndarray, place: np.ndarray, sweep: int) -> np.ndarray:
    """A drawn number of tables for each dish; rate: the weight of a new table."""
    tables = np.minimum(customers, 1).astype(float)
    some = np.flatnonzero(customers > 1)
    size = np.minimum(customers[some], EXACT)
    parts, top = [], 2  # those of few customers together, as they need few columns
    while top < 2 * EXACT:
        own = np.flatnonzero((size > top // 2) & (size <= top))
        parts += np.array_split(own, len(own) * top // 1_600_000 + 1)
        top *= 2
    for own in parts:
        at, c = some[own], size[own]
        t = np.arange(c.max(initial=0) + 1)
        weight = table[c, : len(t)] + t * np.log(np.maximum(rate[at], 1e-300))[:, None]
        weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
        draw = uniform(word[at], place[at], sweep) * weight[:, -1]
        tables[at] = np.maximum((weight < draw[:, None]).sum(1), 1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        total, x, r, done, step = customers[many].astype(float), tables[many], rate[many], np.full(len(many), float(EXACT)), 0
        while (left := total - done).max() > 0:
            size = np.minimum(np.maximum(done // 4, 1), np.maximum(left, 0))
            fresh = size * r / (done + size / 2 - discount * x + r)
            x = x + np.floor(fresh + uniform(word[many], place[many], sweep, step + 1))
            done, step = done + size, step + 1
        tables[many] = np.minimum(x, total)
    return tables


@dataclass
class Model:
    """What restaurants share: sizes, discounts, and the table totals after each sweep."""

    known: int
    customers: np.ndarray
    discount: float
    parent_discount: float
    totals: list[np.ndarray]  # of each sweep: tables by context, then the parent's

    def parent(self, seated: np.ndarray, tables: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """The parent's probability of dishes with so many customers and tables there."""
        new = (STRENGTH + self.parent_discount * totals[-1]) / (self.known + 1)
        return (seated - self.parent_discount * tables + new) / (STRENGTH + totals[:-1].sum())

    def backoff(self, totals: np.ndarray) -> np.ndarray:
        """What each context leaves to the parent."""
        return (STRENGTH + self.discount * totals[:-1]) / (STRENGTH + self.customers)

    def sweeps(self, word: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tables by word and context, the parent's tables by word) after each sweep: the known ones, and one more."""
        own, inner = stirling(self.discount), stirling(self.parent_discount)
        row, group = np.nonzero(counts)
        c = counts[row, group]
        tables = np.minimum(counts, 1).astype(float)
        top = np.ones(len(word))
        first = np.append(self.customers, 0.0)  # before any sweep, as if each token had a table of its own
        for sweep in range(len(self.totals) + 1):
            totals = self.totals[sweep - 1] if sweep else first
            p = self.parent(tables.sum(1), top, totals)
            rate = (STRENGTH + self.discount * totals[group]) * p[row]
            tables = np.zeros(counts.shape)
            tables[row, group] = seat(c, rate, self.discount, own, word[row], group, sweep)
            seated = tables.sum(1)
            rate = np.full(len(word), (STRENGTH + self.parent_discount * totals[-1]) / (self.known + 1))
            top = seat(seated.astype(np.int64), rate, self.parent_discount, inner, word, np.full(len(word), GROUPS), sweep)
            yield tables, top


def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("w").to_numpy().view(K.U), np.column_stack([batch.column(f"c{g}").to_numpy() for g in range(GROUPS)])


def fit(words: DataFrame) -> tuple[Model, int]:
    """The model of words(w, c0, c1, ...), and its number of tokens."""
    cells = [F.col(f"c{g}") for g in range(GROUPS)]
    ones = lambda k: F.sum(sum((c == k).cast("long") for c in cells))
    spread = sum((c > 0).cast("int") for c in cells)
    r = words.agg(F.count("*").alias("v"), ones(1).alias("n1"), ones(2).alias("n2"), F.sum((spread == 1).cast("long")).alias("m1"), F.sum((spread == 2).cast("long")).alias("m2"), *(F.sum(c).alias(f"s{g}") for g, c in enumerate(cells))).first()
    sums = np.array([float(r[f"s{g}"] or 0) for g in range(GROUPS)])
    share = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95))
    model = Model(r["v"], sums, share(r["n1"] or 0, r["n2"] or 0), share(r["m1"] or 0, r["m2"] or 0), [])
    for _ in range(BURN_IN + SAMPLES):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(GROUPS + 1)
            for batch in batches:
                *_, (tables, top) = model.sweeps(*matrix(batch))
                total += np.append(tables.sum(0), top.sum())
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS + 1)), pa.array(total)], ["g", "n"])

        found = dict(words.mapInArrow(run, "g long, n double").groupBy("g").agg(F.sum("n")).collect())
        model = Model(model.known, model.customers, model.discount, model.parent_discount, [*model.totals, np.array([found.get(g, 0.0) for g in range(GROUPS + 1)])])
    return model, int(sums.sum())


def probabilities(words: DataFrame, model: Model) -> DataFrame:
    """(w, c, p, q): each word's training tokens, its parent's probability after each kept sweep, its averaged ones by context."""
    lean = Model(model.known, model.customers, model.discount, model.parent_discount, model.totals[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, counts = matrix(batch)
            kept, q = [], np.zeros(counts.shape)
            for sweep, (tables, top) in enumerate(lean.sweeps(word, counts)):
                if sweep < BURN_IN:
                    continue
                totals = model.totals[sweep]
                p = model.parent(tables.sum(1), top, totals)
                kept.append(p)
                q += np.maximum(counts - model.discount * tables, 0) / (STRENGTH + model.customers) + model.backoff(totals) * p[:, None]
            row, group = np.nonzero(counts)
            at = np.searchsorted(row, np.arange(len(word) + 1))
            p = np.column_stack(kept)
            steps = np.arange(len(word) + 1) * p.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(counts.sum(1)), K.list_column(p.ravel().astype(np.float32), steps), K.list_column(group.astype(np.int8), at), K.list_column((q[row, group] / SAMPLES).astype(np.float32), at)], ["w", "c", "p", "g", "q"])
        give_back()

    return words.mapInArrow(run, "w long, c long, p array<float>, g array<byte>, q array<float>")


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every whole text of docs, by a model of the rows where learn holds (held_out: it doesn't), with a restaurant for
    each preceding word; perplexity is the text's own."""
    from .bigram import scores as by_words

    return by_words(docs, learn, id_col, text_col)


def trigger_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As scores, by the smaller model with groups of triggers for contexts."""
    where_from = F.when(F.input_file_name() != "", F.xxhash64(F.input_file_name(), F.input_file_block_start())).otherwise(F.pmod(F.xxhash64(F.col(id_col)), F.lit(BLOCKS_WITHOUT_FILES)))
    base = id_text(docs, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("learn"), where_from.alias("block"))
    base = base.withColumn("text", F.coalesce("text", F.lit("")))
    taught = base.where("learn")
    contexts = grouped(taught, frequent(taught))
    cells = [f"c{g}" for g in range(GROUPS)]
    occ = written(occurrences(base, contexts), "occurrences")
    words = written(occ.groupBy("w").agg(*(F.sum(c).alias(c) for c in cells)).where(" + ".join(cells) + " > 0"), "words")
    model, total = fit(words)
    asked = occ.select("w", "block").join(probabilities(words, model), "w")
    known, n = model.known, total
    backoff = np.array([model.backoff(t) for t in model.totals[BURN_IN:]]) / SAMPLES
    unknown = np.array([model.parent(np.zeros(1), np.zeros(1), t)[0] for t in model.totals[BURN_IN:]]) @ backoff

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        pack = zstd.ZstdCompressor(level=3).compress
        for batch in by_bytes(batches):
            z = [pack(x.as_buffer()) for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("learn"), batch.column("block"), pa.array(z, pa.binary())], ["doc_id", "learn", "block", "packed"])
        give_back()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard as zstd

        unpack = zstd.ZstdDecompressor().decompress
        # Nothing of a block's words is copied in their order; what a block needs at once is a table of GROUPS numbers a word.
        right = right.combine_chunks()
        flat = lambda name: right.column(name).combine_chunks() if right.num_rows else None
        word = right.column("w").to_numpy().view(K.U)
        size = len(word)
        chance = np.empty((size + 1, GROUPS))
        chance[-1] = unknown  # the last row: unknown words
        count = np.zeros(size + 1)
        if size:
            np.matmul(np.asarray(flat("p").flatten()).reshape(size, -1), backoff, out=chance[:-1])
            sizes = np.diff(np.asarray(flat("g").offsets))
            chance[np.repeat(np.arange(size), sizes), np.asarray(flat("g").flatten()).astype(np.int64)] = np.asarray(flat("q").flatten())
            count[:-1] = right.column("c").to_numpy()
        order = np.argsort(word)
        word = word[order]
        del right
        np.maximum(chance, 1e-300, out=chance)
        np.log10(chance, out=chance)
        simple = np.log10((count + 1) / (n + known + 1))
        rows: list[tuple] = []
        some: list[tuple] = []
        held = 0

        def flush() -> None:
            ids, learnt, texts = zip(*some, strict=True)
            found, first = tokens(pa.array(texts, pa.large_binary()))
            at = np.minimum(np.searchsorted(word, found), max(size - 1, 0))
            k = np.where(word[at] == found, order[at], size) if size else np.zeros(len(found), np.int64)
            sums = [np.add.reduceat(x, first[:-1]) for x in (simple[k], chance[k, contexts.of(found, first)], (k < size).astype(np.int64))]
            rows.extend(zip(ids, (not x for x in learnt), np.diff(first).tolist(), sums[2].tolist(), sums[0].tolist(), sums[1].tolist(), strict=True))

        for i, x, z in (row for batch in left.to_batches(max_chunksize=256) for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learn", "packed")), strict=True)):
            text = unpack(z) if z else b""
            some.append((i, x, text))
            held += len(text)
            if held > STEP_BYTES:
                flush()
                some, held = [], 0
        if some:
            flush()
        del chance, word, order, some, left
        give_back()
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        perplexity = 10.0 ** (-np.array(cols[5], float) / np.maximum(np.array(cols[2], float), 1))
        return pa.table([*arrays[:4], pa.array([n] * len(rows), pa.int64()), *arrays[4:], pa.array(perplexity)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    texts = base.select("doc_id", "text", "learn", "block").mapInArrow(packed, "doc_id long, learn boolean, block long, packed binary")
    return texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, SCHEMA)


def held_out_perplexity(scored: DataFrame, column: str = "score") -> float | None:
    """Of all tokens of the held-out texts together; none without any."""
    total = scored.where("held_out").agg((F.sum(column) / F.sum("n_tokens")).alias("mean")).first()["mean"]
    return None if total is None else 10.0**-total
