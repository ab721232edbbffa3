"""Quality scores by Bradley-Terry pairwise ranking.

All preference pairs (a document marked good over one marked bad) train a linear score by logistic loss on the differences of
their features: rows are summed by kind in BINS of their score at each step, so that the loss of all pairs takes a pass over
the labelled rows, not over pairs; nothing is drawn. The threshold is the quantile of all training scores at the share of bad documents; a logistic curve
around it maps scores to 0 to 1, so that the threshold reads as CUT. Features cover whole texts and come from the text alone.

Null and empty texts have the features of an empty text and a score like any other. Labels that are null, or whose document
is missing, teach nothing; ids labelled twice count once, by the larger label. Where all labels are of one kind, every score is
that kind's, 1 or 0; without any label it is a half. Equal texts have equal scores; a long text is one step of a task; an empty
table gives an empty result. Repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_bytes, dropped, id_text, written

#: Bins of scores in which pairs are counted; those of a bin stand at its mean of their kind.
BINS = 512
#: What the threshold reads as, after scores are mapped to 0 to 1.
CUT = 0.3
SCHEMA = "doc_id long, score double"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text, from one pass over its bytes and words."""
    data, offsets = K.buffer(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    starts, ends, first = K.words(data, offsets)
    count = np.diff(first).astype(float)
    hashes = K.range_hashes(data, starts, ends, K.BYTE_VALUE_LOWER)
    row = K.rows_of(first)
    _, at = K.distinct_in_rows(row, hashes, n)
    pair_row, pair = K.shingles(hashes, first, 2)
    _, pair_at = K.distinct_in_rows(pair_row, pair, n)
    per_word = lambda mask: np.bincount(row, mask, n) / np.maximum(count, 1)
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    symbols = SYMBOLS[data] if len(data) else np.zeros(0, bool)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    length = (ends - starts).astype(float)
    last = SYMBOLS[data[ends - 1]].astype(float) if len(starts) else np.zeros(0)
    alone = (length == 1) * last
    some = np.maximum(size, 1)
    mean = per_word(length)
    columns = [
        per_row(upper) / some, per_row(lower) / some, per_row((data >= 48) & (data <= 57)) / some, per_row(symbols) / some, per_row(data == 10) / some, per_row(data >= 128) / some,
        np.diff(at) / np.maximum(count, 1), np.diff(pair_at) / np.maximum(count, 1), per_word(same), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)),
        per_word(last), per_word(alone), np.log1p(count), np.log1p(size), (count < 5).astype(float), np.log1p(count) * np.diff(at) / np.maximum(count, 1),
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(columns)))


@dataclass(frozen=True)
class Ranking:
    """A fitted score: standardised features, weights, threshold, and the scale of the curve around it."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    #: What to answer where nothing was learnt: 1 or 0 if all labels were, a half without any.
    plain: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.plain)
        z = (self.raw(x) - self.threshold) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def plain(good: float, rows: float) -> Ranking:
    """Of labels of one kind, or of none."""
    return Ranking(np.zeros(0), np.ones(0), np.zeros(0), 0.0, 1.0, good / rows if rows else 0.5)


def binned(s: np.ndarray, z: np.ndarray, good: np.ndarray, low: float, high: float) -> np.ndarray:
    """For each kind (bad, good) and bin of scores: number, sum of scores, sums of features and of their products."""
    width = z.shape[1]
    at = np.clip(((s - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1) + good * BINS
    upper = np.triu_indices(width)
    columns = [np.ones(len(s)), s, *z.T, *(z[:, i] * z[:, j] for i, j in zip(*upper, strict=True))]
    return np.column_stack([np.bincount(at, c, 2 * BINS) for c in columns])


def newton(sums: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """One step of Newton's method on the loss of all pairs of a good and a bad row, from binned sums."""
    width = len(w)
    n, total, first, second = sums[:, 0].reshape(2, BINS), sums[:, 1], sums[:, 2 : 2 + width].reshape(2, BINS, width), sums[:, 2 + width :].reshape(2, BINS, -1)
    mean = (total / np.maximum(sums[:, 0], 1)).reshape(2, BINS)
    p = 1 / (1 + np.exp(-np.clip(mean[1][:, None] - mean[0][None], -30, 30)))  # of each pair of bins, good by bad
    pairs = n[0].sum() * n[1].sum()
    lost, curved = 1 - p, p * (1 - p)
    gradient = ((lost @ n[0]) @ first[1] - (lost.T @ n[1]) @ first[0]) / pairs - penalty * w
    cross = first[1].T @ curved @ first[0]
    upper = np.triu_indices(width)
    own = np.zeros((width, width))
    own[upper] = (curved @ n[0]) @ second[1] + (curved.T @ n[1]) @ second[0]
    own = own + np.triu(own, 1).T
    step = np.linalg.solve((own - cross - cross.T) / pairs + penalty * np.eye(width), gradient)
    return step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))


def learnt(gather: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], penalty: float = 1e-3, steps: int = 25) -> Ranking:
    """The ranking of all labelled rows and all pairs of them. gather(f) is the sum over parts of the rows of f(features, which
    are good); each step is one, whatever the number of pairs."""
    n, of_good, *sums = gather(lambda x, good: np.concatenate([[len(x), good.sum()], x.sum(0)]))
    if not 0 < of_good < n:
        return plain(of_good, n)
    mean = np.array(sums) / n
    spread = np.sqrt(gather(lambda x, good: ((x - mean) ** 2).sum(0)) / n)
    spread = np.where(spread > 0, spread, 1)
    width = len(mean)

    def z(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / spread, -8, 8)

    moments = gather(lambda x, good: np.concatenate([z(x).sum(0), (z(x).T @ z(x)).ravel()])) / n
    centre, product = moments[:width], moments[width:].reshape(width, width)
    deviation = lambda w: float(np.sqrt(max(w @ product @ w - (w @ centre) ** 2, 0)))
    w = np.zeros(width)
    for _ in range(steps):
        reach = 6 * deviation(w) + 1e-9
        low, high = w @ centre - reach, w @ centre + reach
        step = newton(gather(lambda x, good, w=w, low=low, high=high: binned(z(x) @ w, z(x), good, low, high).ravel()).reshape(2 * BINS, -1), w, penalty)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    place = (n - of_good) / n * (n - 1)
    below, above = ranked(gather, lambda x: z(x) @ w, 8 * float(np.abs(w).sum()) + 1e-9, [np.floor(place), min(np.floor(place) + 1, n - 1)])
    return Ranking(mean, spread, w, below + (above - below) * float(place - np.floor(place)), max(deviation(w) / 4, 1e-9))


def ranked(gather, s: Callable[[np.ndarray], np.ndarray], reach: float, places: list[float]) -> list[float]:
    """The scores at places of their order, by counts in bins that narrow to a billionth; the mean of what a last bin holds."""
    spans = [(-reach, reach)] * len(places)
    while max(high - low for low, high in spans) > 1e-9 * reach:
        edges = [np.linspace(low, high, BINS + 1) for low, high in spans]
        counts = gather(lambda x, good, edges=edges: np.concatenate([np.bincount(np.searchsorted(e, s(x)), minlength=BINS + 2) for e in edges]))
        found = [int(np.searchsorted(np.cumsum(c), k, side="right")) for c, k in zip(counts.reshape(len(places), -1), places, strict=True)]
        spans = [(e[max(j - 1, 0)], e[min(j, BINS)]) for e, j in zip(edges, found, strict=True)]
    inside = lambda v: [part for low, high in spans for part in (((v > low) & (v <= high)).sum(), v[(v > low) & (v <= high)].sum())]
    held = gather(lambda x, good: np.array(inside(s(x)), float)).reshape(-1, 2)
    return [float(total / n) if n else float(high) for (n, total), (_, high) in zip(held, spans, strict=True)]


def fit(x: np.ndarray, good: np.ndarray, penalty: float = 1e-3, steps: int = 25) -> Ranking:
    """The ranking of rows at hand."""
    return learnt(lambda f: f(x, good), penalty, steps)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """The ranking learnt from all labelled documents."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), K.list_column(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], ["doc_id", "x"])

    # Features, not texts, meet the labels; of unequal texts with one id the lesser features count.
    own = id_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(run, "doc_id long, x array<double>")
    rows = written(own.join(marked, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).select("label", "x"), "labelled")

    def gather(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                    found = np.asarray(f(x, batch.column("label").to_numpy() == 1), float)
                    total = found if total is None else total + found
            if total is not None:
                total = total.ravel()
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, len(total))), pa.array(np.append(total[at], 0.0))], ["k", "v"])

        found = rows.mapInArrow(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        k, v = found.column("k").to_numpy(), found.column("v").to_numpy()
        out = np.zeros(k.max() + 1 if len(k) else 3)
        out[k] = v
        return out[:-1]  # the last key only tells the size

    ranking = learnt(gather)
    dropped(rows)
    return ranking


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            got = ranking.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(got)], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
