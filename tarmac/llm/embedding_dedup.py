"""Near-duplicate embeddings by spherical-cap filters.

The filters are the words of a random product code: after a random rotation the space is cut into blocks, each block has its
own random unit vectors, and a filter is one of them from each block. A vector is decoded to the list of all filters whose
direction it exceeds by the cap's height (its own best ones if none), without looking at the rest: sums of two halves of the
blocks, sorted, are combined from the top. Vectors that share a filter are candidates, each pair once; cosines decide. The
code's size grows with the largest label, so that a filter holds a bounded share of unrelated vectors at any size.

Equal vectors of a label are one class, and only classes are paired; the links of their members are counted from class sizes.
Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id, link with
nothing (n_links 0, their own component). Vectors of unequal length are never linked. A repeated row is a vector of its own,
and so are unequal vectors of one id. Ties: a cosine of exactly the least one links. An empty table gives an empty result, a
long vector is a row of its own matrix, and further columns are left alone. Memory: a step of decoding holds STEP_SUMS sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import dropped, written
from .components import components

#: Filters that a vector is decoded to, about; and how far below its best filter's score a vector is decoded at least.
LIST_SIZE = 24
MARGIN = 0.03
#: Filters for each vector of the largest label: an unrelated vector then shares a filter with one or two others on average.
FILTERS = 32
#: Sums of half codes that are held at once.
STEP_SUMS = 1 << 19


class Code:
    """A product code for vectors of dim components."""

    def __init__(self, dim: int, filters: float, seed: int = 11):
        rng = np.random.default_rng((seed, dim))
        self.blocks = max(1, min(4, dim // 8))
        self.words = max(4, int(np.ceil(filters ** (1 / self.blocks))))
        self.step = max(1, STEP_SUMS // self.words ** ((self.blocks + 1) // 2))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), self.blocks)
        self.books = []
        for part in self.parts:
            book = rng.standard_normal((self.words, len(part)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(self.blocks))
        # A score is about normal with variance 1 / dim; the cap's height leaves LIST_SIZE of all filters above it.
        from statistics import NormalDist

        self.height = NormalDist().inv_cdf(max(0.5, 1 - LIST_SIZE / self.words**self.blocks)) / np.sqrt(dim)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every filter in each vector's list."""
        turned = units @ self.rotation
        scores = [turned[:, part] @ book.T for part, book in zip(self.parts, self.books, strict=True)]
        half = (self.blocks + 1) // 2

        def sums(some: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(units), 1))
            for s in some:
                out = (out[:, :, None] + s[:, None, :]).reshape(len(units), -1)
            return out

        left, right = sums(scores[:half]), sums(scores[half:])
        order = np.argsort(-right, axis=1)
        vector, found = [], []
        for i in range(len(units)):
            ranked = right[i, order[i]]
            least = min(self.height, left[i].max() + ranked[0] - MARGIN)
            some = np.flatnonzero(left[i] + ranked[0] >= least)
            counts = np.searchsorted(-ranked, left[i, some] - least, "right")
            at = np.repeat(some, counts)
            spot = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append(at * right.shape[1] + order[i, spot])
            vector.append(np.full(len(at), i))
        return np.concatenate(vector), np.concatenate(found)


def near_links(embeddings: DataFrame, least_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id is its component's), one row for each vector."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = rows.where(sound)
    digest = [F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), "v").alias("d2")]
    classes = valid.groupBy("label", *digest).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = written(classes.withColumn("cls", F.xxhash64("label", "d1", "d2")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    size = float(FILTERS) * max(largest or 1, 512)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            cls, width = batch.column("cls").to_numpy(), np.diff(np.asarray(batch.column("v").offsets))
            for dim in np.unique(width):
                every = np.flatnonzero(width == dim)
                code = codes.setdefault(int(dim), Code(int(dim), size))
                for at in range(0, len(every), code.step):
                    own = every[at : at + code.step]
                    x = np.asarray(batch.column("v").take(pa.array(own)).flatten()).reshape(len(own), dim)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    vector, found = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                    label, lists = batch.column("label").take(pa.array(own)), K.list_column(found.astype(np.int64), np.searchsorted(vector, np.arange(len(own) + 1)))
                    yield pa.RecordBatch.from_arrays([label, pa.array(np.full(len(own), dim, np.int32)), lists, pa.array(cls[own])], ["label", "dim", "filters", "cls"])

    kind = dict(classes.dtypes)
    listed = classes.select("label", "cls", "v").mapInArrow(decoded, f"label {kind['label']}, dim int, filters array<long>, cls long")
    listed = written(listed, "filters")
    key = ["label", "dim", "filter"]
    each = listed.select("*", F.explode("filters").alias("filter"))
    # Near vectors share many filters; a pair comes from the least of them only.
    once = F.col("filter") == F.array_min(F.array_intersect("filters", "theirs"))
    pairs = each.join(each.withColumnsRenamed({"cls": "other", "filters": "theirs"}), key).where((F.col("cls") < F.col("other")) & once).select(F.col("cls").alias("a"), F.col("other").alias("b"))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), F.col("v").alias(f"v{name}"), F.col("n").alias(f"n{name}"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                va, vb = (part.column(n) for n in ("va", "vb"))
                ok = np.zeros(part.num_rows, bool)
                width = np.diff(np.asarray(va.offsets))
                for dim in np.unique(width):
                    own = np.flatnonzero(width == dim)
                    x, y = (np.asarray(c.take(pa.array(own)).flatten()).reshape(len(own), dim) for c in (va, vb))
                    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                    ok[own] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= least_cosine
                yield part.filter(pa.array(ok)).select(["a", "b", "na", "nb"])

    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb")
    near = written(near.mapInArrow(verified, "a long, b long, na long, nb long"), "near")
    others = near.select(F.col("a").alias("cls"), F.col("nb").alias("n")).union(near.select("b", "na")).groupBy("cls").agg(F.sum("n").alias("others"))
    # Components are named by class; the smallest id of each is asked for.
    component = components(near).withColumnRenamed("id", "cls")
    least = component.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(component.join(least, "component").select("cls", "component_id"), "named")
    found = classes.select("label", "d1", "d2", "cls", "rep", "n").join(others, "cls", "left").join(named, "cls", "left")
    found = written(found.select("label", "d1", "d2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "found")
    dropped(classes, listed, near, named)
    linked = valid.select("vec_id", "label", *digest).join(found, ["label", "d1", "d2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
