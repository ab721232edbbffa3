"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams; the global order of n-grams is that of their 64-bit hashes. The order is
cut into fragments twice, for two purposes.

Candidates: two sets that reach the similarity differ in at most d n-grams, d known from their sizes. If the order is cut
into more than d fragments, some fragment holds the same n-grams of both. So sets are filed under the hash of each fragment
of theirs, at the number of fragments (a power of two) that their size, or that of a smaller partner, asks for. A fragment
holds several n-grams, hence frequent n-grams alone make no candidates. Where chance leaves so many fragments of a set empty
that equal ones might all be empty, the set is also filed under its first n-grams in the order (prefix filter), as its
partner then is too. No pair is lost.

Verification: candidate pairs meet fragment by fragment, partial overlaps are counted there and summed per pair.

Groups: what is asked for is components, so each set is first compared with one other only, its hub: the smallest id found
within two steps of shared files, which is the same one for all sets of a file. That finds each member's difference from the
hub, too. Two members differ by what their differences don't share; if no links connect them yet, they can only be linked if
their differences share at least a number of n-grams that their sizes give. Differences are joined by a prefix filter in the
order of rarity among the hub's members, so that independent edits of one text, however many, make hardly any pairs: what
many members share comes last, and what one member has alone joins nothing. No pair is lost, as linked sets share a file and
with it a hub. Equal sets are one class from the start, filed once under their smallest id.

Null and empty texts, and texts without words, have empty sets and are linked with nothing. Rows of a null id keep a null
component. Rows of equal id count as one document; if their texts differ, the one whose set has the smallest size and digest
is it, and rows of the others are named after their own set's class. A long text is one step of a task; an empty table gives
an empty result. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import by_bytes, dropped, id_text, written
from .components import components

#: Fragments of the order in which partial overlaps are counted, as a power of two.
FRAGMENT_BITS = 2
#: Bits of a signature that hold its level; the last one is that of crowded sets.
LEVEL_BITS = 6
CROWDED = (1 << LEVEL_BITS) - 1


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-gram hashes in order, and the row offsets."""
    data, offsets = K.buffer(texts)
    starts, ends, first = K.words(data, offsets)
    row, value = K.shingles(K.range_hashes(data, starts, ends, K.BYTE_VALUE_LOWER), first, n)
    return K.distinct_in_rows(row, value, len(texts))


class Rule:
    """What a similarity of at least percent / 100 implies for set sizes."""

    def __init__(self, percent: int):
        self.percent = percent

    def smallest_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-self.percent * n // 100)

    def differences(self, n: np.ndarray) -> np.ndarray:
        """The most n-grams in which a set of n and a linked one, no smaller, differ."""
        return (n + 100 * n // self.percent) * (100 - self.percent) // (100 + self.percent)

    def level(self, n: np.ndarray) -> np.ndarray:
        """The power of two of fragments for pairs whose smaller set has n: more than their differences, with room for empty ones."""
        need = self.differences(n) + 1 + (self.differences(n) + 11) // 12
        return np.ceil(np.log2(np.maximum(need, 1))).astype(np.int64)

    def largest_at(self, level: int) -> int:
        """The largest set size of that level."""
        lo, hi = 0, 1 << 40
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if int(self.level(np.array([mid]))[0]) <= level else (lo, mid - 1)
        return lo

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.smallest_partner(n) + 1


def signatures(value: np.ndarray, offsets: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of everything that the rows' sets are filed under, and (row, level, least): how many of a row's files
    at a level a linked partner shares at least. A signature's lowest bits are its level."""
    size = np.diff(offsets)
    low, high = rule.level(rule.smallest_partner(size)), rule.level(size)
    rows, found, needs = [], [], []
    tag = K.U((1 << LEVEL_BITS) - 1)
    for level in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= level) & (level <= high) & (size > 0))
        if not len(own):
            continue
        v = K.gather(value, offsets[:-1][own], size[own])
        r = np.repeat(own, size[own])
        part = v >> K.U(64 - level) if level else np.zeros(len(v), K.U)
        fresh = np.ones(len(v), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(fresh)
        rows.append(r[at])
        hashed = K.mix(np.add.reduceat(K.mix(v + K.U(1)), at) + K.mix(part[at] + K.U((level + 1) << 56)))
        found.append(hashed & ~tag | K.U(level))
        filled = np.bincount(r[at], minlength=len(size))[own]
        least = filled - rule.differences(np.minimum(size[own], rule.largest_at(level)))
        needs.append(np.column_stack([own, np.full(len(own), level), np.maximum(least, 1)]))
        crowded = own[least <= 0]
        if len(crowded):
            n = rule.prefix(size[crowded])
            rows.append(np.repeat(crowded, n))
            found.append(K.mix(K.gather(value, offsets[:-1][crowded], n) + K.U(0xF1E2)) | tag)
            needs.append(np.column_stack([crowded, np.full(len(crowded), CROWDED), np.ones(len(crowded), np.int64)]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros((0, 3), np.int64)
    return np.concatenate(rows), np.concatenate(found), np.unique(np.concatenate(needs), axis=0)


def digests(value: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two sums over each row's set that equal sets share."""
    sums = [np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(value ^ K.U(seed)))]) for seed in (0x1234567, 0x89ABCDE)]
    return [K.mix(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]


def filed(docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """(doc_id, size, d1, d2, files, needs): digests of the set, its signatures, and (level * 2 ** 32 + least) of each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            value, offsets = sets(batch.column("text"), n)
            row, signature, needs = signatures(value, offsets, rule)
            order = np.argsort(row, kind="stable")
            rows = np.arange(batch.num_rows + 1)
            files = K.list_column(signature[order].view(np.int64), np.searchsorted(row[order], rows))
            least = K.list_column(needs[:, 1] << 32 | needs[:, 2], np.searchsorted(needs[:, 0], rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), *(pa.array(d) for d in digests(value, offsets)), files, least], ["doc_id", "size", "d1", "d2", "files", "needs"])

    return written(docs.mapInArrow(run, "doc_id long, size long, d1 long, d2 long, files array<long>, needs array<long>"), "filed")


def fragments(docs: DataFrame, n: int) -> DataFrame:
    """(doc, fragment, grams): the sets of docs(doc_id, text, d1), cut along the order; empty fragments included. Only texts
    whose set has the digest d1 count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            value, offsets = sets(batch.column("text"), n)
            row = K.rows_of(offsets)
            part = row << FRAGMENT_BITS | (value >> K.U(64 - FRAGMENT_BITS)).astype(np.int64)
            every = np.arange(batch.num_rows << FRAGMENT_BITS)
            at = np.searchsorted(part, np.append(every, len(every)))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(every >> FRAGMENT_BITS)), pa.array((every & ((1 << FRAGMENT_BITS) - 1)).astype(np.int32)), K.list_column(value.view(np.int64), at)], ["doc", "fragment", "grams"])
            right = digests(value, offsets)[0] == batch.column("d1").to_numpy()
            yield out.filter(pa.array(np.repeat(right, 1 << FRAGMENT_BITS)))

    return docs.mapInArrow(run, "doc long, fragment int, grams array<long>")


def met(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) fragment by fragment, with both sides' n-grams there."""
    left, right = (parts.select(F.col("doc").alias(x), "fragment", F.col("grams").alias(f"g{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, ["b", "fragment"])


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the similarity: partial overlaps of each fragment, summed."""
    partial = met(pairs, parts).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def differences(stars: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b, nb, link, size, grams) of each star (a: hub, b: member): whether they are linked, and their difference."""
    partial = met(stars, parts).select("a", "b", "na", "nb", F.array_except("gb", "ga").alias("own"), F.array_except("ga", "gb").alias("lost"))
    partial = partial.select("a", "b", "na", "nb", F.size("own").cast("long").alias("own"), F.concat("own", "lost").alias("grams"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("own").alias("own"), F.flatten(F.collect_list("grams")).alias("grams"))
    return whole.select("a", "b", "nb", F.expr(f"100 * (nb - own) >= {percent} * (na + own)").alias("link"), F.size("grams").alias("size"), "grams")


def candidates(owned: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of a hub's members, of different components c, whose differences may share enough.

    owned: (hub, b, n, size, c, grams). A hub's n-grams are ordered by the number of members that differ in them; a pair
    that shares enough has one in common among the first of both.
    """
    split = written(owned.groupBy("hub").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("hub"), "split-hubs")
    listed = written(owned.join(split, "hub").select("hub", "b", "n", "size", "c", F.explode("grams").alias("gram")), "difference-grams")
    among = listed.groupBy("hub", "gram").agg(F.count("*").alias("df"), F.min("c").alias("least"), F.max("c").alias("most"))
    counted = written(listed.join(written(among, "difference-counts"), ["hub", "gram"]), "counted-grams")
    dropped(split, listed)
    place = F.row_number().over(Window.partitionBy("hub", "b").orderBy("df", "gram")) - 1
    # As many as any partner can ask for; of those, the ones that meet another component.
    first = F.expr(f"(n + 100 * n div {percent}) * {100 - percent} div {100 + percent} + 1")
    ranked = counted.withColumn("at", place).where(F.col("at") < first).where("least < most")
    ranked = written(ranked.select("hub", "gram", "b", "n", "size", "c", "at"), "first-grams")
    x, y = (ranked.select("hub", "gram", *(F.col(c).alias(f"{c}_{s}") for c in ("b", "n", "size", "c", "at"))) for s in "xy")
    share = f"greatest(1, (size_x + size_y - (n_x + n_y) * {100 - percent} div {100 + percent} + 1) div 2)"
    fits = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    pairs = x.join(y, (x["hub"] == y["hub"]) & (x["gram"] == y["gram"]) & F.expr(f"b_x < b_y and c_x <> c_y and {fits} and at_x <= size_x - {share} and at_y <= size_y - {share}"))
    out = written(pairs.select(F.col("b_x").alias("a"), F.col("b_y").alias("b"), F.col("n_x").alias("na"), F.col("n_y").alias("nb")).distinct(), "pairs")
    dropped(counted, ranked)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of every row of docs."""
    own, rule = id_text(docs, id_col, text_col), Rule(percent)
    marks = filed(own, n, rule)
    key = ["size", "d1", "d2"]
    ids = marks.where("size > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("k")).select("doc_id", "k.*")
    classes = written(ids.groupBy(*key).agg(F.min("doc_id").alias("rep")), "set-classes")
    chosen = classes.withColumnRenamed("rep", "doc_id")
    files = written(marks.join(chosen, ["doc_id", *key]).select(F.col("doc_id").alias("rep"), F.col("size").alias("n"), "files", "needs"), "class-files")

    rows = files.select("rep", "n", F.explode("files").alias("file"))
    shared = written(rows.groupBy("file").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("file"), "shared-files")
    met_there = written(rows.join(shared, "file").select("file", "rep", "n").distinct(), "members")
    # A linked partner shares at least so many files of a level; members that share fewer with all others have none.
    needs = files.select("rep", F.explode("needs").alias("need")).select("rep", F.expr("cast(shiftright(need, 32) as int)").alias("level"), F.expr(f"need & {(1 << 32) - 1}").alias("least")).distinct()
    level = F.expr(f"cast(file & {CROWDED} as int)").alias("level")
    enough = met_there.select("rep", level).groupBy("rep", "level").agg(F.count("*").alias("shared")).join(needs, ["rep", "level"]).where("shared >= least").select("rep", "level")
    members = written(met_there.select("*", level).join(enough, ["rep", "level"]).select("file", "rep", "n"), "members")
    dropped(files, shared, met_there)

    near = members.groupBy("file").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).where("hub < other").select("file", "hub")
    near = written(members.join(near, "file").groupBy("rep").agg(F.min("hub").alias("hub")), "near-hubs")
    hubs = written(members.join(near, "rep").groupBy("file").agg(F.min("hub").alias("hub")), "hubs")
    sizes = classes.select(F.col("rep").alias("a"), F.col("size").alias("na"))
    stars = members.join(hubs, "file").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct()
    stars = written(stars.join(sizes, "a").select("a", "b", "na", "nb"), "stars")
    dropped(members, near, hubs)

    sought = written(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct().join(chosen.select("doc_id", "d1"), "doc_id"), "sought")
    # One row for each id, or its overlaps would count twice. Only ids that occur again are gathered for that.
    twice = written(marks.join(chosen.join(sought.select("doc_id"), "doc_id"), ["doc_id", *key]).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    parts = fragments(own.join(sought, "doc_id").select("doc_id", "text", "d1"), n)
    if not twice.isEmpty():
        again = parts.join(twice.withColumnRenamed("doc_id", "doc"), "doc").groupBy("doc", "fragment").agg(F.max("grams").alias("grams"))
        parts = parts.join(twice.withColumnRenamed("doc_id", "doc"), "doc", "left_anti").union(again)
    parts = written(parts, "fragments")
    apart = written(differences(stars, parts, percent), "differences")
    # Members that a hub links are of one component; others join by their differences from it.
    component = F.expr("if(link, a, b)").alias("c")
    pairs = candidates(apart.select(F.col("a").alias("hub"), "b", F.col("nb").alias("n"), "size", component, "grams"), percent)
    more = written(linked(pairs, parts, percent), "links")
    found = components(apart.where("link").select("a", "b").union(more))
    dropped(stars, sought, twice, parts, apart, pairs, more)

    named = written(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component")), "named")
    dropped(classes, found)
    out = marks.select("doc_id", *key).join(named, key, "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose id is the smallest of its component; rows of a null id stay."""
    gone = jaccard_components(docs, n, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(written(gone, "gone"), id_col, "left_anti").select(docs.columns)
