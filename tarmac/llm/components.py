"""Connected components of a table of links, by rounds of large star and small star.

Each round links what a vertex sees to the smallest vertex it sees, first above it, then below. The link table stays as
large as its input, no vertex gathers its neighbours, and the number of rounds grows with the logarithm of the diameter.
Every step is a table in the shared folder, so that joins with a hub's many links start from plain exchanges that Spark can
split, and a lost executor costs no more than one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links(a, b); component is the smallest id reachable. Loops and repeats are allowed."""
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "links")
    before = digest(edges)
    if before[0]:
        for _ in range(rounds):
            both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
            least = written(both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("lo"), F.least("hi", "m").alias("m")), "least")
            large = written(edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct(), "large")
            low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
            small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").union(low.select("hi", F.col("m").alias("lo")))
            last, edges = edges, written(small.distinct(), "links")
            dropped(last, least, large, low)
            after = digest(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("the components did not settle")
    named = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
    out = written(named, "components")
    dropped(edges)
    return out


def digest(edges: DataFrame) -> tuple:
    """What equal link tables share: their size and two sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1000003), F.sum(F.xxhash64("lo", "hi", F.lit(1)) % 998244353)).first())
