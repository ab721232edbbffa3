"""One ping per vehicle and event id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["vehicle_id", "event_id"]
#: Event ids that a vehicle's state holds at most.
LIVE_IDS = 512


def first_arrivals(pings: DataFrame, arrival: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The first ping of each key by arrival (any one without). With a time to live, a ping that comes later than that after
    the last kept one is kept again; duplicates in between don't extend it."""
    if arrival is None:
        return pings.dropDuplicates(KEY)
    if ttl_ms is None:
        ranked = pings.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(arrival)))
        return ranked.where("__n = 1").drop("__n")
    # Kept times of a key in arrival order: each is the first one past the time to live of the kept one before.
    times = F.array_sort(F.collect_list(arrival))
    fold = F.aggregate(times, F.array().cast("array<bigint>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > ttl_ms), F.concat(kept, F.array(t))).otherwise(kept))
    kept = pings.groupBy(*KEY).agg(fold.alias("__kept")).select(*KEY, F.explode("__kept").alias(arrival))
    ranked = pings.join(kept, [*KEY, arrival]).withColumn("__n", F.row_number().over(Window.partitionBy(*KEY, arrival).orderBy(*KEY)))
    return ranked.where("__n = 1").drop("__n").select(pings.columns)


def newest_ids(pings: DataFrame, arrival: str = "timestamp_ms", live: int = LIVE_IDS) -> DataFrame:
    """What a vehicle's state holds after eviction: its newest ids by arrival. Window-group limits cut rows before the exchange."""
    ranked = pings.withColumn("__n", F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc(arrival), F.desc("event_id"))))
    return ranked.where(F.col("__n") <= live).drop("__n")
