"""Tumbling-window aggregates: partial ones in each task, then one exchange by key and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_MS = 10_000


def window_start(ms: Column | str, window_ms: int) -> Column:
    """The epoch-aligned start of the window [start, start + window_ms) that holds ms."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return c - F.pmod(c, F.lit(window_ms))


def segment_metrics(pings: DataFrame, window_ms: int = WINDOW_MS, segment: str = "segment_id", scale: int | None = None) -> DataFrame:
    """Count, average, least and greatest speed of each segment and window. With scale, speeds of so many decimals are summed
    exactly, so that the average doesn't depend on the order of rows."""
    total = F.sum(F.col("speed_mps").cast(f"decimal(18,{scale})")).cast("double") if scale is not None else F.sum("speed_mps")
    rows = pings.select(F.col(segment).alias("segment_id"), window_start("timestamp_ms", window_ms).alias("window_start_ms"), "speed_mps")
    found = rows.groupBy("segment_id", "window_start_ms").agg(F.count("*").alias("ping_count"), (total / F.count("*")).alias("avg_speed_mps"), F.min("speed_mps").alias("min_speed_mps"), F.max("speed_mps").alias("max_speed_mps"))
    return found.select("segment_id", "window_start_ms", (F.col("window_start_ms") + window_ms).alias("window_end_ms"), "ping_count", "avg_speed_mps", "min_speed_mps", "max_speed_mps")


def ping_counts(pings: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Pings of each window over all vehicles."""
    rows = pings.select((window_start("timestamp_ms", window_ms) + window_ms).alias("window_end_ms"))
    return rows.groupBy("window_end_ms").agg(F.count("*").alias("ping_count"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    from tarmac import schemas

    pairs = zip(schemas.METRIC.split(", "), schemas.METRIC_JSON.split(", "), strict=True)
    return metrics.select(F.to_json(F.struct(*(F.col(a.split()[0]).alias(b.split()[0]) for a, b in pairs))).alias("value"))
