"""The events table replayed as a stream in event-time order, for the registered streaming queries.

Each slice of time is written to the source folder, then the query runs until it has taken it and stops; the next run goes on
from its checkpoint. So every replay is also three restarts, and a slice is written and read by as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import fsm
from tarmac.plans import catalog
from tarmac.shared import folder
from tarmac.streaming import pipeline

#: Slices of time that the events are replayed in.
SLICES = 4
#: Which rows come a slice late.
LATE = "cast(event_id as bigint) % 97 = 1"


def slices(rows: DataFrame, at: str, late: Column | None = None) -> list[DataFrame]:
    """rows by equal parts of the time at; late ones in the part after theirs."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    low, high = low or 0, high or 0
    step = (high - low) // SLICES + 1
    part = F.floor((F.col(at) - low) / step) + (F.lit(0) if late is None else F.when(late, 1).otherwise(0))
    return [rows.where(F.least(part, F.lit(SLICES - 1)) == k) for k in range(SLICES)]


def replayed(spark: SparkSession, parts: list[DataFrame], made: Callable[[DataFrame], DataFrame], clocked: bool = False) -> DataFrame:
    """What made(stream) has written after the last part."""
    base = folder(spark)
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = made(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        pipeline.to_files(out, f"{base}/out", f"{base}/state", None, clocked).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def windows_of(stream: DataFrame) -> DataFrame:
    return pipeline.metrics(stream, "3 hours", "event_type", scale=2).drop("window")


def stream_segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the windows that the replay closes."""
    return replayed(spark, slices(catalog.pings(spark, sf_dir), "timestamp_ms"), windows_of)


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where some rows come a slice late: those of closed windows are dropped, those of the open one count."""
    return replayed(spark, slices(catalog.pings(spark, sf_dir), "timestamp_ms", F.expr(LATE)), windows_of)


def stream_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings, some repeated within and across slices, less the repeats that come within the time to live."""
    pipeline.with_state_store(spark)
    rows = catalog.repeated(spark, sf_dir).select("vehicle_id", "event_id", F.col("arrival_ms").alias("timestamp_ms"), *(F.lit(0.0).alias(c) for c in ("lat", "lon", "speed_mps")))
    parts = slices(rows, "timestamp_ms", F.expr("cast(event_id as bigint) % 100 = 0 and timestamp_ms % 2 = 1"))
    day = 86_400_000
    return replayed(spark, parts, lambda s: pipeline.first_arrivals(s, day, live=1 << 30), clocked=True).groupBy("vehicle_id").agg(F.count("*").alias("kept"), F.count_distinct("event_id").alias("events"))


def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident events of the same windows, by the stream processor."""
    pipeline.with_state_store(spark)
    closed = stream_segment_metrics(spark, sf_dir)
    return replayed(spark, slices(closed, "window_end_ms"), lambda s: pipeline.incidents(s, fsm.Rules(hold_ms=catalog.HOURS_3)))


def stream_ping_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings counted by the processing time they come at: the windows depend on the clock, their sum does not."""
    base = folder(spark)
    counts: list[DataFrame] = []
    for part in slices(catalog.pings(spark, sf_dir), "timestamp_ms"):
        part.write.mode("append").parquet(f"{base}/in")
        found = pipeline.ping_counts(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        writer = found.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
        counts.append(found)
    return spark.read.schema(counts[-1].schema).parquet(f"{base}/out").agg(F.coalesce(F.sum("ping_count"), F.lit(0)).alias("pings"), (F.count_if(F.col("window_end_ms") % 10_000 != 0)).alias("odd_windows"))


def queries() -> dict:
    return {f.__name__: f for f in (stream_segment_metrics, stream_late_rows, stream_first_arrivals, stream_incidents, stream_ping_count)}


def oracle_sql() -> dict[str, str]:
    closed = "closed AS (SELECT * FROM metrics WHERE window_end_ms <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 5000)"
    # A row comes in slice came; slices before it have moved the watermark to the greatest time they brought, less five seconds.
    late = f"""WITH {catalog.PINGS}, edges AS (SELECT min(timestamp_ms) AS low, (max(timestamp_ms) - min(timestamp_ms)) // {SLICES} + 1 AS step FROM pings),
placed AS (SELECT pings.*, least((timestamp_ms - low) // step + CASE WHEN n % 97 = 1 THEN 1 ELSE 0 END, {SLICES - 1}) AS came, timestamp_ms - timestamp_ms % {catalog.HOURS_3} + {catalog.HOURS_3} AS window_end_ms FROM pings, edges),
marks AS (SELECT k, (SELECT max(timestamp_ms) FROM placed WHERE came < k) - 5000 AS mark FROM range({SLICES + 1}) r(k)),
kept AS (SELECT placed.* FROM placed JOIN marks ON k = came WHERE mark IS NULL OR window_end_ms > mark)
SELECT event_type AS segment_id, window_end_ms - {catalog.HOURS_3} AS window_start_ms, window_end_ms, count(*) AS ping_count, sum(speed_mps::DECIMAL(18,2))::DOUBLE / count(*) AS avg_speed_mps,
  min(speed_mps) AS min_speed_mps, max(speed_mps) AS max_speed_mps FROM kept WHERE window_end_ms <= (SELECT mark FROM marks WHERE k = {SLICES}) GROUP BY ALL"""
    return {
        "stream_segment_metrics": f"WITH {catalog.M3}, {closed} SELECT * FROM closed",
        "stream_late_rows": late,
        "stream_first_arrivals": f"WITH {catalog.PINGS} SELECT vehicle_id, count(*) AS kept, count(*) AS events FROM pings GROUP BY 1",
        "stream_incidents": f"WITH RECURSIVE {catalog.M3}, {closed}, {catalog.fsm_cte('closed')} SELECT * FROM incidents",
        "stream_ping_count": "SELECT count(*) AS pings, 0::BIGINT AS odd_windows FROM events",
    }
