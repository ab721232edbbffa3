"""What the dashboard computes from view rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.functions import scalars as S

#: Lower bounds of the severity histogram's bins; the last is open.
BINS = (0, 2, 4, 6, 8)


def normalized(rows: DataFrame) -> DataFrame:
    """View rows with the browser's defaults: text for ids, -- for no segment, 0 for no number, a close time only if real."""
    status = S.normalized_status("status")
    real = (status == "closed") & ~S.close_time_missing("end_ts")
    return rows.withColumns(
        {
            "incident_id": F.coalesce("incident_id", F.lit("")), "segment_id": F.coalesce("segment_id", F.lit("--")), "status": status, "closed_at": F.when(real, F.col("closed_at")), "end_ts": F.when(real, F.col("end_ts")),
            **{c: S.finite(c) for c in ("severity", "current_speed_mph", "baseline_speed_mph")}, "observed_count": F.coalesce("observed_count", F.lit(0)),
        }
    )


def sort_ms() -> Column:
    """The later of opening and closing; missing ones are 0."""
    return F.greatest(F.coalesce("start_ts", F.lit(0)), F.coalesce("end_ts", F.lit(0)))


def incident_key() -> Column:
    return F.coalesce(S.blank_to_null("incident_id"), F.concat(F.trim("segment_id"), F.lit("__"), F.trim(F.coalesce("opened_at", F.lit("")))))


def latest(rows: DataFrame, arrival: str = "ingested_at") -> DataFrame:
    """One row per incident: closed before open, then the later, then the more severe, then the later arrival."""
    own = normalized(rows).withColumn("__key", F.trim(incident_key()))
    order = [F.desc(F.col("status") == "closed"), F.desc(sort_ms()), F.desc("severity"), F.desc(arrival)]
    ranked = own.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
    return ranked.where("__n = 1").drop("__n").withColumnRenamed("__key", "incident_key")


def incidents_per_minute(distinct: DataFrame) -> DataFrame:
    """Incidents by the minute (UTC) they opened in; minutes without any aren't listed."""
    minute = F.col("start_ts") - F.pmod("start_ts", F.lit(60_000))
    return distinct.where("start_ts is not null").groupBy(minute.alias("minute_ms")).agg(F.count("*").alias("incidents")).orderBy("minute_ms")


def severity_histogram(rows: DataFrame) -> DataFrame:
    """Open rows in bins of severity; every bin is listed."""
    edges = [*BINS, None]
    inside = lambda a, b: (F.col("severity") >= a) & ((F.col("severity") < b) if b is not None else F.lit(True))
    counts = [F.count_if(inside(a, b)).alias(f"b{a}") for a, b in zip(edges, edges[1:], strict=False)]
    one = rows.where(F.col("status") == "open").agg(*counts)
    return one.select(F.expr(f"stack({len(BINS)}, {', '.join(f'{a}, b{a}' for a in BINS)}) as (bin_start, incidents)"))


def top_segments(distinct: DataFrame, k: int = 8) -> DataFrame:
    return distinct.groupBy("segment_id").agg(F.count("*").alias("incidents")).orderBy(F.desc("incidents"), "segment_id").limit(k)


def recent_history(distinct: DataFrame, k: int = 50) -> DataFrame:
    return distinct.withColumn("sort_ms", sort_ms()).orderBy(F.desc("sort_ms"), "incident_id").limit(k)


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("severity"), "incident_id")


def selected_segment(rows: DataFrame, segment_id: str) -> DataFrame:
    """The newest current row of a segment: its speeds."""
    return rows.where(F.col("segment_id") == segment_id).orderBy(F.desc("updated_at"), "incident_id").limit(1).select("segment_id", "current_speed_mph", "baseline_speed_mph")


def segments(current_rows: DataFrame, history_rows: DataFrame) -> DataFrame:
    return current_rows.select("segment_id").union(history_rows.select("segment_id")).where("segment_id <> ''").distinct()
