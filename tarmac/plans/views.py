"""The read views over the two tables: current, history, distinct history, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac.functions import scalars as S

MINUTE_MS = 60_000


def bounded(name: str, value: float, low: float, high: float | None = None) -> None:
    if value < low or high is not None and value > high:
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))


def _matching(rows: DataFrame, segment_id: str | None, min_severity: float | None = None) -> DataFrame:
    """Filters that aren't asked for aren't in the plan."""
    if segment_id is not None:
        rows = rows.where(F.col("segment_id") == segment_id)
    if min_severity is not None:
        bounded("min_severity", min_severity, 0)
        rows = rows.where(F.col("severity") >= min_severity)
    return rows


def current_view(current: DataFrame, segment_id: str | None = None, min_severity: float | None = None, limit: int | None = 200, python_rounding: bool = False) -> DataFrame:
    """The newest open incidents, all without a limit; ids break ties."""
    if limit is not None:
        bounded("limit", limit, 1, 1000)
    rows = _matching(current, segment_id, min_severity)
    top = rows if limit is None else rows.orderBy(F.desc("updated_at"), "incident_id").limit(limit)
    return top.select(
        "incident_id", "segment_id", F.lit("open").alias("status"), S.ms_to_iso("start_ts").alias("opened_at"), "severity", S.to_mph("baseline_speed_mps", python_rounding).alias("baseline_speed_mph"),
        S.to_mph("observed_speed_mps", python_rounding).alias("current_speed_mph"), "observed_count", S.ms_to_iso(F.unix_millis("updated_at")).alias("updated_at"), "start_ts",
    )


def history_raw(history: DataFrame, segment_id: str | None = None, since_ms: int | None = None, limit: int | None = 500, python_rounding: bool = False) -> DataFrame:
    """The newest event rows, all without a limit; close times only on closed ones, and only positive."""
    if limit is not None:
        bounded("limit", limit, 1, 5000)
    rows = _matching(history, segment_id)
    if since_ms is not None:
        rows = rows.where((F.col("start_ts") >= since_ms) | (F.coalesce("end_ts", "start_ts") >= since_ms))
    top = rows if limit is None else rows.orderBy(F.desc("ingested_at"), "incident_id", "status").limit(limit)
    status = S.normalized_status("status")
    closed = F.when((status == "closed") & (F.col("end_ts") > 0), F.col("end_ts"))
    return top.select(
        "incident_id", "segment_id", status.alias("status"), S.ms_to_iso("start_ts").alias("opened_at"), S.ms_to_iso(closed).alias("closed_at"), "severity",
        S.to_mph("baseline_speed_mps", python_rounding).alias("baseline_speed_mph"), S.to_mph("observed_speed_mps", python_rounding).alias("current_speed_mph"), "observed_count",
        S.ms_to_iso(F.unix_millis("ingested_at")).alias("ingested_at"), "start_ts", closed.alias("end_ts"),
    )


def history_distinct(rows: DataFrame) -> DataFrame:
    """One row per incident of history_raw's rows: the newest closed one if any, else the newest; the start that the newest
    row knows; the close time of the first closed row that has one. Rows without an id stay by themselves."""
    # A row without an id is named by its place among those rows; all others are numbered within their id, at no one task's cost.
    own = F.nullif("incident_id", F.lit(""))
    place = F.row_number().over(Window.partitionBy(F.coalesce(own, F.lit(""))).orderBy(F.desc("ingested_at"), "status", "start_ts")) - 1
    keyed = rows.withColumn("incident_id", F.coalesce(own, F.concat(F.lit("_row_"), place.cast("string"))))
    rest = [c for c in rows.columns if c != "incident_id"]
    closed = F.col("status") == "closed"
    best = keyed.groupBy("incident_id").agg(
        F.max_by(F.struct(*rest), F.struct(closed.cast("int"), "ingested_at")).alias("w"),
        F.max_by(F.struct("opened_at", "start_ts"), F.struct("ingested_at", "status")).alias("n"),
        F.max_by(F.struct("closed_at", "end_ts"), F.when(closed & F.col("end_ts").isNotNull(), F.struct("ingested_at", "end_ts"))).alias("c"),
    )
    known = {
        "opened_at": F.coalesce("n.opened_at", "w.opened_at"),
        "start_ts": F.coalesce(F.nullif("n.start_ts", F.lit(0)), "w.start_ts"),
        "closed_at": F.when(F.col("w.status") == "closed", F.coalesce("w.closed_at", "c.closed_at")),
        "end_ts": F.when(F.col("w.status") == "closed", F.coalesce("w.end_ts", "c.end_ts")),
    }
    return best.select("incident_id", *(known.get(c, F.col(f"w.{c}")).alias(c) for c in rest))


def summary_current(current: DataFrame, segment_id: str | None = None, min_severity: float | None = None) -> DataFrame:
    rows = _matching(current, segment_id, min_severity)
    return rows.agg(F.count("*").alias("active_incidents"), F.coalesce(S.round1(F.avg("severity")), F.lit(0.0)).alias("average_severity"))


def recent(now_ms: int, minutes: int) -> Column:
    bounded("recent_window_minutes", minutes, 1, 1440)
    return F.col("start_ts") >= now_ms - minutes * MINUTE_MS


def summary_history(history: DataFrame, now_ms: int, minutes: int = 5, segment_id: str | None = None) -> DataFrame:
    """Event rows, incidents, and incidents opened in the last minutes, in one scan."""
    found = F.count_distinct(F.when(recent(now_ms, minutes), F.col("incident_id")))
    return _matching(history, segment_id).agg(F.count("*").alias("history_event_rows"), F.count_distinct("incident_id").alias("history_incidents"), found.alias("opened_recently"))


def top_segment(history: DataFrame, segment_id: str | None = None) -> DataFrame:
    """The segment of most incidents; the greater name wins a tie."""
    rows = _matching(history, segment_id).where("segment_id is not null and segment_id <> ''")
    return rows.groupBy("segment_id").agg(F.count_distinct("incident_id").alias("incident_count")).orderBy(F.desc("incident_count"), F.desc("segment_id")).limit(1)


def overview(current: DataFrame, history: DataFrame, now_ms: int, minutes: int = 5, segment_id: str | None = None, min_severity: float | None = None) -> DataFrame:
    """The dashboard's one row; the least severity holds for the current half only. Its parts are one row each."""
    parts = summary_current(current, segment_id, min_severity).join(F.broadcast(summary_history(history, now_ms, minutes, segment_id)))
    top = top_segment(history, segment_id).select(F.struct("segment_id", "incident_count").alias("t"))
    one = parts.join(F.broadcast(top.agg(F.max("t").alias("t"))))
    return one.select(
        S.ms_to_iso(F.lit(now_ms)).alias("generated_at"), "active_incidents", "average_severity", "opened_recently",
        F.col("t.segment_id").alias("top_segment"), F.coalesce("t.incident_count", F.lit(0)).alias("top_segment_incident_count"), F.col("active_incidents").alias("current_incident_rows"), "history_event_rows", "history_incidents",
    )


def card_metrics(one: DataFrame) -> DataFrame:
    """An overview in its nested form."""
    cards = ["active_incidents", "average_severity", "top_segment", "top_segment_incident_count", "opened_recently"]
    most = F.struct(F.col("top_segment").alias("segment_id"), F.col("top_segment_incident_count").alias("incident_count"))
    return one.select("generated_at", *cards[:2], "opened_recently", most.alias("most_affected_segment"), "current_incident_rows", "history_event_rows", "history_incidents", F.struct(*cards).alias("card_metrics"))


def overview_of_rows(current_rows: DataFrame, history_rows: DataFrame, now_ms: int, minutes: int = 5) -> DataFrame:
    """The overview of view rows: incidents are merged first, segments trimmed, statuses read as views read them."""
    active = current_rows.where(S.normalized_status("status") != "closed").agg(F.count("*").alias("active_incidents"), F.coalesce(S.round1(F.avg("severity")), F.lit(0.0)).alias("average_severity"))
    distinct = history_distinct(history_rows)
    counts = distinct.agg(F.count("*").alias("history_incidents"), F.count(F.when(recent(now_ms, minutes), 1)).alias("opened_recently"))
    named = distinct.select(F.trim("segment_id").alias("segment_id")).where("segment_id <> ''")
    top = named.groupBy("segment_id").agg(F.count("*").alias("incident_count")).agg(F.max(F.struct("incident_count", "segment_id")).alias("t"))
    one = active.join(F.broadcast(counts)).join(F.broadcast(top)).join(F.broadcast(history_rows.agg(F.count("*").alias("history_event_rows"))))
    return one.select("active_incidents", "average_severity", "opened_recently", F.col("t.segment_id").alias("top_segment"), F.coalesce("t.incident_count", F.lit(0)).alias("top_segment_incident_count"), "history_event_rows", "history_incidents")
