"""Incident events to the two tables: an append-only history and the open incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmac import schemas
from tarmac.functions import scalars as S


def accepted(events: DataFrame) -> DataFrame:
    """What the sink takes: a mapped status of open or closed, a segment and an id; missing times read as 0."""
    rows = events.withColumn("status", S.sink_status("status")).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("start_ts", "end_ts")})
    return rows.where("incident_id <> '' and segment_id <> '' and status in ('open', 'closed')")


def event_time(status: str = "status") -> Column:
    """When an event happened, standing in for the wall clock of its arrival, so that replays agree."""
    return F.timestamp_millis(F.when(F.col(status) == "closed", F.col("end_ts")).otherwise(F.col("start_ts")))


def history(events: DataFrame, ingested: Column | None = None) -> DataFrame:
    """One row per incident, status and end time."""
    rows = accepted(events).dropDuplicates(schemas.HISTORY_KEY)
    return rows.withColumn("ingested_at", event_time() if ingested is None else ingested).select(*(x.split()[0] for x in schemas.HISTORY.split(", ")))


def current(history_rows: DataFrame) -> DataFrame:
    """The open incidents of a history: the latest open row of each id without a closed one, in one exchange by id."""
    by_id = Window.partitionBy("incident_id")
    rows = history_rows.withColumn("__closed", F.max((F.col("status") == "closed").cast("int")).over(by_id)).withColumn("__n", F.row_number().over(by_id.orderBy(F.desc("ingested_at"), F.desc("start_ts"))))
    return rows.where("__closed = 0 and __n = 1").select(*(F.col("ingested_at").alias("updated_at") if x.startswith("updated_at") else F.col(x.split()[0]) for x in schemas.CURRENT.split(", ")))


def violations(history_rows: DataFrame) -> DataFrame:
    """Rows that break a constraint of the history: required columns, known statuses, the unique key."""
    required = ["incident_id", "segment_id", "status", "start_ts", "end_ts"]
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in required)) == 1
    repeated = F.count("*").over(Window.partitionBy(*schemas.HISTORY_KEY)) > 1
    checked = history_rows.withColumn("broken", F.when(missing, "not null").when(~F.col("status").isin("open", "closed"), "status").when(repeated, "unique"))
    return checked.where("broken is not null")


def incidents_json(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*(F.col(a).alias(b) for a, b in schemas.INCIDENT_JSON))).alias("value"))


def incidents_from_json(raw: DataFrame, value_col: str = "value") -> DataFrame:
    kinds = dict(x.split() for x in schemas.INCIDENT.split(", "))
    read = raw.select(F.from_json(value_col, ", ".join(f"{b} {kinds[a]}" for a, b in schemas.INCIDENT_JSON)).alias("e"))
    return read.select(*(F.col(f"e.{b}").alias(a) for a, b in schemas.INCIDENT_JSON))
