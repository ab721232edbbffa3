"""The four jobs as commands: python -m tarmac.streaming.jobs metrics|incidents|ping-counts|tables --option value ...

An option comes from the command line, else from the environment (its name in capitals), else from its default; blank values
count as none. With --servers records come from and go to Kafka topics, without from and to folders.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tarmac import schemas
from tarmac.functions import scalars as S
from tarmac.operators import fsm, parse, tables, windows
from tarmac.sources import pings as sources
from tarmac.streaming import pipeline


@dataclass(frozen=True)
class Options:
    servers: str = ""
    source: str = ""  # a topic, or a folder of JSON lines
    sink: str = ""
    group: str = "tarmac"
    checkpoint: str = ""
    every: str = "10 seconds"
    window: str = "10 seconds"
    dedup_ttl_ms: int = 600_000
    exact_dedup: bool = True  # duplicates removed within the time to live; false: the source has none
    by_clock: bool = False  # pending closes also fall due by the clock
    multiline: bool = False  # one object a file, over several lines
    alpha: float = fsm.Rules.alpha
    open_ratio: float = fsm.Rules.open_ratio
    close_ratio: float = fsm.Rules.close_ratio
    min_count: int = fsm.Rules.min_count
    close_hold_ms: int = fsm.Rules.hold_ms

    @classmethod
    def read(cls, args: Sequence[str], env: Mapping[str, str] = os.environ) -> Options:
        given: dict[str, str] = {}
        rest = list(args)
        while rest:
            name, _, value = rest.pop(0).removeprefix("--").partition("=")
            given[name.replace("-", "_")] = value or (rest.pop(0) if rest and not rest[0].startswith("--") else "true")
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        found = {}
        for f in fields(cls):
            text = next((x.strip() for x in (given.get(f.name), env.get(f.name.upper())) if x and x.strip()), None)
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() == "true" if kind is bool else kind(text)
        return cls(**found)

    @property
    def rules(self) -> fsm.Rules:
        return fsm.Rules(self.alpha, self.open_ratio, self.close_ratio, self.min_count, self.close_hold_ms)


def raw(spark: SparkSession, o: Options, earliest: bool = False) -> DataFrame:
    return sources.kafka(spark, o.servers, o.source, o.group, earliest) if o.servers else sources.json_lines(spark, o.source, stream=True, multiline=o.multiline)


def out(rows: DataFrame, o: Options) -> StreamingQuery:
    """Records in their wire form to the sink."""
    if o.servers:
        return pipeline.to_kafka(rows, o.servers, o.sink, o.checkpoint)
    return rows.select("value").writeStream.format("text").option("path", o.sink).option("checkpointLocation", o.checkpoint).outputMode("append").trigger(**({"processingTime": o.every} if o.every != "once" else {"availableNow": True})).start()


def metrics_job(spark: SparkSession, o: Options) -> StreamingQuery | pipeline.Chain:
    pings, first = parse.pings(raw(spark, o), observe="drops"), None
    if o.exact_dedup:
        # A query of its own, as the processor's timers are on processing time; it hands on by files.
        once, path = o.every == "once", f"{o.checkpoint}-arrivals"
        first = pipeline.to_files(pipeline.first_arrivals(pings, o.dedup_ttl_ms), path, f"{o.checkpoint}-arrivals-state", None if once else o.every, clocked=True)
        if once:
            first.awaitTermination()
        pings = spark.readStream.schema(schemas.PING).parquet(path)
    located = pings.withColumn("segment_id", S.segment_id("lat", "lon"))
    second = out(windows.metrics_json(pipeline.metrics(located, o.window)), o)
    return pipeline.Chain(first, second) if first is not None and o.every != "once" else second


def incidents_job(spark: SparkSession, o: Options) -> StreamingQuery:
    return out(tables.incidents_json(pipeline.incidents(parse.metrics(raw(spark, o)), o.rules, o.by_clock)), o)


def ping_counts_job(spark: SparkSession, o: Options) -> StreamingQuery:
    return out(pipeline.ping_counts(raw(spark, o), o.window).select(F.to_json(F.struct("window_end_ms", "ping_count")).alias("value")), o)


def tables_job(spark: SparkSession, o: Options) -> StreamingQuery:
    return pipeline.to_tables(tables.incidents_from_json(raw(spark, o, earliest=True)), o.sink, o.checkpoint, None if o.every == "once" else o.every)


JOBS = {"metrics": metrics_job, "incidents": incidents_job, "ping-counts": ping_counts_job, "tables": tables_job}


def producer_counts(pings: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """What a generator reports of each window: events, records, duplicates, records marked as moved back in time (late; none
    without such a column), and records a second."""
    rows = pings.withColumn("window_end_ms", windows.window_start("timestamp_ms", window_ms) + window_ms)
    moved = F.count_if("late") if "late" in pings.columns else F.lit(0).cast("long")
    found = rows.groupBy("window_end_ms").agg(F.count("*").alias("records"), F.count_distinct("event_id").alias("events"), moved.alias("late"))
    return found.select("window_end_ms", "events", "records", (F.col("records") - F.col("events")).alias("duplicates"), "late", (F.col("records") / F.lit(window_ms / 1000)).alias("rate"))


def main(args: Sequence[str]) -> None:
    job, options = JOBS[args[0]], Options.read(args[1:])
    spark = pipeline.with_state_store(SparkSession.builder.appName(f"tarmac-{args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    pipeline.supervised(lambda: job(spark, options))


if __name__ == "__main__":
    main(sys.argv[1:])
