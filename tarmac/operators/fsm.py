"""The incident state machine: one transition rule, hosted by a batch fold here and by a stream processor in streaming.

A segment's metrics are taken by ascending window end. Before each one, a pending close whose time the watermark (window end
less lag, less 1 ms) has reached is emitted; after the last one, those that the greatest window end of all segments reaches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schemas


@dataclass(frozen=True)
class Rules:
    alpha: float = 0.20
    open_ratio: float = 0.80
    close_ratio: float = 0.90
    min_count: int = 3
    hold_ms: int = 10_000
    lag_ms: int = 5_000


@dataclass
class State:
    """Of a segment: its baseline; the open incident's start, pending close time, and last (average, count)."""

    baseline: float | None = None
    start: int | None = None
    close_at: int | None = None
    speed: float | None = None
    count: int | None = None


def severity(baseline: float, observed: float, count: int) -> float:
    if baseline <= 0:
        return 0.0
    drop = min(max((baseline - observed) / baseline, 0.0), 1.0) * min(1.0, count / 10.0) * 10.0
    return math.floor(min(max(drop, 0.0), 10.0) * 10.0 + 0.5) / 10.0


def incident_id(segment: str | None, start: int) -> str:
    """Repeatable: a replay gives the same ids."""
    return "inc_" + hashlib.md5(f"{segment or ''}:{start}".encode()).hexdigest()[:20]


def event(segment: str | None, status: str, state: State, start: int, end: int) -> tuple:
    b, o, n = state.baseline or 0.0, state.speed or 0.0, state.count or 0
    return (incident_id(segment, start), segment, status, start, end, severity(b, o, n), b, o, n)


def fire(segment: str | None, state: State, watermark: int) -> tuple | None:
    """The close event that is due, if any; the baseline stays."""
    if state.close_at is None or watermark < state.close_at:
        return None
    closed = event(segment, "closed", state, state.start or 0, state.close_at)
    state.start = state.close_at = state.speed = state.count = None
    return closed


def advance(segment: str | None, state: State, end: int, count: int, speed: float, rules: Rules) -> Iterator[tuple]:
    """Takes one metric: the events it causes."""
    if (closed := fire(segment, state, end - rules.lag_ms - 1)) is not None:
        yield closed
    state.speed, state.count = speed, count
    base = speed if state.baseline is None else state.baseline
    if state.start is None:  # an open incident freezes the baseline
        base = rules.alpha * speed + (1.0 - rules.alpha) * base
    state.baseline = base
    if state.start is None:
        if count >= rules.min_count and speed < base * rules.open_ratio:
            state.start, state.close_at = end, None
            yield event(segment, "open", state, end, 0)
    elif speed >= base * rules.close_ratio:
        if state.close_at is None:  # a second recovery doesn't extend the hold
            state.close_at = end + rules.hold_ms
    else:
        state.close_at = None


def incidents(metrics: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Incident events of a table of metrics, one row each.

    Segments are dealt out by hash and sorted within their partition, and each task walks its rows once with the state of one
    segment, so that a segment's history may be of any length. Metrics without a segment or window end are left out.
    """
    names = [x.split()[0] for x in schemas.INCIDENT.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 9, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, state = None, State()
        for batch in batches:
            rows: list[tuple] = []
            for name, end, count, speed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != segment:
                    if state.close_at is not None:
                        rows.append(event(segment, "pending", state, state.start or 0, state.close_at))
                    segment, state = name, State()
                rows.extend(advance(name, state, end, count, speed, rules))
            yield batch_of(rows)
        if state.close_at is not None:
            yield batch_of([event(segment, "pending", state, state.start or 0, state.close_at)])

    kept = metrics.where("segment_id is not null and window_end_ms is not null").select("segment_id", "window_end_ms", F.coalesce("ping_count", F.lit(0)).alias("n"), F.coalesce("avg_speed_mps", F.lit(0.0)).alias("avg"))
    walked = kept.repartition("segment_id").sortWithinPartitions("segment_id", "window_end_ms").mapInArrow(run, schemas.INCIDENT)
    # Closes still pending at the end wait for the greatest window end: one row, a proven bound for the broadcast.
    last = kept.agg(F.max("window_end_ms").alias("__last"))
    due = (F.col("status") != "pending") | (F.col("end_ts") <= F.col("__last") - rules.lag_ms - 1)
    return walked.join(F.broadcast(last)).where(due).select(*(F.when(F.col("status") == "pending", "closed").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in names))


def baselines(metrics: DataFrame, alpha: float = Rules.alpha) -> DataFrame:
    """The average's exponential mean after each metric of a segment, as if no incident ever opened. As the state machine, a
    task walks its sorted rows once and holds one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, mean = None, None
        for batch in batches:
            out = []
            for name, speed in zip(batch.column("segment_id").to_pylist(), batch.column("avg").to_pylist(), strict=True):
                if name != segment:
                    segment, mean = name, None
                mean = alpha * speed + (1.0 - alpha) * (speed if mean is None else mean)
                out.append(mean)
            yield pa.RecordBatch.from_arrays([batch.column("segment_id"), batch.column("window_end_ms"), pa.array(out, pa.float64())], ["segment_id", "window_end_ms", "baseline"])

    kept = metrics.where("segment_id is not null and window_end_ms is not null").select("segment_id", "window_end_ms", F.coalesce("avg_speed_mps", F.lit(0.0)).alias("avg"))
    return kept.repartition("segment_id").sortWithinPartitions("segment_id", "window_end_ms").mapInArrow(run, "segment_id string, window_end_ms long, baseline double")
