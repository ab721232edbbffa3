"""The same definitions as streams: pings to metrics, metrics to incidents, incidents to tables.

Each stage is a query of its own with a checkpoint, and hands on by files (or Kafka), so that a restart goes on where it was
and file sinks are exactly-once. Duplicates are dropped before the watermark, by a processor whose state has a time to live, so
that late rows of open windows count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tarmac import schemas
from tarmac.operators import fsm, tables
from tarmac.operators.dedup import LIVE_IDS

LAG = "5 seconds"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Restarts of a failed query, and the pause before each, in seconds.
RESTARTS, PAUSE_S = 3, 10


def with_state_store(spark: SparkSession) -> SparkSession:
    """State in RocksDB, off the heap and on local disk, as processors of any state size need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def metrics(pings: DataFrame, window: str = "10 seconds", segment: str = "segment_id", lag: str = LAG, scale: int | None = None) -> DataFrame:
    """Metrics of closed windows, each once; keeps the window column, through which event time goes on. Late rows of a closed
    window are dropped, those of an open one count. Duplicates are the caller's to drop before (first_arrivals)."""
    rows = pings.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", lag)
    total = F.sum(F.col("speed_mps").cast(f"decimal(18,{scale})")).cast("double") if scale is not None else F.sum("speed_mps")
    found = rows.groupBy(F.col(segment).alias("segment_id"), F.window("ts", window)).agg(F.count("*").alias("ping_count"), (total / F.count("*")).alias("avg_speed_mps"), F.min("speed_mps").alias("min_speed_mps"), F.max("speed_mps").alias("max_speed_mps"))
    return found.select("segment_id", F.unix_millis("window.start").alias("window_start_ms"), F.unix_millis("window.end").alias("window_end_ms"), "ping_count", "avg_speed_mps", "min_speed_mps", "max_speed_mps", "window")


def ping_counts(pings: DataFrame, window: str = "10 seconds") -> DataFrame:
    """Pings by the processing time they arrive at; partial counts first, one row a window after."""
    return pings.withColumn("pt", F.current_timestamp()).withWatermark("pt", "0 seconds").groupBy(F.window("pt", window)).agg(F.count("*").alias("ping_count")).select(F.unix_millis("window.end").alias("window_end_ms"), "ping_count")


class Incidents(StatefulProcessor):
    """The state machine of one segment. Within a batch its metrics are sorted and due closes fire between them; a timer closes
    what falls due while the segment is silent."""

    STATE = "baseline double, start long, close_at long, speed double, count long"
    NAMES = [x.split()[0] for x in schemas.INCIDENT.split(", ")]

    def __init__(self, rules: fsm.Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("segment", self.STATE)

    def load(self) -> fsm.State:
        return fsm.State(*self.cell.get()) if self.cell.exists() else fsm.State()

    def store(self, state: fsm.State, timer: int | None) -> None:
        """Writes the state; the one timer follows the pending close."""
        self.cell.update((state.baseline, state.start, state.close_at, state.speed, state.count))
        if timer != state.close_at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if state.close_at is not None:
                self.handle.registerTimer(state.close_at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.load()
        timer = state.close_at
        for r in sorted(rows, key=lambda r: r["window_end_ms"]):
            for e in fsm.advance(key[0], state, r["window_end_ms"], r["ping_count"], r["avg_speed_mps"], self.rules):
                yield Row(**dict(zip(self.NAMES, e, strict=True)))
        self.store(state, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self.load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if state.close_at == at and (closed := fsm.fire(key[0], state, at)) is not None:
            self.cell.update((state.baseline, state.start, state.close_at, state.speed, state.count))
            yield Row(**dict(zip(self.NAMES, closed, strict=True)))

    def close(self) -> None:
        pass


def incidents(metric_rows: DataFrame, rules: fsm.Rules = fsm.Rules(), by_clock: bool = False) -> DataFrame:
    """Incident events of a stream of metrics. by_clock: pending closes fall due by the processing time, too; one operator has
    timers of one kind only, so that event time then moves with a segment's own metrics."""
    if by_clock:
        plain = metric_rows.select("segment_id", "window_end_ms", "ping_count", "avg_speed_mps")
        return plain.groupBy("segment_id").transformWithState(IncidentsByClock(rules), schemas.INCIDENT, "Append", "ProcessingTime")
    lag = f"{rules.lag_ms} milliseconds"
    rows = metric_rows.withColumn("end_ts", F.timestamp_millis("window_end_ms")).withWatermark("end_ts", lag)
    return rows.select("segment_id", "window_end_ms", "ping_count", "avg_speed_mps", "end_ts").groupBy("segment_id").transformWithState(Incidents(rules), schemas.INCIDENT, "Append", "EventTime")


class IncidentsByClock(Incidents):
    """The same, where a close that is pending also falls due by the clock, hold_ms after the recovery arrived: a stream that
    brings no data at all still closes. Whichever is due first closes; metrics that arrive carry event time on as before."""

    STATE = Incidents.STATE + ", timer long"

    def load(self) -> fsm.State:
        held = self.cell.get() if self.cell.exists() else (None,) * 6
        self.timer = held[5]
        return fsm.State(*held[:5])

    def store(self, state: fsm.State, pending: int | None) -> None:
        if state.close_at != pending:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.timer = None if state.close_at is None else self.now + self.rules.hold_ms
            if self.timer is not None:
                self.handle.registerTimer(self.timer)
        self.cell.update((state.baseline, state.start, state.close_at, state.speed, state.count, self.timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self.now = timerValues.getCurrentProcessingTimeInMs()
        yield from super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self.load()
        if self.timer == expiredTimerInfo.getExpiryTimeInMs() and state.close_at is not None:
            closed = fsm.fire(key[0], state, state.close_at)
            self.cell.update((state.baseline, state.start, state.close_at, state.speed, state.count, None))
            yield Row(**dict(zip(self.NAMES, closed, strict=True)))


class FirstArrivals(StatefulProcessor):
    """A vehicle's live event ids with the processing time they were first seen at. An id is dropped while it lives; duplicates
    don't extend it. At most every cleanup_ms ids beyond the newest LIVE_IDS are evicted."""

    def __init__(self, ttl_ms: int = 600_000, cleanup_ms: int = 60_000, live: int = LIVE_IDS):
        self.ttl_ms, self.cleanup_ms, self.live = ttl_ms, cleanup_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_id string", "at long", ttlDurationMs=self.ttl_ms + 1)
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in rows:
            at = (r["event_id"],)
            if self.seen.containsKey(at) and now - self.seen.getValue(at)[0] <= self.ttl_ms:
                continue
            self.seen.updateValue(at, (now,))
            yield r
        if not self.next.exists() or now >= self.next.get()[0]:
            self.next.update((now + self.cleanup_ms,))
            held = sorted((v[0], k[0]) for k, v in self.seen.iterator())
            for _, event_id in held[: max(0, len(held) - self.live)]:
                self.seen.removeKey((event_id,))

    def close(self) -> None:
        pass


def first_arrivals(pings: DataFrame, ttl_ms: int = 600_000, live: int = LIVE_IDS) -> DataFrame:
    """Duplicate removal with a time to live, ahead of any watermark; a vehicle's state is bounded by it and by live."""
    names = [x.split()[0] for x in schemas.PING.split(", ")]
    return pings.select(names).groupBy("vehicle_id").transformWithState(FirstArrivals(ttl_ms, live=live), schemas.PING, "Append", "ProcessingTime")


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def to_files(rows: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds", clocked: bool = False) -> StreamingQuery:
    """An exactly-once file sink; without an interval it takes all there is and ends. clocked: the rows come from a processor
    on processing time, which asks for batches without data for ever; a query that is to end must not run them."""
    spark = rows.sparkSession
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if every:
        return writer.trigger(processingTime=every).start()
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, str(before == "true" and not clocked).lower())
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA, before)


class Chain:
    """Two queries, of which the second reads what the first writes, awaited as one."""

    def __init__(self, first: StreamingQuery, second: StreamingQuery):
        self.queries = (first, second)

    def awaitTermination(self) -> None:
        """Returns when both have ended, fails when one does; then the other is stopped."""
        try:
            while any(q.isActive for q in self.queries):
                for q in self.queries:
                    q.awaitTermination(1)
            for q in self.queries:
                q.awaitTermination()
        finally:
            for q in self.queries:
                q.stop()


#: The producer's settings: every replica confirms, failures are tried again, records wait a little for company.
PRODUCER = {"kafka.acks": "all", "kafka.retries": "5", "kafka.linger.ms": "20"}


def to_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Records to a topic, with their key if they have one; a table is written at once. Spark's Kafka sink is at-least-once,
    so readers drop repeats by key."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic} | PRODUCER
    records = rows.select(*(c for c in ("key", "value") if c in rows.columns))
    if not rows.isStreaming:
        return records.write.format("kafka").options(**options).save()
    return records.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()


class Tables:
    """The history, one folder a batch and within it one for each hash bucket of ids, and the open incidents, one folder a
    version, kept by foreachBatch.

    A batch writes under its own id, so a replay overwrites what it wrote before; what other batches hold is not added again,
    for which only the buckets of its ids are read. The open incidents follow from what is new to the history only, so that a
    replayed open doesn't come back after its close. Snapshots before the last finished one are deleted.
    """

    HISTORY = schemas.HISTORY + ", batch long, bucket int"
    CURRENT = schemas.CURRENT + ", batch long"

    def __init__(self, path: str, buckets: int = 64):
        self.path, self.buckets = path, buckets

    def _at(self, spark: SparkSession, path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, spark: SparkSession, path: str, schema: str) -> DataFrame:
        at, store = self._at(spark, path)
        return spark.read.schema(schema).parquet(path) if store.exists(at) else spark.createDataFrame([], schema)

    def _done(self, spark: SparkSession, before: int | None = None) -> int:
        """The greatest finished batch, -1 for none."""
        rows = self._read(spark, f"{self.path}/done", "batch long")
        last = (rows if before is None else rows.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]
        return -1 if last is None else last

    def history(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, f"{self.path}/history", self.HISTORY).drop("batch", "bucket")

    def current(self, spark: SparkSession) -> DataFrame:
        """The snapshot of the greatest finished batch."""
        return self._read(spark, f"{self.path}/current", self.CURRENT).where(F.col("batch") == self._done(spark)).drop("batch")

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        bucket = F.pmod(F.xxhash64("incident_id"), F.lit(self.buckets)).cast("int")
        arrived = tables.history(events).withColumn("bucket", bucket).persist()
        try:
            own = [r[0] for r in arrived.select("bucket").distinct().collect()]  # no more than there are buckets
            earlier = self._read(spark, f"{self.path}/history", self.HISTORY).where((F.col("batch") != batch) & F.col("bucket").isin(own))
            fresh = arrived.join(earlier.select(schemas.HISTORY_KEY), schemas.HISTORY_KEY, "left_anti").persist()
            fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/history/batch={batch}")
            before = self._done(spark, batch)
            closed = fresh.where("status = 'closed'").select("incident_id")
            opened = tables.current(fresh.where("status = 'open'").drop("bucket"))
            kept = self._read(spark, f"{self.path}/current", self.CURRENT).where(F.col("batch") == before).drop("batch").join(opened.select("incident_id"), "incident_id", "left_anti")
            names = [x.split()[0] for x in schemas.CURRENT.split(", ")]
            kept.select(names).union(opened.select(names)).join(closed, "incident_id", "left_anti").select(names).write.mode("overwrite").parquet(f"{self.path}/current/batch={batch}")
            spark.range(1).withColumnRenamed("id", "ok").write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")
            fresh.unpersist()
        finally:
            arrived.unpersist()
        self._clean(spark, before)

    def _clean(self, spark: SparkSession, last: int) -> None:
        """Deletes snapshots older than last, which a reader may still hold."""
        at, store = self._at(spark, f"{self.path}/current")
        for found in store.listStatus(at):
            number = found.getPath().getName().removeprefix("batch=")
            if number.isdigit() and int(number) < last:
                store.delete(found.getPath(), True)


def to_tables(events: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    writer = events.writeStream.foreachBatch(Tables(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def supervised(start, restarts: int = RESTARTS, pause_s: float = PAUSE_S) -> None:
    """Runs start() to its end; after a failure it starts again from the checkpoint, a fixed number of times."""
    import time

    for left in range(restarts, -1, -1):
        try:
            start().awaitTermination()
            return
        except Exception:
            if not left:
                raise
            time.sleep(pause_s)
