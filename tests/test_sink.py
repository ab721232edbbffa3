"""The table sink and the exact duplicate remover."""

import pytest

from tarmac import schemas
from tarmac.operators import fsm
from tarmac.streaming import pipeline


def events(spark, *rows):
    return spark.createDataFrame([(i, "s", st, start, end, 1.0, 20.0, 10.0, 5) for i, st, start, end in rows], schemas.INCIDENT)


def test_replays_change_nothing(spark, tmp_path):
    sink = pipeline.Tables(str(tmp_path))
    first, second = events(spark, ("a", "open", 1000, 0), ("b", "open", 2000, 0)), events(spark, ("a", "close", 1000, 5000), ("c", "odd", 1, 1))
    state = lambda: (sink.history(spark).count(), sorted(r.incident_id for r in sink.current(spark).collect()))
    sink(first, 0)
    assert state() == (2, ["a", "b"])
    sink(first, 0)
    assert state() == (2, ["a", "b"])
    sink(second, 1)
    assert state() == (3, ["b"])
    sink(second, 1)
    sink(first, 2)  # a replayed open after its close
    assert state() == (3, ["b"])


def test_stream_to_tables(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark, ("a", "open", 1000, 0), ("a", "open", 1000, 0), ("b", "open", 2000, 0)).coalesce(1).write.parquet(src)
    rows = spark.readStream.schema(schemas.INCIDENT).parquet(src)
    pipeline.supervised(lambda: pipeline.to_tables(rows, str(tmp_path / "t"), str(tmp_path / "c"), None), restarts=0)
    sink = pipeline.Tables(str(tmp_path / "t"))
    assert sink.history(spark).count() == 2 and sink.current(spark).count() == 2


def test_old_snapshots_go(spark, tmp_path):
    sink = pipeline.Tables(str(tmp_path), buckets=2)
    for k in range(4):
        sink(events(spark, (f"i{k}", "open", 1000 + k, 0), ("i0", "open", 1000, 0)), k)
    assert sorted(p.name for p in (tmp_path / "current").iterdir()) == ["batch=2", "batch=3"]
    assert sink.history(spark).count() == 4 and sink.current(spark).count() == 4


def test_time_to_live_across_restarts(spark, tmp_path):
    """The processor run by Spark: repeats within a batch and after a restart go, until the time to live has passed."""
    import time

    pipeline.with_state_store(spark)
    pings = spark.createDataFrame([("v", e, 1, 1.0, 2.0, 3.0) for e in ("a", "a", "b")] + [("w", "a", 1, 1.0, 2.0, 3.0)], schemas.PING)
    found = []
    for ttl in (600_000, 600_000, 1):
        pings.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(schemas.PING).parquet(str(tmp_path / "in"))
        pipeline.to_files(pipeline.first_arrivals(rows, ttl), str(tmp_path / "out"), str(tmp_path / "state"), None, clocked=True).awaitTermination()
        found.append(sorted((r.vehicle_id, r.event_id) for r in spark.read.schema(schemas.PING).parquet(str(tmp_path / "out")).collect()))
        time.sleep(0.1)
    once = [("v", "a"), ("v", "b"), ("w", "a")]
    assert found == [once, once, sorted(once * 2)]


def test_supervised_restarts():
    """Fails twice, then ends; a third failure would be raised."""
    tries = []

    class Query:
        def awaitTermination(self):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError("lost")

    pipeline.supervised(Query, restarts=2, pause_s=0)
    assert len(tries) == 3
    tries.clear()
    with pytest.raises(RuntimeError):
        pipeline.supervised(Query, restarts=1, pause_s=0)


class Cells:
    """Stands in for a processor's state."""

    def __init__(self):
        self.map, self.value = {}, None

    def getMapState(self, *a, **k):
        return self

    def getValueState(self, *a):
        cell = Cells()
        cell.exists = lambda: cell.value is not None
        cell.get = lambda: cell.value
        cell.update = lambda v: setattr(cell, "value", v)
        return cell

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def iterator(self):
        return iter(list(self.map.items()))

    def removeKey(self, k):
        del self.map[k]


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_first_arrivals_processor():
    handle, p = Cells(), pipeline.FirstArrivals(ttl_ms=100, cleanup_ms=1000, live=3)
    p.init(handle)
    take = lambda now, *ids: [r["event_id"] for r in p.handleInputRows(("v",), iter([{"event_id": i} for i in ids]), Clock(now))]
    assert take(0, "a", "a", "b") == ["a", "b"]
    assert take(100, "a") == []  # still alive, and not extended
    assert take(101, "a") == ["a"]
    assert take(1200, "c", "d", "e") == ["c", "d", "e"] and len(handle.map) == 3


def test_close_by_the_clock():
    """A silent segment closes hold_ms after its recovery arrived; a metric that is due first closes by event time."""
    timers = []

    class Handle(Cells):
        def registerTimer(self, at):
            timers.append(at)

        def deleteTimer(self, at):
            timers.remove(at)

    class Expired:
        def getExpiryTimeInMs(self):
            return timers.pop()

    def metric(end, count, speed):
        return {"window_end_ms": end, "ping_count": count, "avg_speed_mps": speed}

    p = pipeline.IncidentsByClock(fsm.Rules())
    p.init(Handle())
    take = lambda now, *rows: [(r["status"], r["end_ts"]) for r in p.handleInputRows(("s",), iter(rows), Clock(now))]
    assert take(5, metric(10_000, 8, 24.0), metric(20_000, 9, 14.0)) == [("open", 0)] and timers == []
    assert take(7, metric(30_000, 8, 21.0)) == [] and timers == [10_007]
    assert [(r["status"], r["end_ts"]) for r in p.handleExpiredTimer(("s",), None, Expired())] == [("closed", 40_000)] and timers == []
    assert take(20, metric(50_000, 9, 10.0), metric(60_000, 9, 24.0)) == [("open", 0)] and timers == [10_020]
    assert take(30, metric(80_000, 9, 24.0)) == [("closed", 70_000)] and timers == []
