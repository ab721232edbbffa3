import datetime as dt

import pytest

from tarmac import schemas
from tarmac.functions import scalars as S
from tarmac.operators import dedup, tables, windows
from tarmac.plans import dashboard, views
from tarmac.sources import pings as sources

BASE = 1710000000000  # 2024-03-09T16:00Z


def at(minute):
    return dt.datetime(2024, 3, 9, 16, 0, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def history(spark, *rows):
    """(id, segment, status, start minute, end minute or None, ingested minute)"""
    full = [(i, s, st, BASE + a * 60000, 0 if b is None else BASE + b * 60000, 4.25, 20.0, 10.0, 5, at(g)) for i, s, st, a, b, g in rows]
    return spark.createDataFrame(full, schemas.HISTORY)


def one(spark, expr, **values):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize("text,view,sink", [("close", "closed", "closed"), ("closed", "closed", "closed"), (" CLOSE ", "closed", " CLOSE "), ("open", "open", "open"), ("odd", "open", "odd"), (None, "open", None)])
def test_status(spark, text, view, sink):
    df = spark.createDataFrame([(text,)], "s string")
    assert tuple(df.select(S.normalized_status("s"), S.sink_status("s")).first()) == (view, sink)


@pytest.mark.parametrize("x,floor_form,python_form", [(0.15, 0.2, 0.1), (0.25, 0.3, 0.2), (3.45, 3.5, 3.5), (32.55, 32.6, 32.5), (None, None, None)])
def test_rounding(spark, x, floor_form, python_form):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(S.round1("x")).first()[0] == floor_form and df.select(S.python_round1("x")).first()[0] == python_form


@pytest.mark.parametrize("text,ms", [("1710000000000", BASE), ("2024-03-09T16:00:00Z", BASE), ("2024-03-09T16:02:00+00:00", BASE + 120000), ("2024-03-09T16:00:00", BASE), ("soon", None), (None, None)])
def test_times(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(S.text_to_ms("t")).first()[0] == ms


def test_iso(spark):
    df = spark.createDataFrame([(BASE,), (BASE + 7,), (None,)], "t long").select(S.ms_to_iso("t"))
    assert [r[0] for r in df.collect()] == ["2024-03-09T16:00:00+00:00", "2024-03-09T16:00:00.007000+00:00", None]


def test_segment_and_box(spark):
    df = spark.createDataFrame([(47.6105, -122.3305), (47.605, -122.325), (0.0, -0.0001)], "lat double, lon double")
    assert [tuple(r) for r in df.select(S.segment_id("lat", "lon"), S.in_box("lat", "lon")).collect()] == [("seg_47610_-122331", True), ("seg_47605_-122325", True), ("seg_0_-1", False)]


def test_merge_prefers_closed(spark):
    raw = views.history_raw(history(spark, ("inc_1", "seg_a", "open", 0, None, 1), ("inc_1", "seg_a", "close", 0, 3, 3)))
    (row,) = views.history_distinct(raw).collect()
    assert (row.status, row.closed_at, row.start_ts) == ("closed", "2024-03-09T16:03:00+00:00", BASE)


def test_raw_hides_close_times_of_open_rows(spark):
    rows = views.history_raw(history(spark, ("inc_1", "seg_a", "close", 0, 2, 2), ("inc_1", "seg_a", "open", 0, None, 0))).collect()
    assert [r.status for r in rows] == ["closed", "open"] and rows[1].closed_at is None and rows[1].end_ts is None


def test_since_and_limits(spark):
    h = history(spark, ("a", "s", "open", 0, None, 0), ("b", "s", "closed", 0, 9, 9), ("c", "t", "open", 5, None, 5))
    assert {r.incident_id for r in views.history_raw(h, since_ms=BASE + 5 * 60000).collect()} == {"b", "c"}
    assert [r.incident_id for r in views.history_raw(h, limit=1).collect()] == ["b"]
    for bad in (dict(limit=0), dict(limit=5001)):
        with pytest.raises(ValueError):
            views.history_raw(h, **bad)
    with pytest.raises(ValueError):
        views.recent(0, 1441)


def test_rows_without_an_id_stay_apart(spark):
    h = views.history_raw(history(spark, ("", "s", "open", 0, None, 0), ("", "s", "open", 1, None, 1)))
    assert sorted(r.incident_id for r in views.history_distinct(h).collect()) == ["_row_0", "_row_1"]


def test_overview(spark):
    h = history(spark, ("inc_1", "seg_a", "open", 4, None, 4), ("inc_1", "seg_a", "closed", 4, 5, 5), ("inc_2", "seg_b", "open", -10, None, -10))
    current = views.current_view(tables.current(h))
    row = views.overview_of_rows(current, views.history_raw(h), BASE + 5 * 60000).first()
    assert (row.active_incidents, row.opened_recently, row.history_event_rows, row.history_incidents, row.top_segment, row.top_segment_incident_count) == (1, 1, 3, 2, "seg_b", 1)
    nested = views.card_metrics(views.overview(tables.current(h), h, BASE + 5 * 60000)).first()
    assert nested.card_metrics.top_segment == "seg_b" and nested.most_affected_segment.incident_count == 1


def test_empty_tables(spark):
    h = history(spark)
    assert tuple(views.summary_current(tables.current(h)).first()) == (0, 0.0)
    assert views.overview(tables.current(h), h, BASE).first().top_segment is None
    assert [r.incidents for r in dashboard.severity_histogram(views.history_raw(h)).collect()] == [0] * 5


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(x, "open") for x in (0.0, 1.9, 2.0, 4.0, 6.0, 7.9, 8.0, 10.0)] + [(3.0, "closed")], "severity double, status string")
    assert [r.incidents for r in dashboard.severity_histogram(rows).collect()] == [2, 1, 1, 2, 2]


def test_dedup_ttl(spark):
    rows = spark.createDataFrame([("v", "e", t) for t in (0, 400, 900, 1000, 1501, 1502)] + [("w", "e", 5)], "vehicle_id string, event_id string, at long")
    kept = dedup.first_arrivals(rows, "at", ttl_ms=500).collect()
    assert sorted((r.vehicle_id, r["at"]) for r in kept) == [("v", 0), ("v", 900), ("v", 1501), ("w", 5)]
    assert dedup.first_arrivals(rows, "at").count() == dedup.first_arrivals(rows).count() == 2


def test_generator_repeats_itself(spark):
    a, b = (sources.generated(spark, 30, slices=k) for k in (1, 7))
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect())) and 1500 <= len(rows) <= 1600
    assert sources.to_json(a).count() == len(rows)
    assert windows.segment_metrics(a.withColumn("segment_id", S.segment_id("lat", "lon"))).groupBy().sum("ping_count").first()[0] == len(rows)


def test_history_constraints(spark):
    h = history(spark, ("a", "s", "open", 0, None, 0), ("a", "s", "open", 0, None, 1), ("b", None, "open", 0, None, 0), ("c", "s", "odd", 0, None, 0))
    assert sorted(r.broken for r in tables.violations(h).collect()) == ["not null", "status", "unique", "unique"]
    assert tables.history(h.drop("ingested_at")).count() == 1
