"""The jobs by files, end to end, and their options."""

import pytest

from tarmac import schemas
from tarmac.operators import fsm, parse
from tarmac.sources import pings as sources
from tarmac.streaming import jobs, pipeline


def test_options():
    o = jobs.Options.read(["--min-count", "4", "--alpha=0.5", "--exact-dedup"], {"ALPHA": "0.9", "CLOSE_RATIO": "0.95", "WINDOW": "  "})
    assert (o.min_count, o.alpha, o.close_ratio, o.window, o.exact_dedup) == (4, 0.5, 0.95, "10 seconds", True)
    assert jobs.Options.read([], {}).rules == fsm.Rules()
    with pytest.raises(ValueError):
        jobs.Options.read(["--odd", "1"], {})


def test_jobs_by_files(spark, tmp_path):
    pipeline.with_state_store(spark)
    lines = [(s, t, speed) for t, speed in [(1000, 24.0), (11000, 24.0), (21000, 10.0), (31000, 24.0), (41000, 24.0), (61000, 24.0), (91000, 24.0)] for s in range(4)]
    pings = spark.createDataFrame([(f"v{s}", f"e{t}-{s}", 1710000000000 + t, 47.61, -122.33, speed) for s, t, speed in lines], "vehicle_id string, event_id string, timestamp_ms long, lat double, lon double, speed_mps double")
    path = lambda x: str(tmp_path / x)
    sources.to_json(pings).coalesce(1).write.text(path("pings"))
    run = lambda job, a, b: jobs.JOBS[job](spark, jobs.Options(source=path(a), sink=path(b), checkpoint=path(b + "-state"), every="once")).awaitTermination()
    run("metrics", "pings", "metrics")
    run("incidents", "metrics", "incidents")
    run("tables", "incidents", "tables")
    sink = pipeline.Tables(path("tables"))
    history = {(r.status, r.start_ts, r.end_ts) for r in sink.history(spark).collect()}
    assert history == {("open", 1710000030000, 0), ("closed", 1710000030000, 1710000050000)} and sink.current(spark).count() == 0
    assert jobs.producer_counts(pings).agg({"records": "sum"}).first()[0] == len(lines)


def test_producer_counts(spark):
    """Marked records are counted wherever the generator starts."""
    for start in (1_710_000_000_000, 1_710_000_000_123):
        made = sources.generated(spark, 40, start, marked=True)
        found = jobs.producer_counts(made).agg({"late": "sum", "duplicates": "sum", "records": "sum"}).first()
        assert found["sum(late)"] == made.where("late").count() > 0 and found["sum(records)"] == made.count()
    assert sources.to_json(made, keyed=True).columns == ["key", "value"]


def test_golden_story_from_files(spark, tmp_path):
    """One multi-line object a file, read as metrics, through the state machine."""
    ends = [(1710000010000, 8, 24.0), (1710000020000, 8, 23.5), (1710000030000, 9, 14.0), (1710000050000, 8, 21.0), (1710000080000, 8, 24.0)]
    for k, (end, n, speed) in enumerate(ends):
        text = f'{{\n  "segmentId": "I5-NB-42",\n  "windowStartMs": {end - 10000},\n  "windowEndMs": {end},\n  "count": {n},\n  "avgSpeedMps": {speed},\n  "minSpeedMps": {speed - 2},\n  "maxSpeedMps": {speed + 2}\n}}\n'
        (tmp_path / f"{k}.json").write_text(text)
    metrics = parse.metrics(sources.json_lines(spark, str(tmp_path), multiline=True))
    assert sources.json_objects(spark, str(tmp_path), schemas.METRIC_JSON).count() == metrics.count() == 5
    found = [(r.status, r.start_ts, r.end_ts, r.severity, round(r.baseline_speed_mps, 2)) for r in fsm.incidents(metrics).orderBy("end_ts").collect()]
    assert found == [("open", 1710000030000, 0, 3.3, 21.92), ("closed", 1710000030000, 1710000060000, 0.3, 21.92)]
