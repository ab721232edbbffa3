import pytest

from tarmac import schemas
from tarmac.operators import fsm
from tarmac.operators.fsm import Rules, State, advance, fire, incident_id, incidents, severity


def run(*metrics, rules=Rules(), state=None):
    state = state or State()
    return state, [list(advance("seg_a", state, end, n, v, rules)) for end, n, v in metrics]


def test_opens():
    state, (first, second) = run((10000, 8, 24.0), (20000, 9, 14.0))
    assert not first and len(second) == 1
    _, segment, status, start, end, sev, base, speed, n = second[0]
    assert (segment, status, start, end, sev, speed, n) == ("seg_a", "open", 20000, 0, 3.3, 14.0, 9)
    assert base == pytest.approx(22.0)


def test_low_count_does_not_open():
    state, events = run((10000, 8, 24.0), (20000, 2, 14.0))
    assert events == [[], []] and state.baseline == pytest.approx(22.0)


def test_first_metric_cannot_open():
    assert run((10000, 99, 1.0))[1] == [[]]


def test_close_after_hold():
    state, events = run((10000, 8, 24.0), (20000, 9, 14.0), (30000, 8, 21.0))
    assert not events[2] and state.close_at == 40000
    assert fire("seg_a", state, 39999) is None
    closed = fire("seg_a", state, 40000)
    assert closed[2:6] == ("closed", 20000, 40000, 0.4) and state.start is None and state.baseline == pytest.approx(22.0)


def test_relapse_cancels_and_between_ratios_too():
    for speed in (15.0, 18.5):
        state, events = run((10000, 8, 24.0), (20000, 9, 14.0), (30000, 8, 21.0), (40000, 8, speed))
        assert not events[3] and state.close_at is None and state.start == 20000


def test_second_recovery_keeps_the_hold():
    assert run((10000, 8, 24.0), (20000, 9, 14.0), (30000, 8, 21.0), (40000, 8, 21.0))[0].close_at == 40000


def test_ratio_edges():
    # A baseline that stays 100: exactly 80 % doesn't open, exactly 90 % recovers.
    exact = Rules(alpha=0.0)
    assert run((1, 5, 100.0), (2, 5, 80.0), rules=exact)[1] == [[], []]
    assert run((10, 5, 100.0), (20, 5, 79.0), (30, 5, 90.0), rules=exact)[0].close_at == 10030


def test_reopens_with_kept_baseline():
    state, events = run((10000, 8, 24.0), (20000, 9, 14.0), (30000, 8, 21.0), (50000, 8, 21.0), (60000, 8, 10.0))
    assert [e[2] for e in events[3]] == ["closed"] and [e[2] for e in events[4]] == ["open"]


@pytest.mark.parametrize("args,expected", [((20.0, 14.0, 12), 3.0), ((0.0, 14.0, 12), 0.0), ((20.0, 25.0, 12), 0.0), ((20.0, 0.0, 10), 10.0)])
def test_severity(args, expected):
    assert severity(*args) == expected


STORY = [(1710000010000, 8, 24.0), (1710000020000, 8, 23.5), (1710000030000, 9, 14.0), (1710000050000, 8, 21.0)]


def table(spark, rows):
    return spark.createDataFrame([(s, e - 10000, e, n, v, v, v) for s, e, n, v in rows], schemas.METRIC)


def test_story_in_batch(spark):
    end = 1710000065001
    rows = [("I5-NB-42", *m) for m in STORY] + [("other", end, 1, 1.0)]
    found = {e.status: e for e in incidents(table(spark, rows)).collect()}
    opened, closed = found["open"], found["closed"]
    assert (opened.start_ts, opened.end_ts, opened.severity, opened.observed_speed_mps, opened.observed_count) == (1710000030000, 0, 3.3, 14.0, 9)
    assert opened.baseline_speed_mps == pytest.approx(21.92)
    assert (closed.start_ts, closed.end_ts, closed.severity, closed.observed_count) == (1710000030000, 1710000060000, 0.3, 8)
    assert opened.incident_id == closed.incident_id == incident_id("I5-NB-42", 1710000030000)


def test_pending_close_waits_for_the_watermark(spark):
    rows = [("I5-NB-42", *m) for m in STORY] + [("other", 1710000065000, 1, 1.0)]
    assert [e.status for e in incidents(table(spark, rows)).collect()] == ["open"]


def test_nulls_and_no_rows(spark):
    assert incidents(table(spark, [])).collect() == []
    rows = spark.createDataFrame([(None, 0, 10, 5, 1.0, 1.0, 1.0), ("a", 0, None, 5, 1.0, 1.0, 1.0), ("a", 0, 10, None, None, None, None)], schemas.METRIC)
    assert incidents(rows).collect() == []


def test_matches_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    rows = [(f"s{k}", 10000 * (i + 1), rng.randint(1, 12), rng.choice([5.0, 9.0, 14.0, 20.0, 24.0])) for k in range(7) for i in range(60)]
    last = max(r[1] for r in rows)
    expected = []
    for k in range(7):
        state = State()
        for s, e, n, v in (r for r in rows if r[0] == f"s{k}"):
            expected += advance(s, state, e, n, v, Rules())
        if (closed := fire(f"s{k}", state, last - 5001)) is not None:
            expected.append(closed)
    rng.shuffle(rows)
    assert sorted(map(tuple, incidents(table(spark, rows)).collect())) == sorted(expected)
    assert fsm.baselines(table(spark, rows)).count() == len(rows)
