import pytest

from tarmac.operators import parse

GOOD = '{"vehicleId":"v","eventId":"e","timestampMs":5,"lat":1.5,"lon":-2,"speedMps":3}'


def one(spark, text):
    return parse.parsed(spark.createDataFrame([(text,)], "value string")).first()


@pytest.mark.parametrize(
    "text,outcome",
    [
        (GOOD, "ok"), ("{bad", "parse_error"), (None, "parse_error"), ("", "invalid"), ("  ", "invalid"), ("null", "invalid"), ("[1,2]", "invalid"), ("{}", "invalid"),
        (GOOD.replace('"lat":1.5,', ""), "invalid"), (GOOD.replace('"v"', '""'), "invalid"), (GOOD.replace('"timestampMs":5', '"timestampMs":0'), "invalid"),
        (GOOD.replace('"timestampMs":5', '"timestampMs":null'), "invalid"), (GOOD.replace('"e"', '{"a":1}'), "invalid"), (GOOD[:-1] + ',"more":[1]}', "ok"),
    ],
)
def test_outcomes(spark, text, outcome):
    assert one(spark, text)["outcome"] == outcome


@pytest.mark.parametrize(
    "field,given,column,expected",
    [
        ('"v"', "7", "vehicle_id", "7"), ('"v"', "null", "vehicle_id", "null"), ('"speedMps":3', '"speedMps":"3.5"', "speed_mps", 3.5), ('"speedMps":3', '"speedMps":"fast"', "speed_mps", 0.0),
        ('"speedMps":3', '"speedMps":null', "speed_mps", 0.0), ('"speedMps":3', '"speedMps":true', "speed_mps", 1.0), ('"timestampMs":5', '"timestampMs":12.7', "timestamp_ms", 12), ('"timestampMs":5', '"timestampMs":"12.7"', "timestamp_ms", 12),
        ('"speedMps":3', '"speedMps":[3]', "speed_mps", 0.0),
    ],
)
def test_coercions(spark, field, given, column, expected):
    row = one(spark, GOOD.replace(field, given))
    assert row["outcome"] == "ok" and row[column] == expected


def test_counts_and_strict_metrics(spark):
    raw = spark.createDataFrame([(GOOD,), ("{bad",), ("{}",), ("{}",)], "value string")
    assert tuple(parse.drop_counts(raw).first()) == (1, 2, 1)
    assert parse.pings(raw, observe="drops").count() == 1
    wire = '{"segmentId":"a","windowStartMs":0,"windowEndMs":10,"count":3,"avgSpeedMps":2.5,"minSpeedMps":1,"maxSpeedMps":4,"new":1}'
    assert tuple(parse.metrics(spark.createDataFrame([(wire,)], "value string")).first()) == ("a", 0, 10, 3, 2.5, 1.0, 4.0)
    assert parse.metrics(spark.createDataFrame([('{"segmentId":"a"}',)], "value string")).first()["ping_count"] == 0
    with pytest.raises(Exception):
        parse.metrics(spark.createDataFrame([("{bad",)], "value string")).collect()
