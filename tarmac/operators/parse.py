"""Raw JSON to valid pings, tolerant; JSON to metrics, strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac import schemas

#: (field of the wire form, our column, type)
FIELDS = [("vehicleId", "vehicle_id", "string"), ("eventId", "event_id", "string"), ("timestampMs", "timestamp_ms", "bigint"), ("lat", "lat", "double"), ("lon", "lon", "double"), ("speedMps", "speed_mps", "double")]


def field(variant: str, kind: str) -> Column:
    """A field's variant, coerced as a tolerant reader does: null, text that is no number, lists and objects read as 0;
    null reads as the text null, lists and objects as no text. Absent fields are null."""
    if kind == "string":
        text = F.expr(f"try_variant_get({variant}, '$', 'string')")
        # What looks like a list or an object may be a text that begins like one; only then its type is asked for.
        nested = text.rlike(r"^[\[{]") & F.expr(f"schema_of_variant({variant}) rlike '^(ARRAY|OBJECT|STRUCT)'")
        return F.when(F.expr(f"is_variant_null({variant})"), F.lit("null")).when(F.coalesce(nested, F.lit(False)), F.lit("")).otherwise(text)
    number = F.expr(f"try_variant_get({variant}, '$', 'double')")
    whole = F.expr(f"try_variant_get({variant}, '$', 'bigint')")
    value = F.coalesce(whole, number.try_cast("bigint"), F.lit(0).cast("bigint")) if kind == "bigint" else F.coalesce(number, F.lit(0.0))
    return F.when(F.col(variant).isNotNull(), value)


def parsed(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Every record with its ping fields and outcome: ok, parse_error (no JSON), or invalid (a field is absent, an id is
    empty or the time isn't positive). Nothing fails the job."""
    read = raw.withColumn("v", F.expr(f"try_parse_json({value_col})"))
    apart = read.select(*raw.columns, "v", *(F.expr(f"try_variant_get(v, '$.{name}', 'variant')").alias(f"__{column}") for name, column, _ in FIELDS))
    fields = apart.select(*raw.columns, "v", *(field(f"__{column}", kind).alias(column) for _, column, kind in FIELDS))
    whole = F.lit(True)
    for _, column, _ in FIELDS:
        whole = whole & F.col(column).isNotNull()
    sound = whole & (F.col("vehicle_id") != "") & (F.col("event_id") != "") & (F.col("timestamp_ms") > 0)
    empty = F.trim(F.col(value_col)) == ""
    outcome = F.when(F.col(value_col).isNull() | (F.col("v").isNull() & ~empty), "parse_error").when(F.coalesce(sound, F.lit(False)), "ok").otherwise("invalid")
    # One explode of plain columns, behind which no filter on the outcome copies the reading of every field.
    made = [*(F.col(c) for _, c, _ in FIELDS), outcome.alias("outcome")]
    return fields.select(*raw.columns, F.explode(F.array(F.struct(*made))).alias("__s")).select(*raw.columns, "__s.*")


def pings(raw: DataFrame, value_col: str = "value", observe: str | None = None) -> DataFrame:
    """The valid pings; with observe, drop counters are reported under that name while the query runs."""
    all_rows = parsed(raw, value_col)
    if observe:
        count = lambda kind: F.count(F.when(F.col("outcome") == kind, 1)).alias(kind)
        all_rows = all_rows.observe(observe, count("parse_error"), count("invalid"))
    return all_rows.where("outcome = 'ok'").select(*(c for _, c, _ in FIELDS))


def drop_counts(raw: DataFrame, value_col: str = "value") -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("outcome") == kind, 1))
    return parsed(raw, value_col).agg(count("parse_error").alias("parse_errors"), count("invalid").alias("invalid_dropped"), count("ok").alias("kept"))


def metrics(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Metrics from their wire form; anything malformed fails the job."""
    read = raw.select(F.from_json(value_col, schemas.METRIC_JSON, {"mode": "FAILFAST"}).alias("m"))
    names = [x.split()[0] for x in schemas.METRIC_JSON.split(", ")]
    return read.select(*(F.coalesce(f"m.{a}", F.lit(0).cast(b.split()[1])).alias(b.split()[0]) if "string" not in b else F.col(f"m.{a}").alias(b.split()[0]) for a, b in zip(names, schemas.METRIC.split(", "), strict=True)))
