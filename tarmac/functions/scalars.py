"""Scalar expressions, all built from Spark's own functions, so that they stay in generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MPH_PER_MPS = 2.2369362920544
#: 1971-01-01 in epoch milliseconds: earlier close times stand for none.
EARLIEST_CLOSE_MS = 31_536_000_000
#: Inclusive corners of the generator's accident box: latitudes, longitudes.
ACCIDENT_BOX = ((47.605, 47.615), (-122.340, -122.325))
CLOSED_WORDS = ("close", "closed")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segment_id(lat: Column | str, lon: Column | str) -> Column:
    """The grid cell of a thousandth of a degree, floored towards minus infinity."""
    cell = lambda x: F.floor(col(x) * F.lit(1000.0)).cast("string")
    return F.concat(F.lit("seg_"), cell(lat), F.lit("_"), cell(lon))


def in_box(lat: Column | str, lon: Column | str, box=ACCIDENT_BOX) -> Column:
    return col(lat).between(*box[0]) & col(lon).between(*box[1])


def round1(x: Column | str) -> Column:
    """One decimal, halves up: the same in every engine that has floor."""
    return F.floor(col(x) * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def python_round1(x: Column | str) -> Column:
    """One decimal as Python rounds the binary value; an Arrow function, for parity only."""

    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: round(v, 1), na_action="ignore")

    return rounded(col(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def severity(baseline: Column | str, observed: Column | str, count: Column | str) -> Column:
    """0 to 10: the relative drop below the baseline, weighted by up to ten observations."""
    b, o, n = col(baseline), col(observed), col(count).cast("double")
    drop = clamp((b - o) / b, 0.0, 1.0) * F.least(F.lit(1.0), n / F.lit(10.0)) * F.lit(10.0)
    return F.when(b <= 0, F.lit(0.0)).otherwise(round1(clamp(drop, 0.0, 10.0)))


def to_mph(mps: Column | str, python_rounding: bool = False) -> Column:
    x = col(mps) * F.lit(MPH_PER_MPS)
    return python_round1(x) if python_rounding else round1(x)


def finite(x: Column | str, fallback: float = 0.0) -> Column:
    """x as a double, the fallback where it is missing or no finite number."""
    d = col(x).try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(fallback)).otherwise(d)


def normalized_status(status: Column | str) -> Column:
    """closed for its two spellings, trimmed and in any case; open for anything else."""
    return F.when(F.lower(F.trim(col(status))).isin(*CLOSED_WORDS), F.lit("closed")).otherwise(F.lit("open"))


def sink_status(status: Column | str) -> Column:
    """Only the exact short spelling is mapped; others stay."""
    return F.when(col(status) == "close", F.lit("closed")).otherwise(col(status))


def ms_to_iso(ms: Column | str) -> Column:
    """ISO 8601 in UTC, with microseconds only where there are any."""
    at = F.timestamp_millis(col(ms))
    part = F.pmod(col(ms), F.lit(1000))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("000"))), F.lit("+00:00"))


def text_to_ms(text: Column | str) -> Column:
    """Epoch milliseconds of a numeric string or an ISO time (UTC where it names no zone); null for anything else."""
    s = F.trim(col(text))
    return F.coalesce(s.try_cast("bigint"), F.unix_millis(s.try_cast("timestamp")))


def close_time_missing(ms: Column | str) -> Column:
    return col(ms).isNull() | (col(ms) < EARLIEST_CLOSE_MS)


def severity_badge(x: Column | str) -> Column:
    return F.when(col(x) >= 7, F.lit("high")).when(col(x) >= 4, F.lit("mid")).otherwise(F.lit("low"))


def ema(previous: Column, x: Column, alpha: float = 0.2) -> Column:
    """The literal form, also for the first value, since shortcuts round differently."""
    return F.lit(alpha) * x + F.lit(1.0 - alpha) * F.coalesce(previous, x)


def blank_to_null(x: Column | str) -> Column:
    return F.when(F.trim(col(x)) != "", col(x))


def first_non_blank(*columns: Column | str) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))
