"""Where pings come from: JSON lines, Kafka, the events table, a generator."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import scalars as S

#: Fixed values of the generator: vehicles; start box (centre, half width) by latitude and longitude.
VEHICLES = 50
START_BOX = ((47.61, 0.02), (-122.33, 0.03))


def json_lines(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None, multiline: bool = False) -> DataFrame:
    """Raw records as value STRING, one a line, or with multiline one a file; as a stream, so many new files a batch. Without a number a batch takes all
    new files, which keeps together what one batch of an earlier job wrote: its files are in no order of event time."""
    if stream:
        reader = spark.readStream if files_per_trigger is None else spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        return reader.text(path, wholetext=multiline)
    return spark.read.text(path, wholetext=multiline)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), slices: int = 1) -> DataFrame:
    """A database's table, for instance the history where another service keeps it; by ranges of a numeric key in so many reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=slices)
    return reader.load()


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, over several lines."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def kafka(spark: SparkSession, servers: str, topic: str, group: str, earliest: bool = False, batch: bool = False) -> DataFrame:
    """value STRING of a topic; needs Spark's Kafka connector on the class path. Jobs start at latest, sinks at earliest."""
    reader = spark.read if batch else spark.readStream
    start = "earliest" if earliest or batch else "latest"
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": start}
    return reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def from_events(events: DataFrame) -> DataFrame:
    """The events table as pings: users drive vehicles, values are speeds, ids give places in the start box."""
    step = lambda k: (F.pmod(F.col("event_id") * k, F.lit(81)) - 40).cast("double")
    return events.select(
        F.concat(F.lit("veh-"), F.pmod("user_id", F.lit(50)).cast("string")).alias("vehicle_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        (F.lit(47.61) + step(37) * F.lit(0.0005)).alias("lat"),
        (F.lit(-122.33) + step(53) * F.lit(0.00075)).alias("lon"),
        F.col("value").alias("speed_mps"),
        "event_type",
    )


def _uniform(salt: int, low: float = 0.0, high: float = 1.0):
    """A repeatable draw for each (vehicle, tick)."""
    return F.lit(low) + F.lit(high - low) * F.pmod(F.xxhash64("vehicle", "tick", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def generated(spark: SparkSession, ticks: int, start_ms: int = 1_710_000_000_000, vehicles: int = VEHICLES, accident_start_s: int = 60, duplicates: float = 0.02, late: float = 0.02, slices: int | None = None, marked: bool = False) -> DataFrame:
    """Pings of random walks, a tick a second: slow in the accident box from accident_start_s on, some twice, some moved back in time.

    Every draw is a hash of vehicle and tick, so that a lost task makes the same rows again. A walk is a sum of three waves
    of its own periods, which needs no state between ticks. marked: a column late tells which records were moved back.
    """
    rows = spark.range(0, ticks * vehicles, 1, slices).select((F.col("id") % vehicles).alias("vehicle"), F.floor(F.col("id") / vehicles).alias("tick"))
    own = lambda salt: F.pmod(F.xxhash64("vehicle", F.lit(salt)), F.lit(1000)) / F.lit(1000.0)

    def walk(salt: int, centre: float, width: float):
        waves = sum(F.sin(F.col("tick") * F.lit(2 * math.pi) / (F.lit(120.0 * 3**k) * (own(salt + k) + 0.5)) + own(salt + 10 + k) * 7.0) for k in range(3))
        return F.lit(centre) + waves / 3.0 * width

    placed = rows.withColumns({"lat": walk(1, *START_BOX[0]), "lon": walk(31, *START_BOX[1])})
    slow = S.in_box("lat", "lon") & (F.col("tick") >= accident_start_s)
    speed = _uniform(71, 10.0, 30.0) * F.when(slow, _uniform(72, 0.05, 0.25)).otherwise(F.lit(1.0))
    back = F.when(_uniform(73) < late, _uniform(74, 500.0, 5000.0)).otherwise(F.lit(0.0)).cast("long")
    pings = placed.select(
        F.concat(F.lit("veh-"), F.col("vehicle")).alias("vehicle_id"), F.md5(F.concat_ws(":", "vehicle", "tick")).alias("event_id"),
        (F.lit(start_ms) + F.col("tick") * 1000 - back).alias("timestamp_ms"), "lat", "lon", speed.alias("speed_mps"), F.when(_uniform(75) < duplicates, 2).otherwise(1).alias("copies"), *([(back > 0).alias("late")] if marked else []),
    )
    return pings.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def to_json(pings: DataFrame, keyed: bool = False) -> DataFrame:
    """Pings in their wire form; keyed: with the vehicle as the record's key, which keeps a vehicle's records in one partition."""
    names = [("vehicle_id", "vehicleId"), ("event_id", "eventId"), ("timestamp_ms", "timestampMs"), ("lat", "lat"), ("lon", "lon"), ("speed_mps", "speedMps")]
    key = [F.col("vehicle_id").alias("key")] if keyed else []
    return pings.select(*key, F.to_json(F.struct(*(F.col(a).alias(b) for a, b in names))).alias("value"))
