"""The `events` table seen as sensor traffic: messages, bronze rows or raw CSV rows.

Every event becomes one message. Users fold into five rooms and event types into sensor types;
room 105 has neither a CO2 nor a temperature sensor and reports noise instead. Time runs ten
times faster from 2013-08-23 on, so that an hour holds several readings of a sensor. FIXTURES.md
lists the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtide.config import child
from roomtide.functions import messages
from roomtide.functions.lookup import lookup

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
_FIRST_EVENT, _FIRST_READING, _SPEED = 1_704_067_200, 1_377_216_000, 10

# An entry has about so many part files, and so several splits.
_PARTS, _ENTRIES = 3, 23

_FILE_NAMES = {
    "co2": "CO2",
    "pir": "motion",
    "luminosity": "Light_sensor",
    "temperature": "temp",
    "humidity": "rH",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(child(sf_dir, "events.parquet"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a file stream; the glob also matches a folder of part files."""
    return spark.readStream.schema(EVENTS).parquet(child(sf_dir, "events.parquet*"))


def _sensor(fold: Column) -> Column:
    kind = F.col("event_type")
    in_last_room = fold == 4
    return (
        F.when(in_last_room & kind.isin("click", "signup"), "noise")
        .when(kind == "click", "co2")
        .when(kind == "error", "pir")
        .when(kind == "purchase", "luminosity")
        .when(kind == "signup", "temperature")
        .otherwise("humidity")
    )


def _value(fold: Column) -> Column:
    kind, v = F.col("event_type"), F.col("value")
    return (
        F.when((fold == 4) & kind.isin("click", "signup"), v)
        .when(kind == "click", 300 + 10 * v)
        .when(kind == "error", F.when(v >= 35, 1.0).otherwise(0.0))
        .when(kind == "purchase", 10 * v)
        .when(kind == "signup", 15 + v / 5)
        .otherwise(v)
    )


def readings(event_rows: DataFrame) -> DataFrame:
    """(event_id, logged, room, sensor, ts, value); 0 to 40 % of a room's values are NULL."""
    fold = F.col("user_id") % 5
    logged = F.col("ts").cast("timestamp")
    elapsed = F.unix_seconds(logged) - _FIRST_EVENT
    present = F.col("event_id") % 10 >= fold
    return event_rows.select(
        "event_id",
        logged.alias("logged"),
        (F.lit(101) + fold).cast("string").alias("room"),
        _sensor(fold).alias("sensor"),
        (F.lit(_FIRST_READING) + F.floor(elapsed / _SPEED)).alias("ts"),
        F.when(present, _value(fold)).alias("value"),
    )


def envelope(event_rows: DataFrame) -> DataFrame:
    """The readings as the message log delivers them."""
    room, sensor = F.col("room"), F.col("sensor")
    return readings(event_rows).select(
        messages.message_key(room, sensor).cast("binary").alias("key"),
        messages.message_json(room, sensor, F.col("ts"), F.col("value"))
        .cast("binary")
        .alias("value"),
        messages.message_topic(sensor).alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("logged").alias("timestamp"),
    )


def raw_files(event_rows: DataFrame) -> DataFrame:
    """The readings as raw rows (room, sensor, file, line, ts_raw, value_raw).

    Clocks are written in seconds, milliseconds or microseconds in turn, and rows come slightly
    out of order, so that a file's clock also steps back.
    """
    number = F.col("event_id")
    epoch = (
        F.when(number % 3 == 0, F.col("ts"))
        .when(number % 3 == 1, F.col("ts") * 1000 + number % 1000)
        .otherwise(F.col("ts") * 1_000_000 + number % 1_000_000)
    )
    return readings(event_rows).select(
        "room",
        "sensor",
        F.concat(lookup(F.col("sensor"), _FILE_NAMES, "noise"), F.lit(".csv")).alias("file"),
        (number - 2 * (number % 8) + 7).alias("line"),
        epoch.cast("string").alias("ts_raw"),
        F.col("value").cast("string").alias("value_raw"),
    )


def write_raw_files(event_rows: DataFrame, root: str) -> None:
    """The raw rows as CSV entries `<root>/room=<room>/file=<name>.csv`: folders of part files whose
    names, and the lines in them, are in line order."""
    part_rows = event_rows.count() // (_PARTS * _ENTRIES) + 1
    (
        raw_files(event_rows)
        .repartition("room", "file")
        .sortWithinPartitions("room", "file", "line")
        .drop("sensor", "line")
        .write.option("maxRecordsPerFile", part_rows)
        .partitionBy("room", "file")
        .csv(root)
    )
