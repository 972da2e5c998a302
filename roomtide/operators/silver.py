"""Bronze rows -> silver rows: repaired identifiers, clean values, units, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.functions import quality, text
from roomtide.functions.timeline import seconds_to_timestamp


def to_silver(bronze: DataFrame) -> DataFrame:
    """One projection, no shuffle.

    `bronze` must say in `source_file` which file a row came from, as `tables.read_bronze` does;
    NULL where there is no file.
    """
    if "source_file" not in bronze.columns:
        raise ValueError("bronze rows need a source_file; see tables.read_bronze")
    source_file = F.col("source_file")
    raw_is_text = dict(bronze.dtypes)["value"] == "string"
    clean = quality.clean_text if raw_is_text else quality.clean_number

    repaired = bronze.select(
        F.coalesce("room", text.room_from_path(source_file)).alias("room"),
        F.coalesce(F.lower("sensor"), text.sensor_from_topic(F.col("topic"))).alias("sensor_type"),
        F.col("ts_unix").cast("bigint").alias("ts_unix"),
        F.to_date("event_ts").alias("event_date"),
        F.col("value").cast("string").alias("value_raw"),
        clean(F.col("value")).alias("value_clean"),
        source_file.alias("source_file"),
    )
    return repaired.select(
        "room",
        "sensor_type",
        F.concat_ws("-", "room", "sensor_type").alias("sensor_id"),
        "ts_unix",
        seconds_to_timestamp(F.col("ts_unix")).alias("ts_utc"),
        "event_date",
        "value_raw",
        "value_clean",
        quality.unit_of(F.col("sensor_type")).alias("unit"),
        F.col("value_clean").isNotNull().alias("is_valid"),
        quality.row_flag(F.col("value_clean")).alias("quality_flag"),
        F.current_date().alias("ingest_date"),
        "source_file",
        F.current_timestamp().alias("created_at"),
    )


def quality_by_sensor(silver: DataFrame) -> DataFrame:
    """Reading counts per sensor type and quality flag."""
    return silver.groupBy("sensor_type", "unit", "quality_flag").agg(
        F.count("*").alias("nb_readings"), F.count_if("is_valid").alias("nb_valid")
    )
