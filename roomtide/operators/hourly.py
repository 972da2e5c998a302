"""Silver rows -> one KPI row per room, sensor type and hour."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide import schemas
from roomtide.functions import quality
from roomtide.functions.timeline import hour_of
from roomtide.sources.tables import on_date


def hourly_metrics(silver: DataFrame, event_date: str | date | None = None) -> DataFrame:
    """Hourly KPIs of one day, or of every row.

    Each aggregate has a partial form, so a task sends at most one row per group to the
    shuffle however many readings one sensor has.
    """
    rows = silver if event_date is None else on_date(silver, event_date)
    value = F.col("value_clean")
    hours = rows.groupBy(
        "room", "sensor_type", "event_date", hour_of(F.col("ts_utc")).alias("hour_utc")
    ).agg(
        F.count("*").alias("nb_readings"),
        F.count_if(F.col("is_valid")).alias("nb_valid"),
        F.count_if(~F.col("is_valid")).alias("nb_invalid"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.avg(value).alias("value_avg"),
        F.stddev_samp(value).alias("value_std"),
    )
    return flagged_hours(hours)


def flagged_hours(hours: DataFrame) -> DataFrame:
    """Counts and statistics of hours, with their valid share and flag, as hourly KPIs."""
    share = quality.valid_share(F.col("nb_valid"), F.col("nb_readings"))
    return (
        hours.withColumn("pct_valid", share)
        .withColumns(
            {
                "quality_flag_hour": quality.hour_flag(F.col("pct_valid")),
                "created_at": F.current_timestamp(),
            }
        )
        .select(*schemas.HOURLY.fieldNames())
    )
