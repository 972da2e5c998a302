"""Hours that can be merged: KPIs of late readings without going back to the day's readings.

A state holds what the KPIs of an hour are computed from. States of the same hour, from any batches in
any order, merge into one: counts add up, extremes are extremes of extremes, and the squared distances
from the common mean are those from the parts' means plus what the parts' means differ from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtide import schemas
from roomtide.functions.timeline import hour_of
from roomtide.operators.hourly import flagged_hours

KEYS = ["room", "sensor_type", "event_date", "hour_utc"]


def hour_states(silver: DataFrame) -> DataFrame:
    """One state for each room, sensor type and hour of the given readings. Readings without a usable
    clock belong to no hour."""
    value = F.col("value_clean")
    dated = silver.where(F.col("event_date").isNotNull())
    states = dated.groupBy(
        "room", "sensor_type", "event_date", hour_of(F.col("ts_utc")).alias("hour_utc")
    ).agg(
        F.count("*").alias("nb_readings"),
        F.count_if("is_valid").alias("nb_valid"),
        F.count_if(~F.col("is_valid")).alias("nb_invalid"),
        F.count(value).alias("nb_values"),
        F.avg(value).alias("value_mean"),
        (F.var_pop(value) * F.count(value)).alias("value_m2"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
    )
    return states.select(*schemas.HOUR_STATE.fieldNames())


def merge_states(states: DataFrame) -> DataFrame:
    """One state an hour. One shuffle: window and aggregate share it."""
    hour = Window.partitionBy(*KEYS)
    n, mean = F.col("nb_values"), F.col("value_mean")
    common = F.try_divide(F.sum(n * mean).over(hour), F.sum(F.when(n > 0, n)).over(hour))
    apart = states.withColumn("common", common).withColumn(
        "value_m2", F.col("value_m2") + n * (mean - F.col("common")) * (mean - F.col("common"))
    )
    merged = apart.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("nb_readings", "nb_valid", "nb_invalid", "nb_values")],
        F.first("common").alias("value_mean"),
        F.sum("value_m2").alias("value_m2"),
        F.min("value_min").alias("value_min"),
        F.max("value_max").alias("value_max"),
    )
    return merged.select(*schemas.HOUR_STATE.fieldNames())


def hours_of_states(merged: DataFrame) -> DataFrame:
    """The hourly KPIs of merged states: the rows of `hourly_metrics`."""
    free = F.col("nb_values") - 1
    spread = F.when(free > 0, F.sqrt(F.col("value_m2") / free))
    return flagged_hours(
        merged.withColumn("value_avg", F.col("value_mean")).withColumn("value_std", spread)
    )
