"""Hourly KPIs -> one row per room and day.

`daily_room_metrics` reads the hours once and aggregates once. `daily_by_joins` builds a frame
per sensor type and joins them; it is the textbook form, kept to check the first against.

They agree because the frame of the quality score covers every sensor type: its rooms and days
include those of all the others, so the outer joins never add a key, and a sensor type a room
lacks gives NULL in both forms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide import constants as C
from roomtide import schemas
from roomtide.functions import quality

KEYS = ["room", "event_date"]

# Restricts a column to the hours a measure is about.
Pick = Callable[[Column], Column]


def _weighted_mean(pick: Pick) -> Column:
    """Mean over readings: hourly means weighted by their valid readings. NULL if there are none."""
    weight = F.col("nb_valid")
    return F.try_divide(
        F.sum(pick(F.col("value_avg") * weight)), F.sum(pick(weight))
    )


def _plain_mean(pick: Pick) -> Column:
    return F.avg(pick(F.col("value_avg")))


def _lowest(pick: Pick) -> Column:
    return F.min(pick(F.col("value_min")))


def _highest(pick: Pick) -> Column:
    return F.max(pick(F.col("value_max")))


def _share_of_hours(holds: Column) -> Callable[[Pick], Column]:
    """Share of hours where `holds`; an hour without a valid reading counts as one where not."""
    hit = F.when(holds, F.lit(1.0)).otherwise(F.lit(0.0))
    return lambda pick: F.avg(pick(hit))


def _measures() -> dict[str, dict[str, Callable[[Pick], Column]]]:
    mean = F.col("value_avg")
    return {
        "temperature": {
            "temp_avg": _weighted_mean,
            "temp_min": _lowest,
            "temp_max": _highest,
            "temp_comfort_ratio": _share_of_hours(mean.between(*C.TEMPERATURE_BAND)),
        },
        "co2": {
            "co2_avg": _weighted_mean,
            "co2_max": _highest,
            "co2_above_1000_ratio": _share_of_hours(mean > C.CO2_ALARM),
        },
        "humidity": {
            "humidity_avg": _weighted_mean,
            "humidity_in_range_ratio": _share_of_hours(mean.between(*C.HUMIDITY_BAND)),
        },
        "luminosity": {
            "luminosity_avg": _weighted_mean,
            "luminosity_min": _lowest,
            "luminosity_max": _highest,
        },
        "pir": {"occupancy_rate": _plain_mean},
    }


def _quality_score() -> Column:
    """Every sensor type counts, unknown ones too, and every hour counts the same."""
    return quality.percent(F.avg("pct_valid")).alias("data_quality_score")


def _scored(days: DataFrame) -> DataFrame:
    comfort = quality.comfort_score(
        F.col("temp_comfort_ratio"),
        F.col("co2_above_1000_ratio"),
        F.col("humidity_in_range_ratio"),
    )
    return days.withColumns(
        {"comfort_score": comfort, "created_at": F.current_timestamp()}
    ).select(*schemas.DAILY.fieldNames())


def _only(sensor: str) -> Pick:
    return lambda column: F.when(F.col("sensor_type") == sensor, column)


def daily_room_metrics(hourly: DataFrame) -> DataFrame:
    measures = [
        measure(_only(sensor)).alias(name)
        for sensor, named in _measures().items()
        for name, measure in named.items()
    ]
    return _scored(hourly.groupBy(*KEYS).agg(*measures, _quality_score()))


def daily_by_joins(hourly: DataFrame) -> DataFrame:
    """Same result by five full outer joins. Reads `hourly` six times; pass a stored table."""
    frames = [
        hourly.where(F.col("sensor_type") == sensor)
        .groupBy(*KEYS)
        .agg(*[measure(lambda column: column).alias(name) for name, measure in named.items()])
        for sensor, named in _measures().items()
    ]
    frames.append(hourly.groupBy(*KEYS).agg(_quality_score()))
    return _scored(reduce(lambda left, right: left.join(right, KEYS, "outer"), frames))
