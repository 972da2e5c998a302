"""Queries over the silver table: rooms, sensor types and filtered readings."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide import constants as C
from roomtide import schemas
from roomtide.config import page_size
from roomtide.sources.tables import on_date

# Readings at the same instant are told apart by the remaining columns, so a page is the same
# every time it is asked for.
_ORDER = ["ts_utc", "sensor_id", "value_clean", "room", "sensor_type"]


def _listing(silver: DataFrame, column: str, event_date: str | date | None) -> DataFrame:
    rows = silver if event_date is None else on_date(silver, event_date)
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def rooms(silver: DataFrame, event_date: str | date | None = C.LISTING_DATE) -> DataFrame:
    """Rooms with readings on a day (None: on any day), in ascending order."""
    return _listing(silver, "room", event_date)


def sensor_types(
    silver: DataFrame, event_date: str | date | None = C.LISTING_DATE
) -> DataFrame:
    return _listing(silver, "sensor_type", event_date)


def _instant(bound: str | datetime) -> Column:
    """An ISO instant. Without an offset it is UTC; text that is no instant is an error."""
    stamp = bound.isoformat() if isinstance(bound, datetime) else bound
    return F.lit(stamp).cast("timestamp")


def readings(
    silver: DataFrame,
    event_date: str | date,
    room: str | None = None,
    sensor_type: str | None = None,
    from_ts: str | datetime | None = None,
    to_ts: str | datetime | None = None,
    only_valid: bool = True,
    limit: int = C.DEFAULT_LIMIT,
    max_limit: int = C.MAX_LIMIT,
) -> DataFrame:
    """The earliest readings of one day that meet every given condition, both ends included."""
    most = page_size(limit, max_limit)
    rows = on_date(silver, event_date)
    conditions = [
        None if room is None else F.col("room") == room,
        None if sensor_type is None else F.col("sensor_type") == sensor_type,
        None if from_ts is None else F.col("ts_utc") >= _instant(from_ts),
        None if to_ts is None else F.col("ts_utc") <= _instant(to_ts),
        F.col("is_valid") if only_valid else None,
    ]
    for condition in conditions:
        if condition is not None:
            rows = rows.where(condition)
    return rows.select(*schemas.READING.fieldNames()).orderBy(*_ORDER).limit(most)
