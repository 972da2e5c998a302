"""Epochs, days and hours. The session zone must be UTC (see `session.pin_utc`)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtide import constants as C

# 0001-01-01T00:00:00Z and 9999-12-31T23:59:59Z.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799


def seconds_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds as a timestamp; NULL outside years 1 to 9999.

    The bound matters: `timestamp_seconds` raises on overflow, and one message with a
    nonsense clock must not stop a stream.
    """
    return F.when(
        seconds.between(_FIRST_SECOND, _LAST_SECOND), F.timestamp_seconds(seconds)
    )


def epoch_seconds(epoch: Column) -> Column:
    """An epoch in seconds, milliseconds or microseconds (a double) as whole seconds."""
    per_second = (
        F.when(epoch > C.MICROSECONDS_ABOVE, F.lit(1e6))
        .when(epoch > C.MILLISECONDS_ABOVE, F.lit(1e3))
        .otherwise(F.lit(1.0))
    )
    return (epoch / per_second).try_cast("bigint")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
