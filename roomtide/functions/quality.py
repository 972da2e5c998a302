"""Value cleaning, units, validity and the KPI formulas."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtide import constants as C
from roomtide.functions.lookup import lookup


def clean_text(raw: Column) -> Column:
    """A raw text value as a double; blanks and NaN spellings become NULL."""
    trimmed = F.trim(raw)
    return F.when(~trimmed.isin(C.BLANK_VALUES), trimmed.try_cast("double"))


def clean_number(raw: Column) -> Column:
    """`clean_text` of a double's own text, without the trip through text.

    A double survives double -> text -> double unchanged and only NaN prints as a blank
    value, so testing for NaN gives the same result and skips formatting and parsing.
    """
    return F.when(~F.isnan(raw), raw)


def unit_of(sensor_type: Column) -> Column:
    return lookup(sensor_type, C.UNITS, C.UNKNOWN_UNIT)


def row_flag(value_clean: Column) -> Column:
    return F.when(value_clean.isNull(), F.lit(C.FLAG_MISSING)).otherwise(F.lit(C.FLAG_VALID))


def valid_share(valid: Column, total: Column) -> Column:
    """A fraction, not a percentage."""
    return F.when(total > 0, valid / total).otherwise(F.lit(0.0))


def hour_flag(share: Column) -> Column:
    return (
        F.when(share >= C.HOUR_OK_SHARE, F.lit(C.HOUR_OK))
        .when(share >= C.HOUR_WARNING_SHARE, F.lit(C.HOUR_WARNING))
        .otherwise(F.lit(C.HOUR_BAD))
    )


def percent(share: Column) -> Column:
    """A share as 0..100, clamped; NULL stays NULL, which least/greatest would not do."""
    scaled = share * 100.0
    return F.when(scaled < 0.0, F.lit(0.0)).when(scaled > 100.0, F.lit(100.0)).otherwise(scaled)


def comfort_score(temperature_ok: Column, co2_alarm: Column, humidity_ok: Column) -> Column:
    """0..100. A missing CO2 sensor earns full credit, the other two earn none."""
    def known(ratio: Column) -> Column:
        return F.coalesce(ratio, F.lit(0.0))

    points = (
        C.TEMPERATURE_WEIGHT * known(temperature_ok)
        + C.CO2_WEIGHT * (1.0 - known(co2_alarm))
        + C.HUMIDITY_WEIGHT * known(humidity_ok)
    )
    return 100.0 * points
