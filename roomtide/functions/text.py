"""Reading numbers, rooms and sensor types out of text.

Each function uses its input once or twice only: column expressions are inlined where they are
used, and long chains of copies make generated code too large to compile.
"""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtide import constants as C

# What a cast to double would let through although it is no decimal literal: letters other than
# an exponent's (as in '1d' or '0x1p3'). Underscores may only stand between digits.
_NOT_DECIMAL = r"[A-DF-Za-df-z]|(?<![0-9])_|_(?![0-9])"
_NOT_FINITE = r"(?i)^\s*(?:[+-](?=nan))?([+-]?inf(?:inity)?|nan)\s*$"

_BIGINT_END = 2.0**63


def finite_number(text: Column) -> Column:
    """A decimal literal as a double, otherwise NULL."""
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(~text.rlike(_NOT_DECIMAL), digits.try_cast("double"))


def number(text: Column) -> Column:
    """Like `finite_number`, but NaN and infinities count as numbers too."""
    special = F.regexp_extract(text, _NOT_FINITE, 1).try_cast("double")
    return F.coalesce(finite_number(text), special)


def sensor_value(sensor: Column, value: Column) -> Column:
    """Motion counts are whole numbers, cut towards zero."""
    return F.when(sensor == "pir", value - value % 1).otherwise(value)


def is_epoch(epoch: Column) -> Column:
    """False or NULL for what cannot be a whole number of seconds, infinity included."""
    return F.abs(epoch) < _BIGINT_END


def is_value(sensor: Column, value: Column) -> Column:
    """Any number will do, but a motion count must be finite.

    NaN sorts above every number, so it is the bound that lets all of them pass.
    """
    bound = F.when(sensor == "pir", F.lit(sys.float_info.max)).otherwise(F.lit(float("nan")))
    return F.abs(value) <= bound


def decoded_path(path: Column) -> Column:
    """File paths reach Spark URL-encoded. A '+' in them is a plus sign, not a blank."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def sensor_from_name(file_name: Column) -> Column:
    """Sensor type named by a lower-case file name, NULL when no alias occurs in it.

    One pattern finds the alias: its alternatives are tried in order, each looking through the
    whole name, so the first type with a match wins wherever in the name it is.
    """
    groups = C.FILE_NAME_ALIASES.values()
    looks = "|".join(f"(?=.*?({'|'.join(aliases)}))" for aliases in groups)
    found = "".join(f"${i}" for i in range(1, len(groups) + 1))
    kinds = [
        F.lit(word)
        for kind, aliases in C.FILE_NAME_ALIASES.items()
        for alias in aliases
        for word in (alias, kind)
    ]
    return F.create_map(*kinds)[F.regexp_replace(file_name, f"^(?:{looks}).*$", found)]


def room_from_path(path: Column) -> Column:
    return F.regexp_extract(path, C.ROOM_IN_PATH, 1)


def sensor_from_topic(topic: Column) -> Column:
    return F.regexp_extract(topic, C.SENSOR_IN_TOPIC, 1)
