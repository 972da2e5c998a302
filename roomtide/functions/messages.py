"""Fields of a published message."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtide import constants as C
from roomtide.functions.lookup import lookup


def message_key(room: Column, sensor: Column) -> Column:
    return F.concat_ws(":", room, sensor)


def message_topic(
    sensor: Column,
    topic_by_sensor: Mapping[str, str] = C.TOPICS,
    default: str = C.DEFAULT_TOPIC,
) -> Column:
    return lookup(sensor, topic_by_sensor, default)


def _escaped(text: Column) -> Column:
    """Characters of a JSON text other than plain ASCII, as `\\uXXXX` or a short escape; those beyond
    the basic plane as two."""
    short = {"\"": "\\\"", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def one(char: Column) -> Column:
        code = F.ascii(char).cast("bigint")
        beyond = code - 0x10000
        pair = F.concat(
            unit(F.shiftright(beyond, 10) + 0xD800), unit(beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        )
        plain = code.between(0x20, 0x7E)
        return lookup(char, short, F.when(plain, char).when(beyond < 0, unit(code)).otherwise(pair))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def json_text(text: Column) -> Column:
    quoted = F.when(text.rlike(r"^[ !#-\[\]-~]*$"), text).otherwise(_escaped(text))
    return F.coalesce(F.concat(F.lit('"'), quoted, F.lit('"')), F.lit("null"))


def _wide_number(shown: Column) -> Column:
    """A double printed as `d.dddEn`: positional from 1e-4 up to 1e16, with a signed exponent of two
    digits or more beyond."""
    pattern = r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$"
    sign, head, tail, power = (F.regexp_extract(shown, pattern, i) for i in range(1, 5))
    tail = F.when(tail == "0", F.lit("")).otherwise(tail)
    power = power.cast("int")
    parts = F.struct(sign.alias("sign"), head.alias("head"), tail.alias("tail"), power.alias("power"))

    def written(p: Column) -> Column:
        digits, power = F.concat(p["head"], p["tail"]), p["power"]
        whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
        rest = F.substr(digits, power + 2, F.length(digits))
        large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
        point = F.when(p["tail"] == "", F.lit("")).otherwise(F.lit("."))
        signed = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
        two = F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0"))
        with_power = F.concat(p["head"], point, p["tail"], signed, two)
        number = (
            F.when(power.between(7, 15), large)
            .when(power == -4, F.concat(F.lit("0.000"), digits))
            .otherwise(with_power)
        )
        return F.concat(p["sign"], number)

    return F.transform(F.array(parts), written)[0]


def json_number(value: Column) -> Column:
    """A double as JSON text that any reader of the message log knows: NaN and infinities bare. Java
    before 19 prints a digit too many for some numbers above 1e16; they read back the same."""
    shown, size = value.cast("string"), F.abs(value)
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(F.isnan(value) | (size == float("inf")), shown)
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), shown)
        .otherwise(_wide_number(shown))
    )


def message_json(room: Column, sensor: Column, ts: Column, value: Column) -> Column:
    """The payload as JSON text, byte for byte as the log's readers have it: a blank after every colon
    and comma, ASCII only. Motion counts are written as integers, NULL fields as null."""
    whole = value.try_cast("bigint")
    number = F.when((sensor == "pir") & (whole == value), whole.cast("string"))
    return F.concat(
        F.lit('{"room": '),
        json_text(room),
        F.lit(', "sensor": '),
        json_text(sensor),
        F.lit(', "ts": '),
        F.coalesce(ts.cast("string"), F.lit("null")),
        F.lit(', "value": '),
        F.coalesce(number, json_number(value)),
        F.lit("}"),
    )
