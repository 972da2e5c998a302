"""Raw CSV rows -> readings -> messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roomtide import constants as C
from roomtide import schemas
from roomtide.functions import messages, text
from roomtide.functions.timeline import epoch_seconds


def _parsed(rows: DataFrame) -> DataFrame:
    """Each text is parsed once: a filter on columns that a generator makes stays above it, while
    one on projected columns would be pushed down together with a copy of the parsing."""
    parsed = F.struct(
        text.finite_number(F.col("ts_raw")).alias("epoch"),
        text.number(F.col("value_raw")).alias("number"),
    )
    return rows.select("*", F.inline(F.array(parsed)))


def _usable() -> Column:
    return text.is_epoch(F.col("epoch")) & text.is_value(F.col("sensor"), F.col("number"))


def _unusable() -> Column:
    return ~F.coalesce(_usable(), F.lit(False))


def to_readings(rows: DataFrame, counted: Observation | None = None) -> DataFrame:
    """Rows with a numeric epoch and value, as `ts` and `value`. Others, headers included, go.

    `counted` is told, as the rows pass, how many there were of each sensor type and how many went
    (`rows_<type>`, `rejected_<type>`)."""
    kept = [F.col(c) for c in rows.columns if c not in schemas.RAW_ROW.fieldNames()]
    parsed = _parsed(rows)
    if counted is not None:
        measures = []
        for sensor in C.FILE_NAME_ALIASES:
            of_type = F.col("sensor") == sensor
            measures.append(F.count_if(of_type).alias(f"rows_{sensor}"))
            measures.append(F.count_if(of_type & _unusable()).alias(f"rejected_{sensor}"))
        parsed = parsed.observe(counted, *measures)
    return parsed.where(_usable()).select(
        *kept,
        epoch_seconds(F.col("epoch")).alias("ts"),
        text.sensor_value(F.col("sensor"), F.col("number")).alias("value"),
    )


def rejected_by_sensor(rows: DataFrame) -> DataFrame:
    """How many raw rows there are and how many `to_readings` rejects."""
    return _parsed(rows).groupBy("sensor").agg(
        F.count("*").alias("nb_rows"), F.count_if(_unusable()).alias("nb_rejected")
    )


def to_messages(
    readings: DataFrame,
    topic_by_sensor: Mapping[str, str] = C.TOPICS,
    default_topic: str = C.DEFAULT_TOPIC,
) -> DataFrame:
    """Add topic, key and JSON value. Columns the readings already have are kept."""
    room, sensor = F.col("room"), F.col("sensor")
    return readings.select(
        messages.message_topic(sensor, topic_by_sensor, default_topic).alias("topic"),
        messages.message_key(room, sensor).alias("key"),
        messages.message_json(room, sensor, F.col("ts"), F.col("value")).alias("json"),
        *[F.col(c) for c in readings.columns if c not in ("topic", "key", "json")],
    )


def as_kafka(messages_: DataFrame) -> DataFrame:
    """The columns a Kafka sink takes.

    Tasks publish side by side, so messages of one key may arrive out of order; the header
    `position` is the place of a message in the whole replay, by which a reader restores the order.
    """
    place = F.struct(
        F.lit("position").alias("key"),
        F.col("position").cast("string").cast("binary").alias("value"),
    )
    return messages_.select("topic", "key", F.col("json").alias("value"), F.array(place).alias("headers"))


def with_total(per_sensor: DataFrame) -> DataFrame:
    """Counts per sensor type (`nb_messages`), and in total on the row where `is_total` is set."""
    counted = per_sensor.withColumnRenamed("nb_messages", "n").rollup("sensor").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nb_messages"),
        (F.grouping("sensor") == 1).alias("is_total"),
    )
    return counted.select("sensor", "is_total", "nb_messages")


def message_counts(readings: DataFrame) -> DataFrame:
    """Messages per sensor type, and in total on the row where `is_total` is set."""
    return with_total(readings.groupBy("sensor").agg(F.count("*").alias("nb_messages")))
