"""Message envelope -> bronze rows. Stateless, so it runs on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from roomtide import schemas
from roomtide.functions.timeline import seconds_to_timestamp


_TEXTS = ("key", "value")


def decode_envelope(envelope: DataFrame) -> DataFrame:
    """The envelope with its binary fields as text; `value_str` and `kafka_ts` are their names in
    bronze."""
    named = {"value": "value_str", "timestamp": "kafka_ts"}
    return envelope.select(
        *[
            F.col(f.name).cast("string" if f.name in _TEXTS else f.dataType).alias(
                named.get(f.name, f.name)
            )
            for f in schemas.ENVELOPE
        ]
    )


def to_bronze(envelope: DataFrame) -> DataFrame:
    """Typed bronze rows. A message that does not parse stays, with NULL payload fields."""
    message = F.from_json(F.col("value").cast("string"), schemas.PAYLOAD)
    opened = envelope.select(message.alias("message"), *schemas.ENVELOPE.fieldNames())
    taken_at = seconds_to_timestamp(F.col("message.ts"))
    made = {
        "room": F.col("message.room"),
        "sensor": F.col("message.sensor"),
        "ts_unix": F.col("message.ts"),
        "value": F.col("message.value"),
        "kafka_ts": F.col("timestamp"),
        "event_ts": taken_at,
        "event_date": F.to_date(taken_at),
        "ingest_ts": F.current_timestamp(),
    }
    return opened.select(
        *[made.get(name, F.col(name)).alias(name) for name in schemas.BRONZE.fieldNames()]
    )


def is_unparsed() -> Column:
    """True for bronze rows whose message gave no payload field at all."""
    fields = F.coalesce(
        F.col("room"), F.col("sensor"), F.col("ts_unix").cast("string"),
        F.col("value").cast("string"),
    )
    return fields.isNull()


def rejected_messages(envelope: DataFrame) -> DataFrame:
    """Topic, partition, offset, log time and text of messages that are no JSON, or JSON of another
    shape or type than declared; blank ones and those without a value, which have no text, too."""
    shape = StructType([*schemas.PAYLOAD.fields, StructField("rejected", StringType())])
    text = F.col("value").cast("string")
    parsed = F.from_json(text, shape, {"columnNameOfCorruptRecord": "rejected"})
    return (
        envelope.select("*", parsed.alias("message"))
        .where(F.col("message.rejected").isNotNull() | F.col("message").isNull())
        .select(
            "topic", "partition", "offset", F.col("timestamp").alias("kafka_ts"), text.alias("text")
        )
    )


def unparsed_by_topic(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("topic").agg(
        F.count("*").alias("nb_messages"), F.count_if(is_unparsed()).alias("nb_unparsed")
    )
