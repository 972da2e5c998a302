"""The message log. The connector is a separate package (see `Settings.kafka_package`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomtide.config import Settings


def source_options(settings: Settings) -> dict[str, str]:
    """With a bound on the offsets of a batch, a backlog is taken in several batches, in full."""
    options = {
        "kafka.bootstrap.servers": settings.kafka_bootstrap,
        "subscribe": settings.kafka_topics,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    if settings.max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(settings.max_offsets_per_trigger)
    return options


def sink_options(settings: Settings) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": settings.kafka_bootstrap,
        "kafka.acks": settings.kafka_acks,
        "kafka.linger.ms": str(settings.kafka_linger_ms),
        "kafka.batch.size": str(settings.kafka_batch_size),
    }


def read_message_stream(spark: SparkSession, settings: Settings) -> DataFrame:
    """Messages of the subscribed topics from the earliest offset, in the envelope schema."""
    return spark.readStream.format("kafka").options(**source_options(settings)).load()


def publish(messages: DataFrame, settings: Settings) -> None:
    """Send (topic, key, value, headers) rows; the topic column routes each message. Tasks send
    side by side: see `messages.as_kafka` for what restores the order."""
    (
        messages.select("topic", "key", "value", "headers")
        .write.format("kafka")
        .options(**sink_options(settings))
        .save()
    )
