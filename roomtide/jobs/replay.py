"""Raw CSV files -> messages, published in replay order.

Messages go to Kafka, or with --to to a Parquet folder together with their send offsets. Many tasks
publish side by side, so a sink sees the order of a replay only in part; every message carries its
`position` (a header in Kafka, a column in Parquet), which restores it for a key and for the whole.
At the end the job reports how many messages were sent and how many raw rows were rejected.
"""

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from roomtide import constants as C
from roomtide.config import Settings
from roomtide.operators import messages, replay
from roomtide.session import build_session
from roomtide.sources import kafka, raw_csv
from roomtide.sources.scratch import scratch_scope, stored


def raw_rows(spark: SparkSession, settings: Settings) -> DataFrame:
    return raw_csv.read_rows(spark, settings.raw_path, settings.rooms, settings.sensors)


def scheduled_messages(
    spark: SparkSession, settings: Settings, counted: Observation | None = None
) -> DataFrame:
    """The messages of the wanted files with their position and send offset. The raw files are read
    once, and `counted` is told of their rows then."""
    readings = messages.to_readings(raw_rows(spark, settings), counted)
    if settings.replay_mode == "rate":
        schedule = replay.rate(readings, settings.rate_per_second)
    else:
        schedule = replay.merged(replay.timewarp(readings, settings.timewarp_factor))
    return messages.to_messages(schedule, settings.topic_by_sensor, settings.default_topic)


def _rejected(spark: SparkSession, settings: Settings, counted: Observation, total: int) -> dict:
    if not total:  # then Spark may have left the observation out, with all that has no rows
        rows = messages.rejected_by_sensor(raw_rows(spark, settings)).collect()
        return {r.sensor: r.nb_rejected for r in rows}
    seen = counted.get
    return {s: seen[f"rejected_{s}"] for s in C.FILE_NAME_ALIASES if seen[f"rows_{s}"]}


def report(spark: SparkSession, settings: Settings, sent: DataFrame, counted: Observation) -> dict:
    """Messages per sensor type and in total, and raw rows that gave none."""
    counts = messages.message_counts(sent).collect()
    total = sum(r.nb_messages for r in counts if r.is_total)
    return {
        "sent": {r.sensor: r.nb_messages for r in counts if not r.is_total},
        "total": total,
        "rejected": _rejected(spark, settings, counted, total),
    }


def main(argv: Sequence[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--to", help="write a Parquet folder instead of publishing")
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    spark = build_session(
        "replay", settings, packages=[] if args.to else [settings.kafka_package]
    )
    counted = Observation("raw rows")
    with scratch_scope(spark, "replay"):
        sent = scheduled_messages(spark, settings, counted)
        if args.to:
            sent.write.parquet(args.to)
            sent = spark.read.parquet(args.to)
        else:
            sent = stored(sent, "messages")
            kafka.publish(messages.as_kafka(sent), settings)
        summary = report(spark, settings, sent, counted)
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
