"""Message log -> bronze table, continuously.

With --batches every batch is a folder of its own, rebalanced by partition value; with --rejects also the
text of messages that are not the declared payload is kept. A table is written in one way only.
"""

import argparse
from collections.abc import Sequence

from roomtide.config import Settings
from roomtide.session import build_session
from roomtide.sources.kafka import read_message_stream
from roomtide.streaming.bronze_batches import start_bronze_batches
from roomtide.streaming.layers import start_bronze


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--batches", action="store_true")
    parser.add_argument("--rejects", help="folder for rejected messages; implies --batches")
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    spark = build_session("bronze", settings, packages=[settings.kafka_package])
    messages = read_message_stream(spark, settings)
    table = settings.bronze_path, settings.bronze_checkpoint
    if args.batches or args.rejects:
        query = start_bronze_batches(messages, *table, args.rejects, settings.bronze_trigger)
    else:
        query = start_bronze(messages, *table, settings.bronze_trigger)
    query.awaitTermination()


if __name__ == "__main__":
    main()
