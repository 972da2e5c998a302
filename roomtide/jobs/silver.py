"""Bronze table -> silver table, continuously or (--available-now) until caught up."""

import argparse
from collections.abc import Sequence

from roomtide.config import Settings
from roomtide.session import build_session
from roomtide.streaming.layers import read_bronze_stream, start_silver


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--available-now", action="store_true")
    parser.add_argument("--max-files-per-batch", type=int)
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    spark = build_session("silver", settings)
    bronze = read_bronze_stream(spark, settings.bronze_path, args.max_files_per_batch)
    start_silver(
        bronze,
        settings.silver_path,
        settings.silver_checkpoint,
        available_now=args.available_now,
    )
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
