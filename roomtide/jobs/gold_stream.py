"""Silver table -> hourly and daily KPI tables, as readings arrive, late ones too."""

import argparse
from collections.abc import Sequence

from roomtide.config import Settings
from roomtide.session import build_session
from roomtide.streaming.gold import COMPACT_EVERY, read_silver_stream, start_gold


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--available-now", action="store_true")
    parser.add_argument("--max-files-per-batch", type=int)
    parser.add_argument("--compact-every", type=int, default=COMPACT_EVERY, help="batches")
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    spark = build_session("gold-stream", settings)
    query = start_gold(
        read_silver_stream(spark, settings.silver_path, args.max_files_per_batch),
        settings.states_path,
        settings.hourly_path,
        settings.daily_path,
        settings.gold_checkpoint,
        available_now=args.available_now,
        compact_every=args.compact_every,
    )
    query.awaitTermination()


if __name__ == "__main__":
    main()
