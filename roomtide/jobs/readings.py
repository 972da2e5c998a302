"""A page of silver readings as JSON lines."""

import argparse
from collections.abc import Sequence

from roomtide import constants as C
from roomtide.config import Settings, iso_date
from roomtide.operators import serving
from roomtide.session import build_session
from roomtide.sources import tables


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--date", required=True, type=iso_date, help="YYYY-MM-DD")
    parser.add_argument("--room")
    parser.add_argument("--sensor-type")
    parser.add_argument("--from-ts")
    parser.add_argument("--to-ts")
    parser.add_argument("--all", action="store_true", help="invalid readings too")
    parser.add_argument("--limit", type=int, default=C.DEFAULT_LIMIT)
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    spark = build_session("readings", settings)
    page = serving.readings(
        tables.read_silver(spark, settings.silver_path),
        args.date,
        room=args.room,
        sensor_type=args.sensor_type,
        from_ts=args.from_ts,
        to_ts=args.to_ts,
        only_valid=not args.all,
        limit=args.limit,
        max_limit=settings.silver_max_limit,
    )
    for row in page.toJSON().collect():
        print(row)


if __name__ == "__main__":
    main()
