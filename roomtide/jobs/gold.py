"""Silver table -> hourly and daily KPI tables for one day."""

import argparse
import json
from collections.abc import Sequence

from roomtide.config import Settings, iso_date
from roomtide.plans.gold import refresh_gold
from roomtide.session import build_session


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--date", "--process-date", dest="day", help="YYYY-MM-DD")
    parser.add_argument("--mode", choices=["overwrite", "append"], default="overwrite")
    args = parser.parse_args(argv)
    day = iso_date(args.day)
    settings = Settings.from_env()
    spark = build_session("gold", settings)
    counts = refresh_gold(
        spark, settings.silver_path, settings.hourly_path, settings.daily_path, day, args.mode
    )
    print(json.dumps({"date": day, **counts}))


if __name__ == "__main__":
    main()
