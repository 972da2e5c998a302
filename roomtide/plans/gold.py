"""Silver table -> hourly and daily KPI tables."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from roomtide.config import child, iso_date
from roomtide.operators.daily import daily_room_metrics
from roomtide.operators.hourly import hourly_metrics
from roomtide.schemas import DATE_PARTITION
from roomtide.session import require_utc
from roomtide.sources import tables
from roomtide.sources.scratch import delete, scratch_scope, stored

log = logging.getLogger(__name__)


def refresh_gold(
    spark: SparkSession,
    silver_root: str,
    hourly_root: str,
    daily_root: str,
    event_date: str | date | None = None,
    mode: str = "overwrite",
) -> dict[str, int]:
    """Recompute one day, or every day, and say how many readings were seen and had no day.

    This run's hours are stored once and feed both tables, so silver is scanned once and both
    tables tell the same. With "overwrite" a run of one day replaces it, also with nothing if silver
    has none of it left, and a run of all days replaces the tables. With "append" it adds to them.
    Readings without a usable clock belong to no day.
    """
    require_utc(spark)
    seen = Observation("silver readings")
    silver = tables.read_silver(spark, silver_root, event_date)
    observed = silver.observe(
        seen,
        F.count(F.lit(1)).alias("nb_readings"),
        F.count_if(F.col("event_date").isNull()).alias("nb_undated"),
    )
    dated = observed.where(F.col("event_date").isNotNull())
    with scratch_scope(spark, "gold"):
        hours = stored(hourly_metrics(dated, event_date), "hours")
        nothing = hours.isEmpty()
        for rows, root in ((hours, hourly_root), (daily_room_metrics(hours), daily_root)):
            if mode == "overwrite" and event_date is not None and nothing:
                delete(spark, child(root, f"{DATE_PARTITION}={iso_date(event_date)}"))
            elif mode == "overwrite" and event_date is None:
                tables.write_partitioned(rows, root, whole=True)
            else:
                tables.write_partitioned(rows, root, mode=mode)
    if nothing:  # then no reading has a day, and Spark may have left the observation out
        undated = silver.count()
        counts = {"nb_readings": undated, "nb_undated": undated}
    else:
        counts = {name: int(n) for name, n in seen.get.items()}
    log.info("gold refreshed: %s", counts)
    return counts
