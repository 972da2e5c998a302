"""Gold that follows silver: every batch of readings, late ones too, updates the days it touches.

A batch adds the states of its hours to the table of hour states; the hours and days of the event dates
it has readings of are then made anew from states alone, so the readings of a day are read once. A
batch that comes again after a failure finds its states stored and writes the same hours and days.
The states belong to the checkpoint: a stream that starts over needs an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from roomtide import schemas
from roomtide.operators.daily import daily_room_metrics
from roomtide.operators.hour_states import hour_states, hours_of_states, merge_states
from roomtide.sources import hour_table, tables
from roomtide.sources.scratch import scratch_scope, stored
from roomtide.streaming.layers import started

#: Batches after which states are merged into a base.
COMPACT_EVERY = 100


def read_silver_stream(
    spark: SparkSession, root: str, max_files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.SILVER)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.parquet(root).select(*schemas.SILVER.fieldNames())


def refresh_days(
    spark: SparkSession, states_root: str, hourly_root: str, daily_root: str, days: DataFrame
) -> None:
    """Make the hours and days of the given event dates from their states; other days stay."""
    with scratch_scope(spark, "gold"):
        states = hour_table.read_states(spark, states_root, stored(days, "days"))
        hours = stored(hours_of_states(merge_states(states)), "hours")
        tables.write_partitioned(hours, hourly_root)
        tables.write_partitioned(daily_room_metrics(hours), daily_root)


def apply_batch(
    readings: DataFrame,
    batch: int,
    states_root: str,
    hourly_root: str,
    daily_root: str,
    compact_every: int = COMPACT_EVERY,
) -> bool:
    """Take in a batch of silver readings, and say whether it was new."""
    spark = readings.sparkSession
    is_new = hour_table.add_batch(hour_states(readings), states_root, batch)
    days = hour_table.days_of_batch(spark, states_root, batch)
    refresh_days(spark, states_root, hourly_root, daily_root, days)
    if (batch + 1) % compact_every == 0:
        hour_table.compact(spark, states_root, batch)
    return is_new


def start_gold(
    silver: DataFrame,
    states_root: str,
    hourly_root: str,
    daily_root: str,
    checkpoint: str,
    trigger: str | None = None,
    available_now: bool = False,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    def update(readings: DataFrame, batch: int) -> None:
        apply_batch(readings, batch, states_root, hourly_root, daily_root, compact_every)

    writer = silver.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return started(writer, trigger, available_now)
