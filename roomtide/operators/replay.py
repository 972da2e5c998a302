"""When each reading of a set of files is sent again: the replay schedules.

A stream is one file (`path`). Readings carry the columns of `raw_csv.read_rows`; a stream's
rows are replayed in file order. The schedules only say when and in which order; nothing here
waits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.operators.ordering import along_streams, number_rows
from roomtide.operators.turns import in_turns
from roomtide.sources.scratch import stored

FILE_ORDER = ("split", "line")

def _at_least_one(setting: float) -> float:
    return max(float(setting), 1.0)


def timewarp(
    readings: DataFrame,
    factor: float,
    order: Sequence[str] = FILE_ORDER,
    chunk: str | None = "split",
) -> DataFrame:
    """Original spacing, `factor` times faster: adds `elapsed` and `send_offset` in seconds.

    Every stream starts at 0. Where a clock steps back, the next reading follows at once.
    """
    moved = along_streams(readings, "path", order, chunk).drop("round")
    return moved.withColumn("send_offset", F.col("elapsed") / _at_least_one(factor))


def timewarp_by_time(readings: DataFrame, factor: float) -> DataFrame:
    """`timewarp` with each stream in order of `ts`, which is how sorted files are replayed.

    Then no step goes back and the steps add up to `ts` minus the first `ts` of the stream: one
    small aggregate, written so that the join knows its size, instead of a sort.
    """
    starts = stored(
        readings.groupBy("path").agg(F.min("ts").alias("first_ts")), "stream-starts"
    )
    moved = readings.join(starts, "path").select(
        *readings.columns, (F.col("ts") - F.col("first_ts")).alias("elapsed")
    )
    return moved.withColumn("send_offset", F.col("elapsed") / _at_least_one(factor))


def merged(schedule: DataFrame, order: Sequence[str] = FILE_ORDER) -> DataFrame:
    """All streams of a `timewarp` schedule as one sequence: adds `position`, from 1.

    Readings due at the same time go stream by stream in path order.
    """
    return number_rows(schedule, ["elapsed", "path", *order], "position")


def rate(
    readings: DataFrame,
    per_second: float,
    order: Sequence[str] = FILE_ORDER,
    chunk: str | None = "split",
) -> DataFrame:
    """A fixed number of messages per second, taking one from each stream in turn.

    Streams take turns in path order and leave when they run out. Adds `round`, `position`
    (from 1, over all streams) and `send_offset` in seconds. Positions follow from the lengths of
    the streams, so the readings are not sorted.
    """
    turns = in_turns(readings, "path", order, chunk)
    return turns.withColumn(
        "send_offset", (F.col("position") - 1) / _at_least_one(per_second)
    )


def stream_index(entries: DataFrame) -> DataFrame:
    """Add `stream_idx`, the position from 0 of each stream in path order."""
    streams = entries.select("room", "sensor", "path").distinct()
    numbered = number_rows(streams, ["path"], "place")
    return numbered.withColumn("stream_idx", F.col("place") - 1).drop("place")
