"""Row numbers and running sums over streams of any length.

A window over a whole stream, or over all rows, puts that stream in one task. Here the order is
cut into chunks of bounded size: windows run inside a chunk, a table with one row per chunk
carries the totals of the earlier chunks, and the two are joined on the chunk. The rows are
written between the two steps, so that they are read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.sources.scratch import stored

# monotonically_increasing_id() keeps the row's place in its partition in the low 33 bits.
_ROW_BITS = (1 << 33) - 1


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def stage_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` sorted across the cluster and written as a scratch table.

    Adds `chunk`, the sorted partition a row fell into, and `chunk_row`, its place there from 0.
    Range partitioning cuts at sampled values of the whole order, so with a unique order a hot
    stream is spread over many chunks. It is written because the cuts differ from run to run:
    everything computed per chunk must refer to the same cuts.
    """
    placed = df.orderBy(*order).withColumns(
        {
            "chunk": F.spark_partition_id(),
            "chunk_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
        }
    )
    return stored(placed, "sorted")


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the position of each row in the given order, from 1. One shuffle, the sort."""
    staged = stage_sorted(df, order)
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # The one step in a single task: it has a row per task of the sort.
    starts = (
        staged.groupBy("chunk")
        .agg(F.count("*").alias("rows"))
        .select("chunk", _or_zero(F.sum("rows").over(earlier)).alias("start"))
    )
    numbered = staged.join(stored(starts, "chunk-starts"), "chunk")
    return numbered.withColumn(name, F.col("start") + F.col("chunk_row") + 1).drop(
        "chunk", "chunk_row", "start"
    )


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str], name: str) -> DataFrame:
    """`number_rows`, and for each column of `sums` its total up to and with the row, as `<column>_to`."""
    staged = stage_sorted(df, order)
    inside = Window.partitionBy("chunk").orderBy("chunk_row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy("chunk").agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(f"{c}_sum") for c in sums]
    )
    starts = totals.select(
        "chunk",
        _or_zero(F.sum("rows").over(earlier)).alias("start"),
        *[_or_zero(F.sum(f"{c}_sum").over(earlier)).alias(f"{c}_start") for c in sums],
    )
    added = {name: F.col("start") + F.col("chunk_row") + 1} | {
        f"{c}_to": F.col(f"{c}_start") + F.sum(c).over(so_far) for c in sums
    }
    joined = staged.join(stored(starts, "chunk-starts"), "chunk")
    return joined.withColumns(added).select(*df.columns, *added)


def within_pieces(df: DataFrame, key: str, order: Sequence[str], chunk: str) -> DataFrame:
    """Add what a row's own piece of its stream says: `piece_round` and `piece_elapsed` up to the
    row, and on the last row of the piece `first_ts`, the piece's first `ts`. One shuffle."""
    piece = Window.partitionBy(key, chunk).orderBy(*order)
    so_far = piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # greatest() skips NULL, so a first row steps by 0.
    step = F.greatest(F.col("ts") - F.lag("ts").over(piece), F.lit(0))
    is_last = F.lead(F.lit(True)).over(piece).isNull()
    local = df.withColumns(
        {
            "piece_round": F.row_number().over(piece),
            "step": step,
            "piece_start": F.first("ts").over(so_far),
            "is_last": is_last,
        }
    )
    return local.withColumn("piece_elapsed", F.sum("step").over(so_far)).drop("step")


def carried_totals(local: DataFrame, key: str, chunk: str) -> DataFrame:
    """What the earlier pieces of a stream add to a piece: one row for each piece."""
    ends = local.where("is_last")
    stream = Window.partitionBy(key).orderBy(chunk)
    earlier = stream.rowsBetween(Window.unboundedPreceding, -1)
    so_far = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    jump = F.greatest(F.col("piece_start") - F.lag("ts").over(stream), F.lit(0))
    return ends.withColumn("jump", jump).select(
        key,
        chunk,
        _or_zero(F.sum("piece_round").over(earlier)).alias("rounds_before"),
        (
            _or_zero(F.sum("piece_elapsed").over(earlier)) + F.sum("jump").over(so_far)
        ).alias("elapsed_before"),
    )


def along_streams(
    df: DataFrame, key: str, order: Sequence[str], chunk: str | None = None
) -> DataFrame:
    """Add `round`, a row's number in its stream, and `elapsed`, the seconds `ts` has moved.

    `elapsed` sums the steps forward of `ts` from the stream's first row on; a step back adds
    nothing. `order` must be unique within a stream. `chunk` names a column that already cuts
    each stream into bounded pieces in that order, as the splits of a file do; without one the
    rows are sorted first.
    """
    if chunk is None:
        df = stage_sorted(df, [key, *order]).drop("chunk_row")
        added, chunk = ["chunk"], "chunk"
    else:
        added = []
    local = stored(within_pieces(df, key, order, chunk), "pieces")
    carried = stored(carried_totals(local, key, chunk), "piece-totals")
    return local.join(carried, [key, chunk]).select(
        *[c for c in df.columns if c not in added],
        (F.col("piece_round") + F.col("rounds_before")).alias("round"),
        (F.col("piece_elapsed") + F.col("elapsed_before")).alias("elapsed"),
    )
