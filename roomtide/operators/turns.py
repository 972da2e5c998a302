"""Places of rows in a sequence that takes one row from each stream in turn.

The place of row r of a stream follows from the lengths of the streams alone: earlier rounds have
taken min(length, r - 1) rows of every stream, and in round r the streams before this one take one row
each if they have r rows. Between two neighbouring lengths the same streams take turns, so the place
grows by their number with every round: a stream's places are a few straight steps. Only rows of the
table of lengths are sorted. The streams' own rows are numbered within the pieces they come in and
meet the steps of their piece in one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtide.operators.ordering import number_rows, running_totals, stage_sorted
from roomtide.sources.scratch import stored

#: Rounds whose steps are looked through together, so that a row compares few.
_SPAN = 4096


def _pieces(numbered: DataFrame, key: str, chunk: str) -> DataFrame:
    """(key, chunk, rows, rounds_before) of each piece, from its last row."""
    earlier = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = numbered.where("is_last").select(key, chunk, F.col("piece_round").alias("rows"))
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    return ends.withColumn("rounds_before", before)


def steps_of(lengths: DataFrame, key: str) -> DataFrame:
    """(key, after, upto, alive, base): in rounds after `after` and up to `upto` the row of round r
    has the place base + r * alive. `lengths` has the number of rows (`n`) of each stream."""
    n_streams = lengths.count()
    by_length = lengths.groupBy("n").agg(F.count("*").alias("streams"))
    totals = running_totals(
        by_length.withColumn("taken", F.col("n") * F.col("streams")), ["n"], ["streams", "taken"], "k"
    )
    totals = stored(totals.select("k", "n", "streams_to", "taken_to"), "lengths")
    shorter = totals.select(
        (F.col("k") + 1).alias("k"),
        F.col("n").alias("after"),
        (F.lit(n_streams) - F.col("streams_to")).alias("alive"),
        "taken_to",
    )
    none_shorter = {"after": 0, "alive": n_streams, "taken_to": 0}
    stretches = totals.select("k", F.col("n").alias("upto")).join(shorter, "k", "left")
    stretches = stretches.fillna(none_shorter).select(
        "k",
        "after",
        "upto",
        "alive",
        # Rows taken in earlier rounds, less what the first round of the stretch adds back.
        (F.col("taken_to") - F.col("alive")).alias("start"),
    )
    turns = lengths.join(totals.select("n", "k"), "n").select(
        key, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))).alias("k")
    )
    numbered = stored(number_rows(turns, ["k", key], "number"), "turns")
    first = numbered.groupBy("k").agg(F.min("number").alias("first"))
    rank = F.col("number") - F.col("first") + 1
    placed = numbered.join(first, "k").join(stretches, "k")
    return placed.select(key, "after", "upto", "alive", (F.col("start") + rank).alias("base"))


def _steps_by_span(pieces: DataFrame, steps: DataFrame, key: str, chunk: str) -> DataFrame:
    """(key, chunk, span, rounds_before, steps): the steps that rows of one span of a piece may need.
    Both sides are cut at the same rounds, so that they meet by equality."""

    def spans(first: str, last: str):
        return F.explode(F.sequence(F.expr(f"({first} - 1) DIV {_SPAN}"), F.expr(f"({last} - 1) DIV {_SPAN}")))

    last_span = F.expr(f"(rows - 1) DIV {_SPAN}")
    cut = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last_span)).alias("span"))
    cut = cut.withColumns(
        {
            "first": F.col("rounds_before") + F.col("span") * _SPAN + 1,
            "last": F.col("rounds_before") + F.least((F.col("span") + 1) * _SPAN, F.col("rows")),
        }
    ).select("*", spans("first", "last").alias("place"))
    steps = steps.withColumn("since", F.col("after") + 1)
    met = cut.join(steps.select("*", spans("since", "upto").alias("place")), [key, "place"])
    step = F.struct("upto", "alive", "base")
    return (
        met.where("since <= last AND upto >= first")
        .groupBy(key, chunk, "span")
        .agg(
            F.first("rounds_before").alias("rounds_before"),
            F.sort_array(F.collect_set(step)).alias("steps"),
        )
    )


def in_turns(
    df: DataFrame, key: str, order: Sequence[str], chunk: str | None, name: str = "position"
) -> DataFrame:
    """Add `round`, a row's number in its stream, and its place from 1 when streams take turns in the
    order of their keys and leave when they run out.

    `chunk` names a column that cuts each stream into bounded pieces in the order of its rows, as the
    splits of a file do; without one the rows are sorted first."""
    columns = df.columns
    if chunk is None:
        df, chunk = stage_sorted(df, [key, *order]).drop("chunk_row"), "chunk"
    piece = Window.partitionBy(key, chunk).orderBy(*order)
    numbered = stored(
        df.withColumns(
            {
                "piece_round": F.row_number().over(piece).cast("bigint"),
                "is_last": F.lead(F.lit(True)).over(piece).isNull(),
            }
        ),
        "pieces",
    )
    pieces = stored(_pieces(numbered, key, chunk), "piece-sizes")
    lengths = stored(pieces.groupBy(key).agg(F.sum("rows").alias("n")), "stream-lengths")
    steps = stored(steps_of(lengths, key), "steps")
    by_span = stored(_steps_by_span(pieces, steps, key, chunk), "steps-by-span")
    span = F.expr(f"(piece_round - 1) DIV {_SPAN}")
    joined = numbered.withColumn("span", span).join(by_span, [key, chunk, "span"])
    rounds = joined.withColumn("round", F.col("piece_round") + F.col("rounds_before"))
    step = F.filter("steps", lambda s: s["upto"] >= F.col("round"))[0]
    place = (step["base"] + F.col("round") * step["alive"]).alias(name)
    return rounds.select(*columns, "round", place)
