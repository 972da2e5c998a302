"""The table of hour states: one folder for each batch of readings, merged into bases now and then.

`<root>/deltas/batch=<n>` holds the states of one batch, `<root>/bases/upto=<n>` for some days the
merged states of all batches up to n. A day is read from its latest base and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide import schemas
from roomtide.config import child
from roomtide.operators.hour_states import merge_states
from roomtide.sources import tables

_DAY = schemas.DATE_PARTITION


def _folder_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """States with the number of their folder; none if there is no folder yet."""
    schema = T.StructType([*schemas.HOUR_STATE.fields, T.StructField(name, T.LongType())])
    if not tables.numbered_folders(spark, root, name):
        return spark.createDataFrame([], schema)
    return tables.read_table(spark, root, schema)


def add_batch(states: DataFrame, root: str, batch: int) -> bool:
    """Store the states of a batch; one that is there already, from an earlier run, stays."""
    return tables.write_once(states, child(root, "deltas"), f"batch={batch}", _DAY)


def days_of_batch(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The days a batch has readings of."""
    rows = _folder_rows(spark, child(root, "deltas"), "batch")
    return rows.where(F.col("batch") == batch).select(_DAY).distinct()


def read_states(
    spark: SparkSession, root: str, days: DataFrame | None = None, upto: int | None = None
) -> DataFrame:
    """States, several an hour, of all days or of those given, and of all batches or those up to a
    number: enough to merge."""
    bases = _folder_rows(spark, child(root, "bases"), "upto")
    deltas = _folder_rows(spark, child(root, "deltas"), "batch")
    if upto is not None:
        deltas = deltas.where(F.col("batch") <= upto)
    if days is not None:
        bases, deltas = (rows.join(days, _DAY, "left_semi") for rows in (bases, deltas))
    latest = bases.groupBy(_DAY).agg(F.max("upto").alias("latest"))
    columns = schemas.HOUR_STATE.fieldNames()
    merged = bases.join(latest, _DAY).where("upto = latest").select(*columns)
    later = deltas.join(latest, _DAY, "left").where("latest IS NULL OR batch > latest")
    return merged.unionByName(later.select(*columns))


def compact(spark: SparkSession, root: str, upto: int) -> bool:
    """Merge the batches up to a number into a base of the days they touch, and drop their folders.
    Nothing may be adding batches up to this number meanwhile."""
    deltas = child(root, "deltas")
    merged = [n for n in tables.numbered_folders(spark, deltas, "batch") if n <= upto]
    if not merged:
        return False
    touched = _folder_rows(spark, deltas, "batch").where(F.col("batch") <= upto)
    states = read_states(spark, root, touched.select(_DAY).distinct(), upto)
    tables.write_once(merge_states(states), child(root, "bases"), f"upto={upto}", _DAY)
    tables.drop_folders(spark, deltas, "batch", merged)
    return True
