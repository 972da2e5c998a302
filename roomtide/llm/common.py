"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def map_batches(
    df: DataFrame, transform: Callable[..., Batches], fields: list[T.StructField], **arguments
) -> DataFrame:
    """`transform` over the Arrow batches of `df`, giving rows of `fields`."""
    return df.mapInArrow(partial(transform, **arguments), T.StructType(fields))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a row without id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def share(salt: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns only: the same rows are drawn every time."""
    scaled = F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30))
    return scaled / float(1 << 30)


def identified(docs: DataFrame) -> DataFrame:
    """Whole rows in the column `row`, so that no column of theirs can clash with another, next to
    what tells documents apart: `id` and `hash`, that of the text. Texts are in `row` only, and so
    are shuffled once."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(
        F.col("doc_id").alias("id"), text_hash.alias("hash"), F.struct("*").alias("row")
    )


def small_batches(batches: Batches, max_bytes: int = 8 << 20) -> Batches:
    """The same rows in batches of about `max_bytes`, so that what is made of one stays small."""
    for batch in batches:
        rows = max(1, batch.num_rows * max_bytes // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
