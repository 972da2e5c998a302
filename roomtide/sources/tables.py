"""Partitioned Parquet tables.

Tables are read from their root with a declared schema: partition values keep their type,
files a stream has not committed stay invisible, and a predicate on a partition column
prunes directories.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roomtide import schemas
from roomtide.config import child, iso_date
from roomtide.sources.scratch import delete, exists, folders, move


def read_table(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(root).select(*schema.fieldNames())


def on_date(df: DataFrame, event_date: str | date) -> DataFrame:
    """Rows of one day. On a table read from its root this prunes to one partition."""
    return df.where(F.col("event_date") == F.lit(iso_date(event_date)).cast("date"))


def read_bronze(spark: SparkSession, root: str) -> DataFrame:
    """Bronze rows with the file each came from."""
    rows = spark.read.schema(schemas.BRONZE).parquet(root)
    return rows.select(
        *schemas.BRONZE.fieldNames(), F.col("_metadata.file_path").alias("source_file")
    )


def read_bronze_leaves(spark: SparkSession, root: str) -> DataFrame:
    """Bronze rows read leaf folder by leaf folder, as a table is read that was given without its
    root: room, sensor and day are NULL then and silver repairs them from file, topic and clock. A
    stream's uncommitted files are read too; `read_bronze` is the safe way where there is a root."""
    leaves = child(root, *(f"{name}=*" for name in schemas.BRONZE_PARTITIONS))
    rows = spark.read.schema(schemas.BRONZE).parquet(leaves)
    return rows.select(
        *schemas.BRONZE.fieldNames(), F.col("_metadata.file_path").alias("source_file")
    )


def read_silver(
    spark: SparkSession, root: str, event_date: str | date | None = None
) -> DataFrame:
    rows = read_table(spark, root, schemas.SILVER)
    return rows if event_date is None else on_date(rows, event_date)


def read_hourly(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, schemas.HOURLY)


def read_daily(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, schemas.DAILY)


def write_partitioned(
    df: DataFrame, root: str, *partitions: str, mode: str = "overwrite", whole: bool = False
) -> None:
    """Write a partitioned table.

    "overwrite" replaces only the partitions present in `df`, so running a day again leaves
    one copy of it, or with `whole` the table; "append" adds a second copy. The rebalance groups rows by partition
    value to avoid one small file per task and value, and splits values that are too large
    for one task.
    """
    partitions = partitions or (schemas.DATE_PARTITION,)
    (
        df.hint("rebalance", *partitions)
        .write.mode(mode)
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(*partitions)
        .parquet(root)
    )


def write_once(df: DataFrame, root: str, name: str, *partitions: str, rebalance: bool = True) -> bool:
    """Write the folder `name` of a table unless it is there, and say whether it was written.

    Rows go to a hidden folder that takes its name when all are written, so readers see all or
    nothing and a second run of the same work adds nothing. That is as safe as renaming a folder is
    on the file system."""
    # A name with "=" in it would be read as a partition, hidden or not.
    target, hidden = child(root, name), child(root, "_writing-" + name.replace("=", "-"))
    spark = df.sparkSession
    if exists(spark, target):
        return False
    if partitions and rebalance:
        df = df.hint("rebalance", *partitions)
    df.write.mode("overwrite").partitionBy(*partitions).parquet(hidden)
    move(spark, hidden, target)
    return True


def numbered_folders(spark: SparkSession, root: str, name: str) -> list[int]:
    """The numbers n of the folders `name`=n of a table, ascending."""
    return sorted(
        int(folder.removeprefix(f"{name}="))
        for folder in folders(spark, root)
        if folder.startswith(f"{name}=")
    )


def drop_folders(spark: SparkSession, root: str, name: str, numbers: Iterable[int]) -> None:
    for number in numbers:
        delete(spark, child(root, f"{name}={number}"))
