"""The two streaming layers.

Both are stateless appends, so late rows need no watermark: each goes to the partition of its
own event date whenever it arrives. Checkpoints live outside the table roots. Each layer reads
the previous table from its root, which shows committed files only.

A bronze batch writes one file for each task, room, sensor and day in it. The log is partitioned by
`room:sensor`, so a combination is in one task, and a batch of 255 sensors writes about 255 files. A
longer trigger interval makes fewer and larger files, and `bronze_batches` one for each combination;
`max_files_per_batch` bounds what a silver batch lists and reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from roomtide import constants as C
from roomtide import schemas
from roomtide.config import child
from roomtide.operators.bronze import is_unparsed, to_bronze
from roomtide.operators.silver import to_silver


def started(
    writer: DataStreamWriter, trigger: str | None = None, available_now: bool = False
) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    return writer.start()


def append_table(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    partitions: list[str],
    trigger: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Append a stream to a partitioned table.

    `trigger` is the batch interval; without it the next batch starts as the last one ends.
    `available_now` processes what is there and stops.
    """
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*partitions)
        .option("path", root)
        .option("checkpointLocation", checkpoint)
    )
    return started(writer, trigger, available_now)


def start_bronze(
    envelope: DataFrame,
    root: str,
    checkpoint: str,
    trigger: str | None = C.BRONZE_TRIGGER,
    available_now: bool = False,
) -> StreamingQuery:
    """Bronze stream; each batch's progress reports its message and unparsed counts."""
    rows = to_bronze(envelope).observe(
        "bronze",
        F.count("*").alias("nb_messages"),
        F.count_if(is_unparsed()).alias("nb_unparsed"),
    )
    return append_table(
        rows, root, checkpoint, schemas.BRONZE_PARTITIONS, trigger, available_now
    )


def read_bronze_stream(
    spark: SparkSession, root: str, max_files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.BRONZE)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    rows = reader.parquet(root)
    return rows.select(
        *schemas.BRONZE.fieldNames(), F.col("_metadata.file_path").alias("source_file")
    )


def read_bronze_leaf_stream(spark: SparkSession, root: str) -> DataFrame:
    """The stream of `tables.read_bronze_leaves`."""
    leaves = child(root, *(f"{name}=*" for name in schemas.BRONZE_PARTITIONS))
    rows = spark.readStream.schema(schemas.BRONZE).parquet(leaves)
    return rows.select(
        *schemas.BRONZE.fieldNames(), F.col("_metadata.file_path").alias("source_file")
    )


def start_silver(
    bronze: DataFrame,
    root: str,
    checkpoint: str,
    trigger: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    return append_table(
        to_silver(bronze), root, checkpoint, [schemas.DATE_PARTITION], trigger, available_now
    )
