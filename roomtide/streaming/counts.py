"""Running counts of messages while a replay or stream goes on.

The counts are state of the stream. Every batch gives the new counts of the sensor types it had
messages of; a table of all counts, one row a type, is written for each batch, and the one before the
last is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roomtide import schemas
from roomtide.config import child
from roomtide.operators.messages import with_total
from roomtide.sources import tables
from roomtide.streaming.layers import started


def _table(spark: SparkSession, root: str, batch: int | None) -> DataFrame:
    if batch is None:
        return spark.createDataFrame([], schemas.MESSAGE_COUNT)
    return tables.read_table(spark, child(root, f"batch={batch}"), schemas.MESSAGE_COUNT)


def update_counts(changed: DataFrame, batch: int, root: str) -> None:
    """Write the counts after a batch: the changed ones, and the others as they were before it."""
    spark = changed.sparkSession
    known = tables.numbered_folders(spark, root, "batch")
    before = [n for n in known if n < batch]
    latest = _table(spark, root, before[-1] if before else None)
    kept = latest.join(changed.select("sensor"), latest["sensor"].eqNullSafe(changed["sensor"]), "left_anti")
    tables.write_once(kept.unionByName(changed).coalesce(1), root, f"batch={batch}")
    tables.drop_folders(spark, root, "batch", before[:-1])


def start_counts(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    trigger: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Count the messages of a stream by `sensor` into the table at `root`."""
    counts = messages.groupBy("sensor").agg(F.count("*").alias("nb_messages"))
    writer = (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda changed, batch: update_counts(changed, batch, root))
        .option("checkpointLocation", checkpoint)
    )
    return started(writer, trigger, available_now)


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """The counts after the latest batch, in the columns of `message_counts`."""
    batches = tables.numbered_folders(spark, root, "batch")
    return with_total(_table(spark, root, batches[-1] if batches else None))
