"""The bronze stream written batch by batch, with few files and the rejected messages on the side.

The file sink of `layers` writes a file for each task and partition value. Here a batch is rebalanced by
partition value first: small values share a task and get one file each, a value too large for one task
is split. A batch is one folder, `batch=<n>`, that appears when all of it is written, so a batch that
comes again after a failure adds nothing; partition values are folders inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from roomtide import constants as C
from roomtide import schemas
from roomtide.operators.bronze import rejected_messages, to_bronze
from roomtide.sources import tables
from roomtide.streaming.layers import started


def write_batch(envelope: DataFrame, batch: int, root: str, rejects_root: str | None = None) -> bool:
    """Write a batch of messages as bronze rows, and say whether it was new. Messages that are not the
    declared payload stay in bronze with NULL fields; with `rejects_root` their text is kept there."""
    envelope = envelope.persist()
    try:
        if rejects_root:
            tables.write_once(rejected_messages(envelope), rejects_root, f"batch={batch}")
        rows = to_bronze(envelope)
        return tables.write_once(rows, root, f"batch={batch}", *schemas.BRONZE_PARTITIONS)
    finally:
        envelope.unpersist()


def start_bronze_batches(
    envelope: DataFrame,
    root: str,
    checkpoint: str,
    rejects_root: str | None = None,
    trigger: str | None = C.BRONZE_TRIGGER,
    available_now: bool = False,
) -> StreamingQuery:
    def write(messages: DataFrame, batch: int) -> None:
        write_batch(messages, batch, root, rejects_root)

    writer = envelope.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return started(writer, trigger, available_now)
