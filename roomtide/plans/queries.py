"""The registered queries: each runs one flow over the whole `events` table.

Processing times and file paths differ from run to run and are left out, timestamps are shown
without a zone, and sums of doubles are rounded because their last digits depend on the order of
addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtide import schemas
from roomtide.config import child
from roomtide.operators import daily, messages, replay, serving
from roomtide.operators.bronze import decode_envelope, to_bronze, unparsed_by_topic
from roomtide.operators.hour_states import hour_states, hours_of_states, merge_states
from roomtide.operators.hourly import hourly_metrics
from roomtide.operators.silver import quality_by_sensor, to_silver
from roomtide.plans import events_feed as feed
from roomtide.plans.gold import refresh_gold
from roomtide.session import pin_utc
from roomtide.sources import hour_table, raw_csv, tables
from roomtide.sources.scratch import scratch_path, stored
from roomtide.streaming import counts, gold, layers
from roomtide.streaming.bronze_batches import start_bronze_batches

Query = Callable[[SparkSession, str], DataFrame]

_RUN_DEPENDENT = ["ingest_ts", "ingest_date", "created_at", "source_file"]
_DATE = "2013-08-24"
_TIMEWARP_FACTOR = 10.0
_RATE = 5.0


def _shown(df: DataFrame) -> DataFrame:
    kept = df.drop(*_RUN_DEPENDENT)
    return kept.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in kept.dtypes
        ]
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(name, digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def _silver_shown(silver: DataFrame) -> DataFrame:
    """`value_raw` as a number: engines print doubles differently."""
    return _shown(silver).withColumn("value_raw", F.col("value_raw").cast("double"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.events(pin_utc(spark), sf_dir)


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows straight from messages, so of no file."""
    bronze = to_bronze(feed.envelope(_events(spark, sf_dir)))
    return bronze.withColumn("source_file", F.lit(None).cast("string"))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_silver(_bronze(spark, sf_dir))


def _silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silver table, written from messages through bronze and read back from its root."""
    root = scratch_path(spark, "silver")
    tables.write_partitioned(_silver(spark, sf_dir), root)
    return tables.read_silver(spark, root)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_metrics(_silver(spark, sf_dir))


def _raw_folder(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "raw")
    feed.write_raw_files(_events(spark, sf_dir), root)
    return root


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of raw CSV files, each cut into several splits."""
    return messages.to_readings(raw_csv.read_rows(spark, _raw_folder(spark, sf_dir)))


def envelope_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_envelope(feed.envelope(_events(spark, sf_dir)))
    named = decoded.withColumn(
        "named", F.from_json("value_str", "room string, sensor string")
    )
    return _shown(named.select("key", "named.*", "topic", "partition", "offset", "kafka_ts"))


def bronze_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_bronze(spark, sf_dir))


def bronze_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth message is not JSON."""
    envelope = feed.envelope(_events(spark, sf_dir))
    broken = F.when(F.col("offset") % 4 == 0, F.lit("not json").cast("binary"))
    damaged = envelope.withColumn("value", F.coalesce(broken, F.col("value")))
    return unparsed_by_topic(to_bronze(damaged))


def _run_bronze(spark: SparkSession, envelope: DataFrame, root: str, checkpoint: str) -> None:
    layers.start_bronze(envelope, root, checkpoint, available_now=True).awaitTermination()


def _streamed_bronze(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "bronze")
    envelope = feed.envelope(feed.events_stream(pin_utc(spark), sf_dir))
    _run_bronze(spark, envelope, root, scratch_path(spark, "bronze-checkpoint"))
    return root


def bronze_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tables.read_bronze(spark, _streamed_bronze(spark, sf_dir)))


def bronze_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the messages arrive before the stream first runs, the others before it is started
    again from its checkpoint; a third start finds nothing new."""
    log, root, checkpoint = (
        scratch_path(spark, name) for name in ("log", "bronze", "bronze-checkpoint")
    )
    half = F.col("event_id") % 2
    for arriving in (half == 0, half != 0, None):
        if arriving is not None:
            _events(spark, sf_dir).where(arriving).write.mode("append").parquet(log)
        source = spark.readStream.schema(feed.EVENTS).parquet(log)
        _run_bronze(spark, feed.envelope(source), root, checkpoint)
    return _shown(tables.read_bronze(spark, root))


def bronze_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages arrive in two parts; each batch is one folder of the table, rebalanced."""
    log, root, checkpoint = (scratch_path(spark, n) for n in ("log", "bronze", "bronze-checkpoint"))
    half = F.col("event_id") % 2
    for arriving in (half == 0, half != 0):
        _events(spark, sf_dir).where(arriving).write.mode("append").parquet(log)
        envelope = feed.envelope(spark.readStream.schema(feed.EVENTS).parquet(log))
        start_bronze_batches(envelope, root, checkpoint, available_now=True).awaitTermination()
    return _shown(tables.read_bronze(spark, root))


def bronze_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth message is not JSON, every fourth has a clock in quotes; a stream keeps their text
    on the side."""
    root, rejects = scratch_path(spark, "bronze"), scratch_path(spark, "rejects")
    envelope = feed.envelope(feed.events_stream(pin_utc(spark), sf_dir))
    number = F.col("offset").cast("string")
    broken = F.when(F.col("offset") % 4 == 0, F.concat(F.lit("not json "), number)).when(
        F.col("offset") % 4 == 1, F.concat(F.lit('{"room": "101", "ts": "'), number, F.lit('"}'))
    )
    damaged = envelope.withColumn("value", F.coalesce(broken.cast("binary"), F.col("value")))
    checkpoint = scratch_path(spark, "bronze-checkpoint")
    start_bronze_batches(damaged, root, checkpoint, rejects, available_now=True).awaitTermination()
    return _shown(tables.read_table(spark, rejects, schemas.REJECT)).drop("kafka_ts")


def bronze_stray_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that no stream committed lies in a leaf of a stream-written table; read from its root,
    the table is what the stream committed."""
    root = _streamed_bronze(spark, sf_dir)
    stray = child(root, "room=101", "sensor=co2", f"event_date={_DATE}")
    inside = [c for c in schemas.BRONZE.fieldNames() if c not in schemas.BRONZE_PARTITIONS]
    copies = tables.read_bronze(spark, root).where("room = '101' AND sensor = 'co2'").select(*inside)
    stored(copies, "stray").write.mode("append").parquet(stray)
    return _shown(tables.read_bronze(spark, root))


def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_shown(_silver(spark, sf_dir))


def silver_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms missing on every second row, sensor types missing or in capitals on others."""
    bronze = _bronze(spark, sf_dir)
    number = F.col("offset")
    path = F.concat(F.lit("s3a://lake/bronze/room="), "room", F.lit("/sensor="), "sensor")
    damaged = bronze.withColumns(
        {
            "source_file": path,
            "room": F.when(number % 2 == 0, F.col("room")),
            "sensor": F.when(number % 3 == 1, F.upper("sensor")).when(
                number % 3 == 2, F.col("sensor")
            ),
        }
    )
    return _silver_shown(to_silver(damaged)).select(
        "room", "sensor_type", "sensor_id", "ts_unix", "value_clean", "unit"
    )


def silver_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = layers.read_bronze_stream(spark, _streamed_bronze(spark, sf_dir))
    root = scratch_path(spark, "silver")
    layers.start_silver(
        bronze, root, scratch_path(spark, "silver-checkpoint"), available_now=True
    ).awaitTermination()
    return _silver_shown(tables.read_silver(spark, root))


def silver_from_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream-written bronze table read leaf by leaf: rooms come from the files' paths, sensor types
    from the topics, days from the clocks."""
    bronze = tables.read_bronze_leaves(spark, _streamed_bronze(spark, sf_dir))
    return _silver_shown(to_silver(bronze))


def silver_one_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of a silver table."""
    root = scratch_path(spark, "silver")
    tables.write_partitioned(_silver(spark, sf_dir), root)
    return _silver_shown(tables.read_silver(spark, root, _DATE))


def silver_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_by_sensor(_silver(spark, sf_dir))


def hourly_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_shown(_hourly(spark, sf_dir)))


def hourly_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of every hour arrive in three batches. Their states are stored one by one, the
    first two merged into a base meanwhile, and the hours made from states alone."""
    root = scratch_path(spark, "states")
    bronze = _bronze(spark, sf_dir)
    for batch in range(3):
        part = to_silver(bronze.where(F.col("offset") % 3 == batch))
        hour_table.add_batch(hour_states(part), root, batch)
        if batch == 1:
            hour_table.compact(spark, root, batch)
    merged = merge_states(hour_table.read_states(spark, root))
    return _rounded(_shown(hours_of_states(merged)))


def daily_room_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_shown(daily.daily_room_metrics(_hourly(spark, sf_dir))))


def daily_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = stored(_hourly(spark, sf_dir), "hours")
    return _rounded(_shown(daily.daily_by_joins(hours)))


def _gold_tables(
    spark: SparkSession, sf_dir: str, event_date: str | None, mode: str = "overwrite"
) -> tuple[str, str]:
    """Gold refreshed twice from a silver table; the second run replaces the first or adds to it."""
    silver, hourly, days = (scratch_path(spark, name) for name in ("silver", "hourly", "daily"))
    tables.write_partitioned(_silver(spark, sf_dir), silver)
    for _ in range(2):
        refresh_gold(spark, silver, hourly, days, event_date, mode)
    return hourly, days


def gold_hourly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly, _ = _gold_tables(spark, sf_dir, None)
    return _rounded(_shown(tables.read_hourly(spark, hourly)))


def gold_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, days = _gold_tables(spark, sf_dir, None)
    return _rounded(_shown(tables.read_daily(spark, days)))


def gold_one_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, days = _gold_tables(spark, sf_dir, _DATE)
    return _rounded(_shown(tables.on_date(tables.read_daily(spark, days), _DATE)))


def gold_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, days = _gold_tables(spark, sf_dir, None, mode="append")
    return _rounded(_shown(tables.read_daily(spark, days)))


def gold_day_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day goes from silver after gold was made, and is refreshed."""
    silver, hourly, days = (scratch_path(spark, name) for name in ("silver", "hourly", "daily"))
    rows = _silver(spark, sf_dir)
    for kept in (rows, rows.where(F.col("event_date") != F.lit(_DATE).cast("date"))):
        tables.write_partitioned(kept, silver, whole=True)
        refresh_gold(spark, silver, hourly, days, None if kept is rows else _DATE)
    return _rounded(_shown(tables.read_daily(spark, days)))


def gold_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver grows three times by readings of every hour, and a gold stream follows it. At the end
    the last batch comes again, as after a failure, and changes nothing."""
    silver, states, hourly, days, checkpoint = (
        scratch_path(spark, name) for name in ("silver", "states", "hourly", "daily", "checkpoint")
    )
    bronze = _bronze(spark, sf_dir)
    for batch in range(3):
        part = to_silver(bronze.where(F.col("offset") % 3 == batch))
        tables.write_partitioned(part, silver, mode="append")
        stream = gold.read_silver_stream(spark, silver)
        gold.start_gold(
            stream, states, hourly, days, checkpoint, available_now=True, compact_every=2
        ).awaitTermination()
    gold.apply_batch(stored(part, "again"), 2, states, hourly, days)
    return _rounded(_shown(tables.read_daily(spark, days)))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.rooms(_silver_table(spark, sf_dir))


def sensor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.sensor_types(_silver_table(spark, sf_dir))


def sensor_types_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.sensor_types(_silver_table(spark, sf_dir), event_date=None)


def readings_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(serving.readings(_silver_table(spark, sf_dir), _DATE))


def readings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = serving.readings(
        _silver_table(spark, sf_dir),
        _DATE,
        room="103",
        sensor_type="humidity",
        from_ts="2013-08-24T06:00:00",
        to_ts="2013-08-24T20:00:00Z",
        only_valid=False,
        limit=1000,
    )
    return _shown(page)


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_csv.read_rows(spark, _raw_folder(spark, sf_dir))
    return messages.to_readings(rows).select("room", "sensor", "ts", "value")


def csv_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room that no file is of."""
    rows = raw_csv.read_rows(spark, _raw_folder(spark, sf_dir), rooms=["no such room"])
    return messages.to_readings(rows).select("room", "sensor", "ts", "value")


def csv_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_csv.read_rows(
        spark, _raw_folder(spark, sf_dir), rooms=["101", "103", "105"], sensors=["CO2", "pir"]
    )
    return messages.to_readings(rows).select("room", "sensor", "ts", "value")


def csv_allow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rooms and sensor types that are wanted come as a table made of the events."""
    pairs = feed.readings(_events(spark, sf_dir)).where("room IN ('101', '104') AND sensor <> 'pir'")
    allowed = stored(pairs.select("room", F.upper("sensor").alias("sensor")), "allowed")
    rows = raw_csv.read_rows(spark, _raw_folder(spark, sf_dir), allowed=allowed)
    return messages.to_readings(rows).select("room", "sensor", "ts", "value")


def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.rejected_by_sensor(raw_csv.read_rows(spark, _raw_folder(spark, sf_dir)))


def csv_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = raw_csv.list_entries(spark, _raw_folder(spark, sf_dir))
    return replay.stream_index(entries).select("room", "sensor", "stream_idx")


def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = messages.to_messages(_readings(spark, sf_dir))
    parsed = sent.select("topic", "key", F.from_json("json", schemas.PAYLOAD).alias("payload"))
    fields = [F.col(f"payload.{f}").alias(f"json_{f}") for f in schemas.PAYLOAD.fieldNames()]
    return parsed.select("topic", "key", *fields)


def message_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.to_messages(_readings(spark, sf_dir)).select("topic", "key", "json")


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw files to published messages as the replay job makes them: ingested, scheduled in
    file order, put in one sequence, written and read back."""
    schedule = replay.merged(replay.timewarp(_readings(spark, sf_dir), _TIMEWARP_FACTOR))
    sent = messages.to_messages(schedule)
    log = stored(messages.as_kafka(sent), "log")
    payload = F.from_json("value", schemas.PAYLOAD).alias("payload")
    place = F.col("headers")[0]["value"].cast("string").cast("bigint").alias("position")
    return log.select("topic", "key", payload, place).select(
        "topic", "key", "payload.ts", "payload.value", "position"
    )


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.message_counts(_readings(spark, sf_dir))


def message_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while they arrive, half of the readings before the stream is started again."""
    log, root, checkpoint = (scratch_path(spark, name) for name in ("log", "counts", "checkpoint"))
    arriving = stored(_readings(spark, sf_dir).select("room", "sensor", "ts", "value"), "readings")
    half = F.xxhash64("room", "sensor", "ts", "value") % 2
    for part in (half == 0, half != 0):
        arriving.where(part).write.mode("append").parquet(log)
        stream = spark.readStream.schema(arriving.schema).parquet(log)
        counts.start_counts(stream, root, checkpoint, available_now=True).awaitTermination()
    return counts.read_counts(spark, root)


def _schedule_shown(schedule: DataFrame) -> DataFrame:
    return schedule.drop("split", "line", "path", "elapsed")


def replay_timewarp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule_shown(replay.timewarp(_readings(spark, sf_dir), _TIMEWARP_FACTOR))


def replay_timewarp_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule_shown(replay.timewarp_by_time(_readings(spark, sf_dir), _TIMEWARP_FACTOR))


def replay_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = replay.timewarp(_readings(spark, sf_dir), _TIMEWARP_FACTOR)
    return _schedule_shown(replay.merged(schedule))


def replay_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule_shown(replay.rate(_readings(spark, sf_dir), _RATE))


ALL: dict[str, Query] = {
    query.__name__: query
    for query in (
        envelope_decode,
        bronze_parse,
        bronze_unparsed,
        bronze_stream,
        bronze_restart,
        bronze_batches,
        bronze_rejects,
        bronze_stray_file,
        silver_clean,
        silver_repair,
        silver_stream,
        silver_from_leaves,
        silver_one_date,
        silver_quality,
        hourly_kpis,
        hourly_merged,
        daily_room_metrics,
        daily_join_chain,
        gold_hourly_table,
        gold_daily_table,
        gold_one_date,
        gold_appended,
        gold_day_removed,
        gold_late_rows,
        rooms,
        sensor_types,
        sensor_types_any_date,
        readings_default,
        readings_filtered,
        csv_ingest,
        csv_no_match,
        csv_allow_list,
        csv_allow_table,
        csv_rejected,
        csv_streams,
        message_fields,
        message_bytes,
        message_log,
        message_counts,
        message_counts_stream,
        replay_timewarp,
        replay_timewarp_by_time,
        replay_merged,
        replay_rate,
    )
}
