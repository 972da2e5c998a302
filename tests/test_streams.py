"""The streaming layers give the batch result, survive restarts and ignore stray files."""

import glob
import shutil

import pytest

from roomtide import schemas
from roomtide.jobs import silver as silver_job
from roomtide.operators.bronze import to_bronze
from roomtide.operators.silver import to_silver
from roomtide.sources import tables
from roomtide.streaming import layers
from tests.test_bronze_silver import envelope

TEXTS = [
    '{"room": "101", "sensor": "co2", "ts": 1377301234, "value": 612.5}',
    '{"room": "007", "sensor": "PIR", "ts": 1377216000, "value": NaN}',
    '{"room": "a b", "sensor": "humidity", "ts": 1377388800, "value": 41.5}',
    '{"sensor": "humidity", "ts": 1377388800, "value": 1}',
    "not json",
]
RUN_COLUMNS = ("ingest_ts", "ingest_date", "created_at", "source_file")


def rows(df):
    return sorted(repr(tuple(r)) for r in df.drop(*RUN_COLUMNS).collect())


@pytest.fixture
def log(spark, folder):
    def send(*texts):
        envelope(spark, *texts, topic="iot.humidity").coalesce(1).write.mode("append").parquet(f"{folder}/log")

    send(*TEXTS)
    return send


def run_bronze(spark, folder):
    source = spark.readStream.schema(schemas.ENVELOPE).parquet(f"{folder}/log")
    query = layers.start_bronze(
        source, f"{folder}/bronze", f"{folder}/checkpoints/bronze", available_now=True
    )
    query.awaitTermination()
    return query


def run_silver(spark, folder):
    layers.start_silver(
        layers.read_bronze_stream(spark, f"{folder}/bronze", max_files_per_batch=2),
        f"{folder}/silver", f"{folder}/checkpoints/silver", available_now=True,
    ).awaitTermination()


def test_stream_equals_batch(spark, folder, log):
    run_bronze(spark, folder)
    run_silver(spark, folder)
    batch = to_bronze(envelope(spark, *TEXTS, topic="iot.humidity"))
    assert rows(tables.read_bronze(spark, f"{folder}/bronze")) == rows(batch)
    streamed = tables.read_silver(spark, f"{folder}/silver")
    from_table = to_silver(tables.read_bronze(spark, f"{folder}/bronze"))
    assert rows(streamed) == rows(from_table)
    assert {r.room for r in streamed.collect()} == {
        "101", "007", "a b", "__HIVE_DEFAULT_PARTITION__",
    }


def test_restart_adds_only_what_is_new(spark, folder, log):
    run_bronze(spark, folder)
    run_silver(spark, folder)
    run_bronze(spark, folder)
    run_silver(spark, folder)
    assert tables.read_silver(spark, f"{folder}/silver").count() == len(TEXTS)
    log('{"room": "101", "sensor": "co2", "ts": 1377216000, "value": 1}')
    run_bronze(spark, folder)
    run_silver(spark, folder)
    assert tables.read_silver(spark, f"{folder}/silver").count() == len(TEXTS) + 1
    # A late reading lands on the day it was taken.
    late = tables.read_silver(spark, f"{folder}/silver", "2013-08-23").where("value_clean = 1")
    assert late.count() == 1


def test_batches_report_unparsed_messages(spark, folder, log):
    query = run_bronze(spark, folder)
    seen = [p["observedMetrics"]["bronze"] for p in query.recentProgress if p["numInputRows"]]
    assert [(m["nb_messages"], m["nb_unparsed"]) for m in seen] == [(5, 1)]


def test_uncommitted_files_stay_invisible(spark, folder, log):
    run_bronze(spark, folder)
    file = glob.glob(f"{folder}/bronze/room=101/*/*/*.parquet")[0]
    shutil.copy(file, file.replace("part-", "part-9"))
    assert tables.read_bronze(spark, f"{folder}/bronze").count() == len(TEXTS)
    run_silver(spark, folder)
    assert tables.read_silver(spark, f"{folder}/silver").count() == len(TEXTS)


def test_identifiers_are_recovered_where_partition_values_are_lost(spark, folder):
    """Read leaf by leaf, a partitioned table has no partition values."""
    good = [t for t in TEXTS if '"room"' in t and "a b" not in t]
    to_bronze(envelope(spark, *good, topic="iot.pir")).write.partitionBy(
        *schemas.BRONZE_PARTITIONS
    ).parquet(f"{folder}/bronze")
    leaves = tables.read_bronze(spark, f"{folder}/bronze/room=*/sensor=*/event_date=*")
    assert leaves.where("room is not null or sensor is not null").count() == 0
    silver = to_silver(leaves).select("room", "sensor_type").collect()
    assert {tuple(r) for r in silver} == {("101", "pir"), ("007", "pir")}


def test_silver_job(spark, folder, log, monkeypatch):
    run_bronze(spark, folder)
    monkeypatch.setenv("BRONZE_PATH", f"{folder}/bronze")
    monkeypatch.setenv("SILVER_PATH", f"{folder}/silver")
    monkeypatch.setenv("SILVER_CHECKPOINT_PATH", f"{folder}/checkpoints/silver")
    spark.streams.resetTerminated()
    silver_job.main(["--available-now"])
    assert tables.read_silver(spark, f"{folder}/silver").count() == len(TEXTS)


def test_batches_start_at_the_trigger_interval(spark, folder, log):
    source = spark.readStream.schema(schemas.ENVELOPE).parquet(f"{folder}/log")
    query = layers.start_bronze(
        source, f"{folder}/bronze", f"{folder}/checkpoints/bronze", trigger="1 second"
    )
    try:
        query.processAllAvailable()
        log('{"room": "9", "sensor": "co2", "ts": 1377216000, "value": 1}')
        query.processAllAvailable()
    finally:
        query.stop()
    assert tables.read_bronze(spark, f"{folder}/bronze").count() == len(TEXTS) + 1
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [len(TEXTS), 1]
