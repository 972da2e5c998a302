"""Streams written batch by batch: bronze with its rejects, running counts; leaf reads; allow-list tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from roomtide import schemas
from roomtide.functions.messages import json_number, json_text, message_json
from roomtide.operators import messages
from roomtide.operators.bronze import rejected_messages, to_bronze
from roomtide.operators.silver import to_silver
from roomtide.sources import raw_csv, tables
from roomtide.streaming import counts, layers
from roomtide.streaming.bronze_batches import start_bronze_batches, write_batch
from tests.test_bronze_silver import envelope
from tests.test_raw_csv import write

RUN_COLUMNS = ("ingest_ts", "source_file")


def many(spark, n, rooms=4):
    """Messages of `rooms` rooms, one of which has most, in 100 partitions."""
    room = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % rooms).cast("string")
    ts = F.lit(1377216000) + F.col("id") % 1000
    return spark.range(n).select(
        F.lit(b"k").alias("key"),
        message_json(room, F.lit("co2"), ts, F.col("id").cast("double")).cast("binary").alias("value"),
        F.lit("iot.co2").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
        F.timestamp_seconds(F.lit(0)).alias("timestamp"),
    ).repartition(100)


def data_files(root):
    return [
        os.path.join(at, name)
        for at, _, names in os.walk(root)
        for name in names
        if name.endswith(".parquet")
    ]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.drop(*RUN_COLUMNS).collect())


def test_a_batch_of_100_tasks_writes_one_file_a_value(spark, folder):
    assert write_batch(many(spark, 2000), 0, folder)
    files = data_files(folder)
    leaves = [os.path.dirname(f) for f in files]
    assert len(files) == len(set(leaves)) == 4
    assert rows(tables.read_bronze(spark, folder)) == rows(to_bronze(many(spark, 2000)))


def test_a_value_above_the_target_size_is_split(spark, folder):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        write_batch(many(spark, 20_000), 0, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f.split("room=")[1][0] for f in data_files(folder)]
    assert files.count("0") > 3
    assert tables.read_bronze(spark, folder).count() == 20_000


def test_a_batch_that_comes_again_adds_nothing(spark, folder):
    assert write_batch(many(spark, 50), 0, folder)
    # Left by a run that failed while it wrote.
    many(spark, 5).write.parquet(f"{folder}/_writing-batch-1")
    before = set(data_files(f"{folder}/batch=0"))
    assert not write_batch(many(spark, 50), 0, folder)
    assert set(data_files(f"{folder}/batch=0")) == before
    assert tables.read_bronze(spark, folder).count() == 50
    assert write_batch(many(spark, 30), 1, folder)
    assert tables.read_bronze(spark, folder).count() == 80


def test_restarted_stream_and_silver_after_it(spark, folder):
    for part in (0, 1):
        many(spark, 300).where(F.col("offset") % 2 == part).write.mode("append").parquet(f"{folder}/log")
        source = spark.readStream.schema(schemas.ENVELOPE).parquet(f"{folder}/log")
        start_bronze_batches(
            source, f"{folder}/bronze", f"{folder}/checkpoint", available_now=True
        ).awaitTermination()
    assert rows(tables.read_bronze(spark, f"{folder}/bronze")) == rows(to_bronze(many(spark, 300)))
    layers.start_silver(
        layers.read_bronze_stream(spark, f"{folder}/bronze"), f"{folder}/silver", f"{folder}/c2",
        available_now=True,
    ).awaitTermination()
    silver = tables.read_silver(spark, f"{folder}/silver")
    assert silver.count() == 300 and silver.where("room IS NULL OR sensor_type <> 'co2'").count() == 0


TEXTS = [
    '{"room": "101", "sensor": "co2", "ts": 1377301234, "value": 612.5}',
    "not json",
    '{"room": "101", "sensor": "co2", "ts": "1377301234", "value": 1}',
    '{"room": "101", "value": NaN}',
    "{}",
    "[1, 2]",
    '{"room": "101"',
    "",
    None,
]


def test_rejects(spark, folder):
    source = envelope(spark, *[t for t in TEXTS if t is not None]).unionByName(
        envelope(spark, "x").withColumn("value", F.lit(None).cast("binary"))
    )
    assert rejected_messages(source).columns == schemas.REJECT.fieldNames()
    expected = {"not json", TEXTS[2], "[1, 2]", '{"room": "101"', "", None}
    found = [r.text for r in rejected_messages(source).collect()]
    assert set(found) == expected and len(found) == len(expected)
    write_batch(source, 0, f"{folder}/bronze", f"{folder}/rejects")
    write_batch(source, 0, f"{folder}/bronze", f"{folder}/rejects")
    kept = tables.read_table(spark, f"{folder}/rejects", schemas.REJECT)
    assert {r.text for r in kept.collect()} == expected and kept.count() == len(expected)
    # They are in bronze too, as before.
    assert tables.read_bronze(spark, f"{folder}/bronze").count() == len(TEXTS)


def counted(spark, folder):
    found = counts.read_counts(spark, f"{folder}/counts").collect()
    return {(r.sensor, r.is_total): r.nb_messages for r in found}


def test_running_counts(spark, folder):
    assert counted(spark, folder) == {}
    for sent in (["co2", "co2", "pir"], ["co2"], ["humidity", "pir", None]):
        spark.createDataFrame([(s,) for s in sent], "sensor string").write.mode("append").parquet(
            f"{folder}/log"
        )
        stream = spark.readStream.schema("sensor string").parquet(f"{folder}/log")
        counts.start_counts(
            stream, f"{folder}/counts", f"{folder}/checkpoint", available_now=True
        ).awaitTermination()
    expected = {("co2", False): 3, ("pir", False): 2, ("humidity", False): 1, (None, False): 1, (None, True): 7}
    assert counted(spark, folder) == expected
    assert len(tables.numbered_folders(spark, f"{folder}/counts", "batch")) <= 2
    # The last batch comes again after a failure.
    last = tables.numbered_folders(spark, f"{folder}/counts", "batch")[-1]
    again = spark.createDataFrame([("humidity", 1), ("pir", 2), (None, 1)], schemas.MESSAGE_COUNT)
    counts.update_counts(again, last, f"{folder}/counts")
    assert counted(spark, folder) == expected


def test_leaves_have_no_partition_values(spark, folder):
    tables.write_partitioned(to_bronze(many(spark, 40)), folder, *schemas.BRONZE_PARTITIONS)
    leaves = tables.read_bronze_leaves(spark, folder)
    assert leaves.where("room IS NULL AND sensor IS NULL AND event_date IS NULL").count() == 40
    columns = ("room", "sensor_type", "event_date", "ts_unix", "value_clean")
    by_leaf, by_root = (
        sorted(tuple(r) for r in to_silver(df).select(*columns).collect())
        for df in (leaves, tables.read_bronze(spark, folder))
    )
    assert by_leaf == by_root
    layers.start_silver(
        layers.read_bronze_leaf_stream(spark, folder), f"{folder}-silver", f"{folder}-checkpoint",
        available_now=True,
    ).awaitTermination()
    streamed = tables.read_silver(spark, f"{folder}-silver").select(*columns)
    assert sorted(tuple(r) for r in streamed.collect()) == by_root


def test_allow_list_tables(spark, folder):
    for room in ("101", "102", "room a+b"):
        for name in ("co2", "PIR motion", "temp"):
            write(folder, f"{room}/{name}.csv", ["1,1"])

    def entries(names, schema):
        allowed = spark.createDataFrame(names, schema)
        kept = raw_csv.list_entries(spark, folder, allowed=allowed)
        found = {(r.room, r.sensor) for r in kept.collect()}
        read = messages.to_readings(raw_csv.read_rows(spark, folder, allowed=allowed)).collect()
        assert sorted((r.room, r.sensor) for r in read) == sorted(found)
        return found

    assert entries([("101",), ("room a+b",), ("999",), (None,), ("101",)], "room string") == {
        (room, s) for room in ("101", "room a+b") for s in ("co2", "pir", "temperature")
    }
    assert entries([("CO2",)], "sensor string") == {(r, "co2") for r in ("101", "102", "room a+b")}
    assert entries([(102, "pir"), (101, "x")], "room int, sensor string") == {("102", "pir")}
    assert entries([], "room string") == set()
    many_rooms = [(str(n),) for n in range(10_000)]
    assert len(entries(many_rooms, "room string")) == 6
    with pytest.raises(ValueError):
        entries([(1,)], "floor int")


NUMBERS = [
    0.0, -0.0, 1.0, 488.0, -273.15, 1e7, 12345678.9, 123456789012345.6, 1e15, 1e16, 1.5e16, 1e100,
    -1e22, 1e-3, 9.99e-4, 1e-4, -0.00025, 1e-5, 2.5e-7, 1e-300, 1.7976931348623157e308,
    float("nan"), float("inf"), float("-inf"),
]


def test_numbers_as_json_text(spark):
    df = spark.createDataFrame([(v,) for v in NUMBERS], "v double")
    assert [r[0] for r in df.select(json_number(F.col("v"))).collect()] == [json.dumps(v) for v in NUMBERS]


def test_texts_as_json_text(spark):
    texts = ["101", "a b", 'q"uo\\te', "tab\t\n\r\b\f\x01", "é日🙂", "", "\x7f", "a/b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(json_text(F.col("t"))).collect()] == [json.dumps(t) for t in texts]


def test_messages_are_the_bytes_of_a_json_writer(spark):
    sent = [
        ("101", "co2", 1377299108, 488.0),
        ("a b", "pir", 1, 1.0),
        ("1", "pir", 1, -2.0),
        ("1", "humidity", -5, float("nan")),
        ("1", "co2", 0, float("-inf")),
        (None, None, None, None),
        ("é", "x", 2**53, 2e-5),
    ]
    df = spark.createDataFrame(sent, "room string, sensor string, ts bigint, value double")
    text = message_json(F.col("room"), F.col("sensor"), F.col("ts"), F.col("value"))
    expected = [
        json.dumps({"room": r, "sensor": s, "ts": t, "value": int(v) if s == "pir" else v})
        for r, s, t, v in sent
    ]
    assert [r[0] for r in df.select(text).collect()] == expected
    parsed = df.select(F.from_json(text, schemas.PAYLOAD).alias("p")).select("p.*").collect()
    assert repr(parsed) == repr(df.collect())
