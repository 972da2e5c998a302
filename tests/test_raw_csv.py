import json
import math
import os

import pytest
from pyspark.sql import functions as F

from roomtide.functions import text
from roomtide.functions.timeline import epoch_seconds
from roomtide.operators import messages
from roomtide.sources import raw_csv


def write(root, entry, lines):
    path = os.path.join(root, entry)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(f"{line}\n" for line in lines))


@pytest.fixture
def raw(folder):
    write(folder, "101/co2.csv", ["ts,value", "1377216000,400.5", "5", "1377216005,", "x,1", "1377216010,abc"])
    write(folder, "101/Temperature_light.csv", ["1377299108123,7"])
    write(folder, "102/PIR motion.csv", ["1377299108123456,1.9", "1377299109,-1.9", "1377299110,nan", "1377299111,7,extra"])
    write(folder, "room a+b/rH.csv", ["1377216000,NaN", "1377216001,inf", "1_377_216_002,1e3", "1377216003,1d"])
    write(folder, "102/pressure.csv", ["1377216000,1"])
    write(folder, "102/deeper/co2.csv", ["1377216000,1"])
    return folder


def readings(spark, root, **wanted):
    rows = messages.to_readings(raw_csv.read_rows(spark, root, **wanted))
    return {(r.room, r.sensor, r.ts, str(r.value)) for r in rows.collect()}


EXPECTED = {
    ("101", "co2", 1377216000, "400.5"),
    ("101", "luminosity", 1377299108, "7.0"),
    ("102", "pir", 1377299108, "1.0"),
    ("102", "pir", 1377299109, "-1.0"),
    ("102", "pir", 1377299111, "7.0"),
    ("room a+b", "humidity", 1377216000, "nan"),
    ("room a+b", "humidity", 1377216001, "inf"),
    ("room a+b", "humidity", 1377216002, "1000.0"),
}


def test_readings_of_a_folder(spark, raw):
    assert readings(spark, raw) == EXPECTED


def test_allow_lists(spark, raw):
    assert readings(spark, raw, rooms=["101"]) == {r for r in EXPECTED if r[0] == "101"}
    assert readings(spark, raw, sensors=["PIR", "humidity"]) == {
        r for r in EXPECTED if r[1] in ("pir", "humidity")
    }
    # The name holds an alias of temperature as well, but luminosity is looked for first.
    assert readings(spark, raw, sensors=["temperature"]) == set()


def test_no_entry_matches(spark, raw):
    empty = raw_csv.read_rows(spark, raw, rooms=["404"])
    full = raw_csv.read_rows(spark, raw)
    assert empty.dtypes == full.dtypes
    assert empty.count() == 0
    assert raw_csv.list_entries(spark, raw, rooms=["404"]).count() == 0
    assert raw_csv.read_rows(spark, f"{raw}/nowhere").count() == 0


def test_only_partition_names_are_stripped(spark, folder):
    for room in ("x=5", "room=7"):
        write(folder, f"{room}/co2.csv", ["10,1"])
    assert {r[0] for r in readings(spark, folder)} == {"x=5", "7"}
    assert {r[0] for r in readings(spark, folder, rooms=["x=5"])} == {"x=5"}
    assert {r[0] for r in readings(spark, folder, rooms=["7"])} == {"7"}


def test_reading_and_counting_start_no_job_and_parse_once(spark, raw):
    spark.sparkContext.setJobGroup("planning", "planning")
    rows = messages.to_readings(raw_csv.read_rows(spark, raw))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    assert "Join" not in plan and "Exchange" not in plan
    # Once in the generator; the filter above it only compares.
    assert plan.count("ts_raw#") and plan.split("Generate inline", 1)[0].count("try_cast") <= 1


def test_unwanted_files_are_not_input(spark, raw):
    rows = raw_csv.read_rows(spark, raw, rooms=["101"], sensors=["co2"])
    assert {os.path.basename(f) for f in rows.inputFiles()} == {"co2.csv"}


def test_entries_in_path_order(spark, raw):
    entries = raw_csv.list_entries(spark, raw).collect()
    assert [(e.room, e.sensor) for e in entries] == [
        ("101", "luminosity"), ("101", "co2"), ("102", "pir"), ("room a+b", "humidity"),
    ]
    assert entries[3].path.endswith("/room a+b/rH.csv")


def test_folders_of_part_files_are_one_entry(spark, folder):
    df = spark.range(20).select(
        (F.lit(1377216000) + F.col("id")).alias("ts"), F.col("id").alias("v"),
        F.lit("101").alias("room"), F.lit("temp.csv").alias("file"),
    )
    df.repartition(4).write.mode("append").partitionBy("room", "file").csv(folder)
    rows = raw_csv.read_rows(spark, folder)
    assert rows.select("room", "sensor").distinct().collect() == [("101", "temperature")]
    assert rows.select("path").distinct().count() == 1
    assert rows.count() == 20


def test_lines_follow_the_file_across_splits(spark, folder):
    write(folder, "101/co2.csv", [f"{1377216000 + (i * 7) % 1000},{i}" for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = raw_csv.read_rows(spark, folder)
        assert rows.select("split").distinct().count() > 5
        ordered = rows.orderBy("split", "line").select("value_raw").collect()
        assert [int(r.value_raw) for r in ordered] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rejected_rows_are_counted(spark, raw):
    counts = messages.rejected_by_sensor(raw_csv.read_rows(spark, raw))
    assert {tuple(r) for r in counts.collect()} == {
        ("co2", 6, 5), ("luminosity", 1, 0), ("pir", 4, 1), ("humidity", 4, 1),
    }


@pytest.mark.parametrize(
    ("given", "seconds"),
    [("1000000000000", 1000000000000), ("1377299108123", 1377299108),
     ("1000000000000000", 1000000000000), ("1377299108123456", 1377299108),
     ("1377299108.9", 1377299108), ("-1.9", -1), (" 12 ", 12), ("1e3", 1000), ("+5", 5),
     (".5", 0), ("5.", 5), ("1__0", None), ("_1", None), ("1f", None), ("1_000", 1000),
     ("1_.5", None), ("1._5", None), ("1e1_0", 10000000000), ("1e400", None), ("0x10", None), ("nan", None),
     ("inf", None), ("", None), ("1,5", None)],
)
def test_epochs(spark, given, seconds):
    row = spark.createDataFrame([(given,)], "ts_raw string").select(
        text.finite_number(F.col("ts_raw")).alias("epoch")
    )
    kept = row.where(text.is_epoch(F.col("epoch"))).select(epoch_seconds(F.col("epoch")))
    assert [r[0] for r in kept.collect()] == ([] if seconds is None else [seconds])


@pytest.mark.parametrize(
    ("sensor", "given", "value"),
    [("co2", "488", 488.0), ("co2", " -1.5e2 ", -150.0), ("co2", "INFINITY", math.inf),
     ("co2", "-inf", -math.inf), ("co2", "+nan", math.nan), ("co2", "n", None),
     ("co2", "1f", None), ("co2", "info", None), ("co2", "", None), ("co2", None, None),
     ("pir", "1.9", 1.0), ("pir", "-1.9", -1.0), ("pir", "-0.5", 0.0), ("pir", "1e300", 1e300),
     ("pir", "inf", None), ("pir", "nan", None)],
)
def test_values(spark, sensor, given, value):
    rows = spark.createDataFrame([(sensor, "0", given)], "sensor string, ts_raw string, value_raw string")
    got = [r.value for r in messages.to_readings(rows).collect()]
    assert repr(got) == repr([] if value is None else [value])


@pytest.mark.parametrize(
    ("name", "sensor"),
    [("co2", "co2"), ("temperature_light", "luminosity"), ("motion", "pir"), ("temp co2", "co2"),
     ("humidity", "humidity"), ("hum", "humidity"), ("north", None), ("rh", "humidity"),
     ("luminosity", "luminosity"), ("pressure", None), ("", None), ("$1", None)],
)
def test_sensor_names(spark, name, sensor):
    found = text.sensor_from_name(F.lit(name))
    assert spark.range(1).select(found.alias("s")).first().s == sensor


def test_messages(spark):
    rows = spark.createDataFrame(
        [("205", "co2", 1377301234, 612.5, 1), ("102", "pir", 5, 1.0, 2), ("103", "noise", 6, math.nan, 3)],
        "room string, sensor string, ts bigint, value double, position bigint",
    )
    sent = messages.as_kafka(messages.to_messages(rows)).collect()
    assert [(m.topic, m.key) for m in sent] == [
        ("iot.co2", "205:co2"), ("iot.pir", "102:pir"), ("iot.sensor", "103:noise"),
    ]
    assert json.loads(sent[0].value) == {"room": "205", "sensor": "co2", "ts": 1377301234, "value": 612.5}
    assert [(h.key, bytes(h.value)) for m in sent for h in m.headers] == [
        ("position", b"1"), ("position", b"2"), ("position", b"3"),
    ]
    assert sent[1].value == '{"room": "102", "sensor": "pir", "ts": 5, "value": 1}'
    from roomtide.operators.bronze import to_bronze
    from tests.test_bronze_silver import envelope

    assert math.isnan(to_bronze(envelope(spark, sent[2].value)).first().value)


def test_own_topics(spark):
    rows = spark.createDataFrame([("1", "pir", 1, 1.0)], "room string, sensor string, ts bigint, value double")
    assert messages.to_messages(rows, {"pir": "motion"}).first().topic == "motion"
    assert messages.to_messages(rows, {}, "all").first().topic == "all"


def test_message_counts(spark):
    rows = spark.createDataFrame([("co2",), ("co2",), ("pir",), (None,)], "sensor string")
    assert {tuple(r) for r in messages.message_counts(rows).collect()} == {
        ("co2", False, 2), ("pir", False, 1), (None, False, 1), (None, True, 4),
    }
