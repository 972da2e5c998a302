"""Schedules against a direct simulation of the two replay modes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from roomtide.config import Settings
from roomtide.jobs import replay as replay_job
from roomtide.operators import messages, replay, turns
from roomtide.operators.ordering import along_streams, number_rows, running_totals, stage_sorted
from roomtide.sources import raw_csv
from tests.test_raw_csv import write

READING = "room string, sensor string, path string, split bigint, line bigint, ts bigint, value double"


def streams(seed, count=6, longest=40):
    rng = random.Random(seed)
    return {
        f"{100 + i % 4}/s{i}.csv": [1000 + rng.randint(0, 300) for _ in range(rng.randint(1, longest))]
        for i in range(count)
    }


def frame(spark, clocks, split_rows=7):
    rows = [
        (path.split("/")[0], "co2", path, line // split_rows, line, ts, 0.0)
        for path, stream in clocks.items()
        for line, ts in enumerate(stream)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, READING)


def elapsed_by_hand(clocks):
    result = {}
    for path, stream in clocks.items():
        total = 0
        for line, ts in enumerate(stream):
            total += max(ts - stream[line - 1], 0) if line else 0
            result[path, line] = total
    return result


def by_time_by_hand(clocks):
    return {
        (path, line): ts - min(stream)
        for path, stream in clocks.items()
        for line, ts in enumerate(stream)
    }


def turns_by_hand(clocks):
    active, line, sent = sorted(clocks), 0, []
    while active:
        sent += [(path, line) for path in active]
        line += 1
        active = [path for path in active if len(clocks[path]) > line]
    return sent


@pytest.mark.parametrize("chunk", ["split", None])
@pytest.mark.parametrize("seed", [1, 2])
def test_timewarp(spark, seed, chunk):
    clocks = streams(seed)
    got = replay.timewarp(frame(spark, clocks), 10, chunk=chunk).collect()
    by_hand = elapsed_by_hand(clocks)
    assert {(r.path, r.line): r.elapsed for r in got} == by_hand
    assert len(got) == len(by_hand)
    assert all(r.send_offset == r.elapsed / 10 for r in got)


def test_timewarp_and_rate_without_broadcast_joins(spark):
    clocks = streams(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = replay.timewarp(frame(spark, clocks), 10)
        assert "SortMergeJoin" in moved._jdf.queryExecution().executedPlan().toString()
        by_time = replay.timewarp_by_time(frame(spark, clocks), 10)
        assert "SortMergeJoin" in by_time._jdf.queryExecution().executedPlan().toString()
        assert {(r.path, r.line): r.elapsed for r in by_time.collect()} == by_time_by_hand(clocks)
        assert {(r.path, r.line): r.elapsed for r in moved.collect()} == elapsed_by_hand(clocks)
        turns = replay.rate(frame(spark, clocks), 5).orderBy("position").collect()
        assert [(r.path, r.line) for r in turns] == turns_by_hand(clocks)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clock_stepping_back(spark):
    got = replay.timewarp(frame(spark, {"1/a.csv": [10, 5, 8]}, split_rows=2), 1).orderBy("line")
    assert [r.send_offset for r in got.collect()] == [0.0, 0.0, 3.0]


def test_factors_and_rates_below_one_count_as_one(spark):
    readings = frame(spark, {"1/a.csv": [10, 20]})
    assert replay.timewarp(readings, 0.1).agg(F.max("send_offset")).first()[0] == 10.0
    assert replay.timewarp_by_time(readings, 0.1).agg(F.max("send_offset")).first()[0] == 10.0
    assert replay.rate(readings, 0.5).agg(F.max("send_offset")).first()[0] == 1.0


def test_timewarp_by_time(spark):
    clocks = streams(3)
    got = replay.timewarp_by_time(frame(spark, clocks), 10).collect()
    assert {(r.path, r.line): r.elapsed for r in got} == by_time_by_hand(clocks)


def test_merged_sequence(spark):
    clocks = streams(4)
    by_hand = elapsed_by_hand(clocks)
    order = sorted(by_hand, key=lambda k: (by_hand[k], k[0], k[1]))
    got = replay.merged(replay.timewarp(frame(spark, clocks), 10)).orderBy("position").collect()
    assert [(r.path, r.line) for r in got] == order
    assert [r.position for r in got] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("chunk", ["split", None])
@pytest.mark.parametrize("seed", [5, 6])
def test_rate(spark, seed, chunk):
    clocks = streams(seed)
    got = replay.rate(frame(spark, clocks), 5, chunk=chunk).orderBy("position").collect()
    assert [(r.path, r.line) for r in got] == turns_by_hand(clocks)
    assert [r.send_offset for r in got] == [i / 5 for i in range(len(got))]
    assert all(r["round"] == r.line + 1 for r in got)


def test_rate_with_streams_of_unequal_length(spark):
    clocks = {"1/a.csv": [0], "1/b.csv": [0, 0], "1/c.csv": [0, 0]}
    got = replay.rate(frame(spark, clocks), 1).orderBy("position").collect()
    assert [(r.path[2], r["round"]) for r in got] == [("a", 1), ("b", 1), ("c", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_turns_in_many_steps(spark, span, monkeypatch):
    """Streams of all lengths, so that every stream has many steps, in pieces that spans cut."""
    monkeypatch.setattr(turns, "_SPAN", span)
    rng = random.Random(11)
    clocks = {f"{i}/s.csv": [0] * rng.choice([1, 2, 3, 7, 20, 21, 22, 40, i + 1]) for i in range(30)}
    got = replay.rate(frame(spark, clocks, split_rows=6), 1).orderBy("position").collect()
    assert [(r.path, r.line) for r in got] == turns_by_hand(clocks)
    assert [r.position for r in got] == list(range(1, len(got) + 1))


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.col("id").alias("v"))
    got = sorted(running_totals(df, ["k"], ["v"], "n").collect())
    total = 0
    for n, r in enumerate(got, 1):
        total += r.v
        assert (r.k, r.n, r.v_to) == (n - 1, n, total)


def test_one_stream_with_most_rows_is_spread_over_chunks(spark):
    clocks = {"1/a.csv": list(range(5000)), "1/b.csv": [1, 2], "1/c.csv": [3]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = stage_sorted(frame(spark, clocks), ["path", "line"])
        sizes = [r["count"] for r in staged.groupBy("chunk").count().collect()]
        assert len(sizes) > 4
        assert max(sizes) < 5003 / 3
        moved = along_streams(frame(spark, clocks), "path", ["line"]).where(F.col("path") == "1/a.csv")
        assert moved.where("elapsed != ts or round != line + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = number_rows(df, ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in got)
    assert len(got) == 1000


def test_stream_index(spark):
    entries = spark.createDataFrame(
        [("2", "co2", "r/2/b"), ("10", "pir", "r/10/a"), ("2", "pir", "r/2/a")],
        "room string, sensor string, path string",
    )
    assert {(r.path, r.stream_idx) for r in replay.stream_index(entries.union(entries)).collect()} == {
        ("r/10/a", 0), ("r/2/a", 1), ("r/2/b", 2),
    }


@pytest.mark.parametrize("mode", ["rate", "timewarp"])
def test_replay_job(spark, folder, monkeypatch, mode):
    write(folder, "raw/101/co2.csv", ["10,1", "30,2"])
    write(folder, "raw/102/pir.csv", ["5,1", "bad", "15,0", "20,1"])
    write(folder, "raw/102/temp.csv", ["5,1"])
    for name, value in {"SOURCE_URL": f"{folder}/raw", "REPLAY_MODE": mode, "TIMEWARP_FACTOR": "1"}.items():
        monkeypatch.setenv(name, value)
    counted = replay_job.main(["--to", f"{folder}/out"])
    assert counted == {
        "sent": {"co2": 2, "pir": 3}, "total": 5, "rejected": {"co2": 0, "pir": 1},
    }
    sent = spark.read.parquet(f"{folder}/out").orderBy("position").collect()
    expected = {
        "rate": ["101:co2", "102:pir", "101:co2", "102:pir", "102:pir"],
        "timewarp": ["101:co2", "102:pir", "102:pir", "102:pir", "101:co2"],
    }
    assert [r.key for r in sent] == expected[mode]
    assert {r.topic for r in sent} == {"iot.co2", "iot.pir"}
    assert Settings.from_env().sensors == ("co2", "pir")


def test_position_restores_the_order_of_a_key(spark, folder):
    """Rows reach a sink in any order; the header brings those of a key back in order."""
    for room in ("1", "2"):
        write(folder, f"{room}/co2.csv", [f"{1000 + 7 * k % 50},{k}" for k in range(200)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        readings = messages.to_readings(raw_csv.read_rows(spark, folder))
        sent = messages.as_kafka(messages.to_messages(replay.merged(replay.timewarp(readings, 10))))
        handed = sent.repartition(7).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    random.Random(3).shuffle(handed)
    handed.sort(key=lambda m: int(bytes(m.headers[0].value)))
    for key in ("1:co2", "2:co2"):
        values = [json.loads(m.value)["value"] for m in handed if m.key == key]
        assert values == list(range(200))


def test_a_job_leaves_no_scratch_tables(spark, folder, monkeypatch):
    write(folder, "raw/101/co2.csv", ["10,1", "30,2"])
    monkeypatch.setenv("SOURCE_URL", f"{folder}/raw")
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    replay_job.main(["--to", f"{folder}/out"])
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before


def test_an_empty_selection_sends_nothing(spark, folder, monkeypatch):
    write(folder, "raw/101/co2.csv", ["10,1"])
    monkeypatch.setenv("SOURCE_URL", f"{folder}/raw")
    monkeypatch.setenv("ROOMS", "999")
    assert replay_job.main(["--to", f"{folder}/out"]) == {"sent": {}, "total": 0, "rejected": {}}
