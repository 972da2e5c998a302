import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException

from roomtide import schemas
from roomtide.jobs import readings as readings_job
from roomtide.operators import serving
from roomtide.sources import tables

DAY = dt.date(2013, 8, 23)


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    rows = []
    for i, (room, sensor, second, value) in enumerate([
        ("102", "co2", 10, 5.0), ("101", "co2", 10, 4.0), ("101", "pir", 5, None),
        ("B", "co2", 20, 1.0), ("a", "noise", 30, 2.0), ("007", "pir", 40, 1.0),
        (None, "co2", 50, 9.0), ("101", None, 55, 9.0),
    ]):
        ts = dt.datetime(2013, 8, 23, 12, 0, second)
        rows.append(
            (room, sensor, f"{room}-{sensor}", i, ts, DAY, str(value), value, "u",
             value is not None, "OK" if value is not None else "MISSING", DAY, "", ts)
        )
    other = list(rows[0])
    other[0], other[4], other[5] = "999", dt.datetime(2013, 8, 24), dt.date(2013, 8, 24)
    root = str(tmp_path_factory.mktemp("silver"))
    tables.write_partitioned(spark.createDataFrame([*rows, tuple(other)], schemas.SILVER), root)
    return tables.read_silver(spark, root)


def test_rooms_in_byte_order_without_null(silver):
    assert [r.room for r in serving.rooms(silver).collect()] == ["007", "101", "102", "B", "a"]
    assert "999" in [r.room for r in serving.rooms(silver, None).collect()]


def test_sensor_types(silver):
    assert [r[0] for r in serving.sensor_types(silver).collect()] == ["co2", "noise", "pir"]


def test_default_page(silver):
    page = serving.readings(silver, "2013-08-23")
    assert page.columns == schemas.READING.fieldNames()
    assert [(r.room, r.value_clean) for r in page.collect()] == [
        ("101", 4.0), ("102", 5.0), ("B", 1.0), ("a", 2.0), ("007", 1.0), (None, 9.0), ("101", 9.0),
    ]


def test_invalid_readings_on_request(silver):
    page = serving.readings(silver, "2013-08-23", only_valid=False, limit=1).collect()
    assert [(r.sensor_id, r.value_clean, r.quality_flag) for r in page] == [
        ("101-pir", None, "MISSING")
    ]


@pytest.mark.parametrize(
    ("bounds", "count"),
    [
        (("2013-08-23T12:00:10", "2013-08-23T12:00:10"), 2),
        (("2013-08-23T12:00:10Z", None), 7),
        (("2013-08-23T14:00:20+02:00", "2013-08-23 12:00:40"), 3),
        ((None, "2013-08-23T12:00:09"), 0),
        ((dt.datetime(2013, 8, 23, 12, 0, 50), None), 2),
        (("2013-08-23", "2013-08-24"), 7),
    ],
)
def test_time_bounds_are_inclusive(silver, bounds, count):
    assert serving.readings(silver, "2013-08-23", from_ts=bounds[0], to_ts=bounds[1]).count() == count


def test_filters_combine(silver):
    page = serving.readings(silver, "2013-08-23", room="101", sensor_type="co2")
    assert [r.sensor_id for r in page.collect()] == ["101-co2"]
    assert serving.readings(silver, "2013-08-23", room="101", sensor_type="noise").count() == 0


def test_bad_arguments(silver):
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            serving.readings(silver, "2013-08-23", limit=limit)
    with pytest.raises(ValueError):
        serving.readings(silver, "x/../y")
    with pytest.raises(PySparkException):
        serving.readings(silver, "2013-08-23", from_ts="yesterday-ish").collect()


def test_settings_can_lower_the_limit(silver):
    assert serving.readings(silver, "2013-08-23", limit=500, max_limit=2).count() == 2


def test_readings_job_obeys_the_configured_limit(spark, silver, folder, monkeypatch, capsys):
    silver.write.partitionBy(schemas.DATE_PARTITION).parquet(f"{folder}/silver")
    monkeypatch.setenv("SILVER_PATH", f"{folder}/silver")
    monkeypatch.setenv("SILVER_MAX_LIMIT", "3")
    readings_job.main(["--date", "2013-08-23", "--limit", "100"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["room"] for x in lines] == ["101", "102", "B"]
