import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from roomtide import schemas
from roomtide.operators.bronze import decode_envelope, to_bronze, unparsed_by_topic
from roomtide.operators.silver import to_silver

LOGGED = dt.datetime(2024, 1, 1)


def envelope(spark, *texts, topic="iot.co2"):
    rows = [
        (b"101:co2", t.encode(), topic, 0, i, LOGGED) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schemas.ENVELOPE)


def bronze_row(spark, text):
    return to_bronze(envelope(spark, text)).first()


def test_bronze_schema_and_order(spark):
    df = to_bronze(envelope(spark, "{}"))
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in schemas.BRONZE
    ]


def test_envelope_is_decoded(spark):
    row = decode_envelope(envelope(spark, "text")).first()
    assert (row.key, row.value_str, row.topic, row.partition, row.offset) == (
        "101:co2", "text", "iot.co2", 0, 0,
    )


def test_message(spark):
    row = bronze_row(spark, '{"room": "205", "sensor": "humidity", "ts": 1377301234, "value": 41.25}')
    assert (row.room, row.sensor, row.ts_unix, row.value) == ("205", "humidity", 1377301234, 41.25)
    assert row.event_date == dt.date(2013, 8, 23)
    assert row.kafka_ts == LOGGED


def test_bytes_that_are_no_text_do_not_stop_the_job(spark):
    rows = [(b"\xff", b"\xff\xfe{}", "iot.co2", 0, 0, LOGGED)]
    row = to_bronze(spark.createDataFrame(rows, schemas.ENVELOPE)).first()
    assert (row.room, row.value, row.topic) == (None, None, "iot.co2")


def test_unparsable_message_is_kept(spark):
    row = bronze_row(spark, "not json")
    assert (row.room, row.sensor, row.ts_unix, row.value, row.event_date) == (None,) * 5
    assert row.topic == "iot.co2"


def test_json_typing(spark):
    row = bronze_row(spark, '{"room":101,"sensor":"pir","ts":"12","value":"5"}')
    assert (row.room, row.sensor, row.ts_unix, row.value) == ("101", "pir", None, None)
    row = bronze_row(spark, '{"room":"1","ts":1.5,"value":2}')
    assert (row.room, row.ts_unix, row.value) == ("1", None, 2.0)
    assert math.isnan(bronze_row(spark, '{"value":NaN}').value)
    assert bronze_row(spark, '{"value":Infinity}').value == math.inf


@pytest.mark.parametrize("ts", [1377299108123456, 9223372036854775807, -(10**15)])
def test_a_nonsense_clock_does_not_stop_the_job(spark, ts):
    bronze = to_bronze(envelope(spark, f'{{"room":"1","ts":{ts},"value":1}}'))
    row = to_silver(bronze.withColumn("source_file", F.lit(None).cast("string"))).first()
    assert (row.ts_unix, row.ts_utc, row.event_date) == (ts, None, None)


def test_unparsed_counts(spark):
    bronze = to_bronze(envelope(spark, "not json", "{}", '{"room":"1"}', '{"value":NaN}'))
    assert tuple(unparsed_by_topic(bronze).first()) == ("iot.co2", 4, 2)


def silver(spark, room="101", sensor="co2", value=1.0, topic="iot.co2", path="", ts=1377299108):
    event_ts = dt.datetime(2013, 8, 23, 23, 5, 8)
    row = (room, sensor, ts, value, topic, 0, 0, LOGGED, event_ts, event_ts.date(), LOGGED)
    bronze = spark.createDataFrame([row], schemas.BRONZE)
    return to_silver(bronze.withColumn("source_file", F.lit(path))).first()


def test_silver_schema_and_order(spark):
    bronze = spark.createDataFrame([], schemas.BRONZE)
    with pytest.raises(ValueError, match="source_file"):
        to_silver(bronze)
    df = to_silver(bronze.withColumn("source_file", F.lit("f")))
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in schemas.SILVER
    ]


@pytest.mark.parametrize(
    ("value", "clean", "flag"),
    [
        (488.0, 488.0, "OK"),
        (None, None, "MISSING"),
        (math.nan, None, "MISSING"),
        (math.inf, math.inf, "OK"),
        (-0.0, 0.0, "OK"),
        (5e-324, 5e-324, "OK"),
        (1.7976931348623157e308, 1.7976931348623157e308, "OK"),
    ],
)
def test_value_cleaning(spark, value, clean, flag):
    row = silver(spark, value=value)
    assert row.value_clean == clean
    assert (row.is_valid, row.quality_flag) == (clean is not None, flag)


@pytest.mark.parametrize(
    ("text", "clean"),
    [(" 4.5 ", 4.5), ("", None), ("  ", None), ("NaN", None), ("nan", None), ("x", None),
     ("1e3", 1000.0), (None, None), ("Infinity", math.inf)],
)
def test_text_values(spark, text, clean):
    bronze = spark.range(1).select(
        *[
            F.lit(text).cast("string").alias("value") if f.name == "value"
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.BRONZE
        ]
    )
    row = to_silver(bronze.withColumn("source_file", F.lit(""))).first()
    assert row.value_clean == clean


@pytest.mark.parametrize(
    ("sensor", "unit"),
    [("co2", "ppm"), ("humidity", "%"), ("temperature", "°C"), ("pir", "binary"),
     ("luminosity", "lux"), ("noise", "unknown"), ("CO2", "ppm")],
)
def test_units(spark, sensor, unit):
    row = silver(spark, sensor=sensor)
    assert (row.sensor_type, row.unit) == (sensor.lower(), unit)


@pytest.mark.parametrize(
    ("topic", "sensor_type", "unit"),
    [("iot.pir", "pir", "binary"), ("iot.PIR", "PIR", "unknown"), ("other", "", "unknown"),
     (None, None, "unknown")],
)
def test_sensor_type_from_topic(spark, topic, sensor_type, unit):
    row = silver(spark, sensor=None, topic=topic)
    assert (row.sensor_type, row.unit) == (sensor_type, unit)


@pytest.mark.parametrize(
    ("path", "room"),
    [("s3a://b/bronze/room=413/sensor=co2/x", "413"), ("/room=a%20b/x", "a"), ("/none", "")],
)
def test_room_from_path(spark, path, room):
    assert silver(spark, room=None, path=path).room == room


def test_sensor_id_skips_missing_parts(spark):
    assert silver(spark).sensor_id == "101-co2"
    assert silver(spark, sensor=None, topic=None).sensor_id == "101"


def test_times(spark):
    row = silver(spark)
    assert row.ts_utc == dt.datetime(2013, 8, 23, 23, 5, 8)
    assert row.event_date == dt.date(2013, 8, 23)


def test_summer_time_end_keeps_its_hour(spark):
    # 2013-10-27 01:30 UTC falls into the repeated local hour of Paris.
    assert silver(spark, ts=1382837400).ts_utc == dt.datetime(2013, 10, 27, 1, 30)
