import datetime as dt

import pytest

from roomtide.config import Settings, child, iso_date, lake_path, page_size
from roomtide.session import s3_options
from roomtide.sources import kafka


@pytest.mark.parametrize(
    ("given", "day"),
    [("2013-08-23", "2013-08-23"), ("2013-8-3", "2013-08-03"), (dt.date(2013, 8, 3), "2013-08-03")],
)
def test_dates(given, day):
    assert iso_date(given) == day


@pytest.mark.parametrize("given", ["2013-8-x", "", None, "23/08/2013", "2013-02-30"])
def test_bad_dates(given):
    with pytest.raises(ValueError):
        iso_date(given)


def test_page_size():
    assert page_size(1) == 1
    assert page_size(1000) == 1000
    assert page_size(1000, most=200) == 200
    for limit in (0, 1001, -5):
        with pytest.raises(ValueError):
            page_size(limit)


def test_paths():
    assert lake_path("s3://bucket/a") == "s3a://bucket/a"
    assert lake_path("s3a://bucket/a") == "s3a://bucket/a"
    assert child("s3a://bucket/a/", "b", "c") == "s3a://bucket/a/b/c"


def test_defaults():
    settings = Settings.from_env({})
    assert settings == Settings()
    assert settings.sensors == ("co2", "pir")
    assert settings.rooms == ()
    assert (settings.rate_per_second, settings.timewarp_factor) == (5.0, 10.0)


def test_environment():
    settings = Settings.from_env(
        {
            "SENSORS": " CO2, Humidity ,",
            "ROOMS": "101, 413",
            "TOPIC_PIR": "motion",
            "GOLD_PATH": "s3://bucket/gold/",
            "REPLAY_MODE": "RATE",
            "SILVER_MAX_LIMIT": "50",
            "AWS_ACCESS_KEY_ID": "key",
            "AWS_SECRET_ACCESS_KEY": "hidden",
        }
    )
    assert settings.sensors == ("co2", "humidity")
    assert settings.rooms == ("101", "413")
    assert settings.topic_by_sensor["pir"] == "motion"
    assert settings.hourly_path == "s3a://bucket/gold/sensor_timeseries_hourly"
    assert settings.daily_path == "s3a://bucket/gold/room_daily_metrics"
    assert settings.replay_mode == "rate"
    assert settings.silver_max_limit == 50
    assert "hidden" not in repr(settings)
    assert s3_options(settings)["spark.hadoop.fs.s3a.secret.key"] == "hidden"


def test_empty_sensor_list_means_all():
    assert Settings.from_env({"SENSORS": ""}).sensors == ()


def test_shuffle_partitions():
    assert Settings.from_env({"SHUFFLE_PARTITIONS": "4000"}).shuffle_partitions == 4000
    assert Settings.from_env({"SHUFFLE_PARTITIONS": ""}).shuffle_partitions is None


def test_s3_without_keys_leaves_the_credential_chain_alone():
    assert list(s3_options(Settings())) == ["spark.hadoop.fs.s3a.endpoint"]


def test_kafka_options():
    settings = Settings()
    source = kafka.source_options(settings)
    assert source["startingOffsets"] == "earliest"
    assert source["failOnDataLoss"] == "false"
    assert source["subscribe"].split(",") == [
        "iot.co2", "iot.pir", "iot.luminosity", "iot.temperature", "iot.humidity",
    ]
    sink = kafka.sink_options(settings)
    assert sink["kafka.acks"] == "all"
    assert sink["kafka.linger.ms"] == "20"
    assert sink["kafka.batch.size"] == "32768"


def test_batch_bound_and_trigger_come_from_the_environment():
    settings = Settings.from_env({"MAX_OFFSETS_PER_TRIGGER": "50000", "BRONZE_TRIGGER": "1 minute"})
    assert kafka.source_options(settings)["maxOffsetsPerTrigger"] == "50000"
    assert settings.bronze_trigger == "1 minute"
    assert "maxOffsetsPerTrigger" not in kafka.source_options(Settings.from_env({}))
    assert Settings.from_env({}).bronze_trigger == "10 seconds"
