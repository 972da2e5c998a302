"""Declared schemas. Every table is read with its schema, never with inference."""

from pyspark.sql import types as T

_binary, _boolean, _date, _double = T.BinaryType(), T.BooleanType(), T.DateType(), T.DoubleType()
_bigint, _int, _string, _timestamp = (
    T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ENVELOPE = _schema(
    key=_binary, value=_binary, topic=_string, partition=_int, offset=_bigint,
    timestamp=_timestamp,
)

PAYLOAD = _schema(room=_string, sensor=_string, ts=_bigint, value=_double)

BRONZE = _schema(
    room=_string, sensor=_string, ts_unix=_bigint, value=_double, topic=_string,
    partition=_int, offset=_bigint, kafka_ts=_timestamp, event_ts=_timestamp,
    event_date=_date, ingest_ts=_timestamp,
)
BRONZE_PARTITIONS = ["room", "sensor", "event_date"]

SILVER = _schema(
    room=_string, sensor_type=_string, sensor_id=_string, ts_unix=_bigint, ts_utc=_timestamp,
    event_date=_date, value_raw=_string, value_clean=_double, unit=_string,
    is_valid=_boolean, quality_flag=_string, ingest_date=_date, source_file=_string,
    created_at=_timestamp,
)

HOURLY = _schema(
    room=_string, sensor_type=_string, event_date=_date, hour_utc=_timestamp,
    nb_readings=_bigint, nb_valid=_bigint, nb_invalid=_bigint, value_min=_double,
    value_max=_double, value_avg=_double, value_std=_double, pct_valid=_double,
    quality_flag_hour=_string, created_at=_timestamp,
)

# What is kept of the readings of an hour so that more of them can be merged in: of the valid values
# their number, mean, and sum of squared distances from the mean.
HOUR_STATE = _schema(
    room=_string, sensor_type=_string, event_date=_date, hour_utc=_timestamp,
    nb_readings=_bigint, nb_valid=_bigint, nb_invalid=_bigint, nb_values=_bigint,
    value_mean=_double, value_m2=_double, value_min=_double, value_max=_double,
)

# Messages that are not the declared payload.
REJECT = _schema(
    topic=_string, partition=_int, offset=_bigint, kafka_ts=_timestamp, text=_string,
)

MESSAGE_COUNT = _schema(sensor=_string, nb_messages=_bigint)

DAILY = _schema(
    room=_string, event_date=_date, temp_avg=_double, temp_min=_double, temp_max=_double,
    temp_comfort_ratio=_double, co2_avg=_double, co2_max=_double,
    co2_above_1000_ratio=_double, humidity_avg=_double, humidity_in_range_ratio=_double,
    luminosity_avg=_double, luminosity_min=_double, luminosity_max=_double,
    occupancy_rate=_double, data_quality_score=_double, comfort_score=_double,
    created_at=_timestamp,
)

# Silver, hourly and daily tables are all partitioned by this column.
DATE_PARTITION = "event_date"

READING = _schema(
    room=_string, sensor_type=_string, sensor_id=_string, ts_utc=_timestamp,
    value_clean=_double, unit=_string, is_valid=_boolean, quality_flag=_string,
)

RAW_ROW = _schema(ts_raw=_string, value_raw=_string)
