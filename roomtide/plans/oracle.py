"""SQL for each registered query, to be run by another engine on the same tables.

It is written from the definitions, not from the Spark plans: the daily table is the literal
chain of six frames and five full outer joins, and the schedules are plain windows.
"""

from __future__ import annotations

_READINGS = """
folded AS (
  SELECT event_id, ts AS kafka_ts, user_id % 5 AS fold, event_type, value AS v,
         1377216000 + (epoch_us(ts) // 1000000 - 1704067200) // 10 AS ts
  FROM events
),
named AS (
  SELECT *, CAST(101 + fold AS VARCHAR) AS room,
         CASE WHEN fold = 4 AND event_type IN ('click', 'signup') THEN 'noise'
              WHEN event_type = 'click' THEN 'co2'
              WHEN event_type = 'error' THEN 'pir'
              WHEN event_type = 'purchase' THEN 'luminosity'
              WHEN event_type = 'signup' THEN 'temperature'
              ELSE 'humidity' END AS sensor
  FROM folded
),
messages AS (
  SELECT event_id, kafka_ts, room, sensor, ts,
         CASE WHEN sensor = 'noise' THEN 'iot.sensor' ELSE 'iot.' || sensor END AS topic,
         CASE WHEN event_id % 10 >= fold THEN
           CASE sensor WHEN 'co2' THEN 300 + 10 * v
                       WHEN 'pir' THEN CAST(v >= 35 AS DOUBLE)
                       WHEN 'luminosity' THEN 10 * v
                       WHEN 'temperature' THEN 15 + v / 5
                       ELSE v END
         END AS value
  FROM named
)"""

_SILVER = (
    _READINGS
    + """,
silver AS (
  SELECT room, sensor AS sensor_type, room || '-' || sensor AS sensor_id, ts AS ts_unix,
         make_timestamp(ts * 1000000) AS ts_utc,
         CAST(make_timestamp(ts * 1000000) AS DATE) AS event_date,
         value AS value_raw, value AS value_clean,
         CASE sensor WHEN 'co2' THEN 'ppm' WHEN 'humidity' THEN '%'
                     WHEN 'temperature' THEN '°C' WHEN 'pir' THEN 'binary'
                     WHEN 'luminosity' THEN 'lux' ELSE 'unknown' END AS unit,
         value IS NOT NULL AS is_valid,
         CASE WHEN value IS NULL THEN 'MISSING' ELSE 'OK' END AS quality_flag
  FROM messages
)"""
)

_HOURLY = (
    _SILVER
    + """,
counted AS (
  SELECT room, sensor_type, event_date, date_trunc('hour', ts_utc) AS hour_utc,
         count(*) AS nb_readings,
         CAST(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS nb_valid,
         CAST(sum(CASE WHEN is_valid THEN 0 ELSE 1 END) AS BIGINT) AS nb_invalid,
         min(value_clean) AS value_min, max(value_clean) AS value_max,
         avg(value_clean) AS value_avg, stddev_samp(value_clean) AS value_std
  FROM silver GROUP BY ALL
),
hourly AS (
  SELECT *, nb_valid / nb_readings AS pct_valid,
         CASE WHEN nb_valid / nb_readings >= CAST(0.9 AS DOUBLE) THEN 'OK'
              WHEN nb_valid / nb_readings >= CAST(0.7 AS DOUBLE) THEN 'WARNING'
              ELSE 'BAD' END AS quality_flag_hour
  FROM counted
)"""
)

_DAILY = (
    _HOURLY
    + """,
temperature AS (
  SELECT room, event_date, sum(value_avg * nb_valid) / nullif(sum(nb_valid), 0) AS temp_avg,
         min(value_min) AS temp_min, max(value_max) AS temp_max,
         avg(CASE WHEN value_avg >= 20 AND value_avg <= 24 THEN 1.0 ELSE 0.0 END)
           AS temp_comfort_ratio
  FROM hourly WHERE sensor_type = 'temperature' GROUP BY room, event_date
),
co2 AS (
  SELECT room, event_date, sum(value_avg * nb_valid) / nullif(sum(nb_valid), 0) AS co2_avg,
         max(value_max) AS co2_max,
         avg(CASE WHEN value_avg > 1000 THEN 1.0 ELSE 0.0 END) AS co2_above_1000_ratio
  FROM hourly WHERE sensor_type = 'co2' GROUP BY room, event_date
),
humidity AS (
  SELECT room, event_date, sum(value_avg * nb_valid) / nullif(sum(nb_valid), 0) AS humidity_avg,
         avg(CASE WHEN value_avg >= 30 AND value_avg <= 60 THEN 1.0 ELSE 0.0 END)
           AS humidity_in_range_ratio
  FROM hourly WHERE sensor_type = 'humidity' GROUP BY room, event_date
),
luminosity AS (
  SELECT room, event_date, sum(value_avg * nb_valid) / nullif(sum(nb_valid), 0) AS luminosity_avg,
         min(value_min) AS luminosity_min, max(value_max) AS luminosity_max
  FROM hourly WHERE sensor_type = 'luminosity' GROUP BY room, event_date
),
pir AS (
  SELECT room, event_date, avg(value_avg) AS occupancy_rate
  FROM hourly WHERE sensor_type = 'pir' GROUP BY room, event_date
),
quality AS (
  SELECT room, event_date, least(greatest(avg(pct_valid) * 100, 0), 100) AS data_quality_score
  FROM hourly GROUP BY room, event_date
),
joined AS (
  SELECT * FROM temperature
  FULL JOIN co2 USING (room, event_date)
  FULL JOIN humidity USING (room, event_date)
  FULL JOIN luminosity USING (room, event_date)
  FULL JOIN pir USING (room, event_date)
  FULL JOIN quality USING (room, event_date)
),
daily AS (
  SELECT room, event_date,
         round(temp_avg, 6) AS temp_avg, round(temp_min, 6) AS temp_min,
         round(temp_max, 6) AS temp_max, round(temp_comfort_ratio, 6) AS temp_comfort_ratio,
         round(co2_avg, 6) AS co2_avg, round(co2_max, 6) AS co2_max,
         round(co2_above_1000_ratio, 6) AS co2_above_1000_ratio,
         round(humidity_avg, 6) AS humidity_avg,
         round(humidity_in_range_ratio, 6) AS humidity_in_range_ratio,
         round(luminosity_avg, 6) AS luminosity_avg, round(luminosity_min, 6) AS luminosity_min,
         round(luminosity_max, 6) AS luminosity_max, round(occupancy_rate, 6) AS occupancy_rate,
         round(data_quality_score, 6) AS data_quality_score,
         round(100 * (CAST(0.5 AS DOUBLE) * coalesce(temp_comfort_ratio, 0)
                    + CAST(0.3 AS DOUBLE) * (1 - coalesce(co2_above_1000_ratio, 0))
                    + CAST(0.2 AS DOUBLE) * coalesce(humidity_in_range_ratio, 0)), 6)
           AS comfort_score
  FROM joined
)"""
)

_RAW = (
    _READINGS
    + """,
raw_rows AS (
  SELECT room, sensor, ts, value, event_id - 2 * (event_id % 8) + 7 AS line,
         CASE sensor WHEN 'co2' THEN 'CO2' WHEN 'pir' THEN 'motion'
                     WHEN 'luminosity' THEN 'Light_sensor' WHEN 'temperature' THEN 'temp'
                     ELSE 'rH' END AS file
  FROM messages WHERE sensor <> 'noise'
),
readings AS (
  SELECT room, sensor, ts, value, line, room || '/' || file AS path
  FROM raw_rows WHERE value IS NOT NULL
),
warped AS (
  SELECT *, CAST(sum(step) OVER (PARTITION BY path ORDER BY line) AS BIGINT) AS elapsed
  FROM (
    SELECT *, coalesce(greatest(ts - lag(ts) OVER (PARTITION BY path ORDER BY line), 0), 0)
                AS step
    FROM readings
  )
)"""
)


def _with(tables: str, select: str) -> str:
    return f"WITH {tables.strip()}\n{select.strip()}"


_BRONZE_ROWS = _with(
    _READINGS,
    """
    SELECT room, sensor, ts AS ts_unix, value, topic, CAST(event_id % 3 AS INTEGER) AS partition,
           event_id AS "offset", kafka_ts, make_timestamp(ts * 1000000) AS event_ts,
           CAST(make_timestamp(ts * 1000000) AS DATE) AS event_date
    FROM messages
    """,
)
_SILVER_ROWS = _with(_SILVER, "SELECT * FROM silver")
_HOURLY_ROWS = _with(
    _HOURLY,
    """
    SELECT room, sensor_type, event_date, hour_utc, nb_readings, nb_valid, nb_invalid,
           round(value_min, 6) AS value_min, round(value_max, 6) AS value_max,
           round(value_avg, 6) AS value_avg, round(value_std, 6) AS value_std,
           round(pct_valid, 6) AS pct_valid, quality_flag_hour
    FROM hourly
    """,
)
_DAILY_ROWS = _with(_DAILY, "SELECT * FROM daily")
_READING_COLUMNS = (
    "room, sensor_type, sensor_id, ts_utc, value_clean, unit, is_valid, quality_flag"
)
_READING_ORDER = "ts_utc, sensor_id, value_clean NULLS FIRST"

SQL: dict[str, str] = {
    "envelope_decode": _with(
        _READINGS,
        """
        SELECT room || ':' || sensor AS key, room, sensor, topic,
               CAST(event_id % 3 AS INTEGER) AS partition, event_id AS "offset", kafka_ts
        FROM messages
        """,
    ),
    "bronze_parse": _BRONZE_ROWS,
    "bronze_unparsed": _with(
        _READINGS,
        """
        SELECT topic, count(*) AS nb_messages,
               count(*) FILTER (WHERE event_id % 4 = 0) AS nb_unparsed
        FROM messages GROUP BY topic
        """,
    ),
    "bronze_stream": _BRONZE_ROWS,
    "bronze_restart": _BRONZE_ROWS,
    "bronze_batches": _BRONZE_ROWS,
    "bronze_rejects": _with(
        _READINGS,
        """
        SELECT topic, CAST(event_id % 3 AS INTEGER) AS partition, event_id AS "offset",
               CASE event_id % 4 WHEN 0 THEN 'not json ' || event_id
                                 ELSE '{"room": "101", "ts": "' || event_id || '"}' END AS text
        FROM messages WHERE event_id % 4 < 2
        """,
    ),
    "bronze_stray_file": _BRONZE_ROWS,
    "silver_clean": _SILVER_ROWS,
    "silver_repair": _with(
        _READINGS,
        """
        SELECT room, sensor_type, room || '-' || sensor_type AS sensor_id, ts AS ts_unix,
               value AS value_clean,
               CASE sensor_type WHEN 'co2' THEN 'ppm' WHEN 'humidity' THEN '%'
                                WHEN 'temperature' THEN '°C' WHEN 'pir' THEN 'binary'
                                WHEN 'luminosity' THEN 'lux' ELSE 'unknown' END AS unit
        FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN replace(topic, 'iot.', '')
                             ELSE sensor END AS sensor_type
              FROM messages)
        """,
    ),
    "silver_stream": _SILVER_ROWS,
    "silver_from_leaves": _with(
        _SILVER,
        """
        SELECT * REPLACE (
          CASE sensor_type WHEN 'noise' THEN 'sensor' ELSE sensor_type END AS sensor_type,
          room || '-' || CASE sensor_type WHEN 'noise' THEN 'sensor' ELSE sensor_type END
            AS sensor_id)
        FROM silver
        """,
    ),
    "silver_one_date": _with(
        _SILVER, "SELECT * FROM silver WHERE event_date = DATE '2013-08-24'"
    ),
    "silver_quality": _with(
        _SILVER,
        """
        SELECT sensor_type, unit, quality_flag, count(*) AS nb_readings,
               count(*) FILTER (WHERE is_valid) AS nb_valid
        FROM silver GROUP BY sensor_type, unit, quality_flag
        """,
    ),
    "hourly_kpis": _HOURLY_ROWS,
    "hourly_merged": _HOURLY_ROWS,
    "daily_room_metrics": _DAILY_ROWS,
    "daily_join_chain": _DAILY_ROWS,
    "gold_hourly_table": _HOURLY_ROWS,
    "gold_daily_table": _DAILY_ROWS,
    "gold_one_date": _with(_DAILY, "SELECT * FROM daily WHERE event_date = DATE '2013-08-24'"),
    "gold_appended": _with(_DAILY, "SELECT * FROM daily UNION ALL SELECT * FROM daily"),
    "gold_day_removed": _with(
        _DAILY, "SELECT * FROM daily WHERE event_date != DATE '2013-08-24'"
    ),
    "gold_late_rows": _DAILY_ROWS,
    "rooms": _with(
        _SILVER,
        """
        SELECT DISTINCT room FROM silver WHERE event_date = DATE '2013-08-23' ORDER BY room
        """,
    ),
    "sensor_types": _with(
        _SILVER,
        """
        SELECT DISTINCT sensor_type FROM silver WHERE event_date = DATE '2013-08-23'
        ORDER BY sensor_type
        """,
    ),
    "sensor_types_any_date": _with(
        _SILVER, "SELECT DISTINCT sensor_type FROM silver ORDER BY sensor_type"
    ),
    "readings_default": _with(
        _SILVER,
        f"""
        SELECT {_READING_COLUMNS} FROM silver
        WHERE event_date = DATE '2013-08-24' AND is_valid
        ORDER BY {_READING_ORDER} LIMIT 100
        """,
    ),
    "readings_filtered": _with(
        _SILVER,
        f"""
        SELECT {_READING_COLUMNS} FROM silver
        WHERE event_date = DATE '2013-08-24' AND room = '103' AND sensor_type = 'humidity'
          AND ts_utc BETWEEN TIMESTAMP '2013-08-24 06:00:00' AND TIMESTAMP '2013-08-24 20:00:00'
        ORDER BY {_READING_ORDER} LIMIT 1000
        """,
    ),
    "csv_ingest": _with(_RAW, "SELECT room, sensor, ts, value FROM readings"),
    "csv_no_match": _with(
        _RAW, "SELECT room, sensor, ts, value FROM readings WHERE room = 'no such room'"
    ),
    "csv_allow_list": _with(
        _RAW,
        """
        SELECT room, sensor, ts, value FROM readings
        WHERE room IN ('101', '103', '105') AND sensor IN ('co2', 'pir')
        """,
    ),
    "csv_allow_table": _with(
        _RAW,
        """
        SELECT room, sensor, ts, value FROM readings
        WHERE room IN ('101', '104') AND sensor <> 'pir'
        """,
    ),
    "csv_rejected": _with(
        _RAW,
        """
        SELECT sensor, count(*) AS nb_rows, count(*) - count(value) AS nb_rejected
        FROM raw_rows GROUP BY sensor
        """,
    ),
    "csv_streams": _with(
        _RAW,
        """
        SELECT room, sensor, row_number() OVER (ORDER BY room, file) - 1 AS stream_idx
        FROM (SELECT DISTINCT room, sensor, file FROM raw_rows)
        """,
    ),
    "message_fields": _with(
        _RAW,
        """
        SELECT 'iot.' || sensor AS topic, room || ':' || sensor AS key, room AS json_room,
               sensor AS json_sensor, ts AS json_ts, value AS json_value
        FROM readings
        """,
    ),
    "message_bytes": _with(
        _RAW,
        """
        SELECT 'iot.' || sensor AS topic, room || ':' || sensor AS key,
               '{"room": "' || room || '", "sensor": "' || sensor || '", "ts": ' || ts
                 || ', "value": ' || CASE sensor WHEN 'pir' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                                                 ELSE CAST(value AS VARCHAR) END || '}' AS json
        FROM readings
        """,
    ),
    "message_log": _with(
        _RAW,
        """
        SELECT 'iot.' || sensor AS topic, room || ':' || sensor AS key, ts, value,
               row_number() OVER (ORDER BY elapsed, path, line) AS position
        FROM warped
        """,
    ),
    "message_counts": _with(
        _RAW,
        """
        SELECT sensor, grouping(sensor) = 1 AS is_total, count(*) AS nb_messages
        FROM readings GROUP BY ROLLUP (sensor)
        """,
    ),
    "message_counts_stream": _with(
        _RAW,
        """
        SELECT sensor, grouping(sensor) = 1 AS is_total, count(*) AS nb_messages
        FROM readings GROUP BY ROLLUP (sensor)
        """,
    ),
    "replay_timewarp": _with(
        _RAW,
        """
        SELECT room, sensor, ts, value, elapsed / CAST(10 AS DOUBLE) AS send_offset
        FROM warped
        """,
    ),
    "replay_timewarp_by_time": _with(
        _RAW,
        """
        SELECT room, sensor, ts, value,
               (ts - min(ts) OVER (PARTITION BY path)) / CAST(10 AS DOUBLE) AS send_offset
        FROM readings
        """,
    ),
    "replay_merged": _with(
        _RAW,
        """
        SELECT room, sensor, ts, value, elapsed / CAST(10 AS DOUBLE) AS send_offset,
               row_number() OVER (ORDER BY elapsed, path, line) AS position
        FROM warped
        """,
    ),
    "replay_rate": _with(
        _RAW,
        """
        SELECT *, (position - 1) / CAST(5 AS DOUBLE) AS send_offset
        FROM (
          SELECT room, sensor, ts, value, round,
                 row_number() OVER (ORDER BY round, path) AS position
          FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS round
                FROM readings)
        )
        """,
    ),
}
