"""Settings from the environment, and the checks on caller-supplied arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

from roomtide import constants as C


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.split(",") if w.strip())


def lake_path(path: str) -> str:
    """Spark reads S3 through the s3a scheme; accept s3:// as well."""
    return "s3a://" + path.removeprefix("s3://") if path.startswith("s3://") else path


def child(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


@dataclass(frozen=True)
class Settings:
    kafka_bootstrap: str = "localhost:9092"
    kafka_topics: str = ",".join(C.TOPICS.values())
    kafka_package: str = "org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2"
    kafka_acks: str = "all"
    kafka_linger_ms: int = 20
    kafka_batch_size: int = 32768
    # Messages a batch takes at most; what is left waits for the next one. None: no bound.
    max_offsets_per_trigger: int | None = None
    bronze_trigger: str = C.BRONZE_TRIGGER

    topic_by_sensor: Mapping[str, str] = field(default_factory=lambda: dict(C.TOPICS))
    default_topic: str = C.DEFAULT_TOPIC

    raw_path: str = "lake/raw"
    bronze_path: str = "lake/bronze"
    bronze_checkpoint: str = "lake/_checkpoints/bronze"
    silver_path: str = "lake/silver"
    silver_checkpoint: str = "lake/_checkpoints/silver"
    gold_path: str = "lake/gold"
    gold_checkpoint: str = "lake/_checkpoints/gold"

    sensors: tuple[str, ...] = ("co2", "pir")
    rooms: tuple[str, ...] = ()
    replay_mode: str = "timewarp"
    rate_per_second: float = 5.0
    timewarp_factor: float = 10.0

    silver_max_limit: int = C.MAX_LIMIT
    shuffle_partitions: int | None = None

    s3_access_key: str | None = None
    s3_secret_key: str | None = field(default=None, repr=False)
    s3_region: str = "eu-west-3"
    s3_package: str = "org.apache.hadoop:hadoop-aws:3.4.2"

    @property
    def hourly_path(self) -> str:
        return child(self.gold_path, "sensor_timeseries_hourly")

    @property
    def states_path(self) -> str:
        return child(self.gold_path, "hour_states")

    @property
    def daily_path(self) -> str:
        return child(self.gold_path, "room_daily_metrics")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        if env is None:
            try:  # a .env file is a convenience where the package happens to be installed
                from dotenv import load_dotenv
            except ImportError:
                pass
            else:
                load_dotenv()
            env = os.environ
        base = cls()

        def path(name: str, default: str) -> str:
            return lake_path(env.get(name, default))

        return cls(
            kafka_bootstrap=env.get("KAFKA_BOOTSTRAP", base.kafka_bootstrap),
            kafka_topics=env.get("KAFKA_TOPIC", base.kafka_topics),
            kafka_package=env.get("SPARK_KAFKA_PACKAGE", base.kafka_package),
            kafka_acks=env.get("ACKS", base.kafka_acks),
            kafka_linger_ms=int(env.get("LINGER_MS", base.kafka_linger_ms)),
            kafka_batch_size=int(env.get("BATCH_SIZE", base.kafka_batch_size)),
            max_offsets_per_trigger=int(env.get("MAX_OFFSETS_PER_TRIGGER") or 0) or None,
            bronze_trigger=env.get("BRONZE_TRIGGER", base.bronze_trigger),
            topic_by_sensor={
                sensor: env.get(f"TOPIC_{sensor.upper()}", topic)
                for sensor, topic in C.TOPICS.items()
            },
            default_topic=env.get("TOPIC_DEFAULT", base.default_topic),
            raw_path=path("SOURCE_URL", base.raw_path),
            bronze_path=path("BRONZE_PATH", base.bronze_path),
            bronze_checkpoint=path("CHECKPOINT_PATH", base.bronze_checkpoint),
            silver_path=path("SILVER_PATH", base.silver_path),
            silver_checkpoint=path("SILVER_CHECKPOINT_PATH", base.silver_checkpoint),
            gold_path=path("GOLD_PATH", base.gold_path),
            gold_checkpoint=path("GOLD_CHECKPOINT_PATH", base.gold_checkpoint),
            sensors=_words(env.get("SENSORS", ",".join(base.sensors)).lower()),
            rooms=_words(env.get("ROOMS", "")),
            replay_mode=env.get("REPLAY_MODE", base.replay_mode).lower(),
            rate_per_second=float(env.get("RATE_MSG_PER_SEC", base.rate_per_second)),
            timewarp_factor=float(env.get("TIMEWARP_FACTOR", base.timewarp_factor)),
            silver_max_limit=int(env.get("SILVER_MAX_LIMIT", base.silver_max_limit)),
            shuffle_partitions=int(env.get("SHUFFLE_PARTITIONS") or 0) or None,
            s3_access_key=env.get("AWS_ACCESS_KEY_ID"),
            s3_secret_key=env.get("AWS_SECRET_ACCESS_KEY"),
            s3_region=env.get("AWS_DEFAULT_REGION", base.s3_region),
        )


def iso_date(value: str | date | None) -> str:
    """A required day as YYYY-MM-DD; unpadded months and days are accepted."""
    if isinstance(value, date):
        return value.strftime("%Y-%m-%d")
    if not value:
        raise ValueError("a date is required, as YYYY-MM-DD")
    try:
        return datetime.strptime(value, "%Y-%m-%d").date().isoformat()
    except ValueError:
        raise ValueError(f"not a date (expected YYYY-MM-DD): {value!r}") from None


def page_size(limit: int, most: int = C.MAX_LIMIT) -> int:
    """Rows of a page. A limit outside the fixed range is an error; one above the `most` that the
    settings allow is lowered to it without one, as the interface has it."""
    if not 1 <= limit <= C.MAX_LIMIT:
        raise ValueError(f"limit must lie in 1..{C.MAX_LIMIT}, got {limit}")
    return min(limit, most)
