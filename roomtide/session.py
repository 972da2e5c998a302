"""One session builder for every job."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from roomtide.config import Settings

log = logging.getLogger(__name__)

# Results depend on the first; the rest are the engine's own features switched on explicitly.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def s3_options(settings: Settings) -> dict[str, str]:
    """S3A access for the whole session; without keys the default credential chain applies."""
    options = {"spark.hadoop.fs.s3a.endpoint": f"s3.{settings.s3_region}.amazonaws.com"}
    if settings.s3_access_key and settings.s3_secret_key:
        options |= {
            "spark.hadoop.fs.s3a.access.key": settings.s3_access_key,
            "spark.hadoop.fs.s3a.secret.key": settings.s3_secret_key,
            "spark.hadoop.fs.s3a.aws.credentials.provider": (
                "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
            ),
        }
    else:
        log.warning("no S3 keys in the environment; using the default credential chain")
    return options


def build_session(
    name: str,
    settings: Settings | None = None,
    packages: Iterable[str] = (),
    extra: Mapping[str, str] | None = None,
) -> SparkSession:
    """A UTC session. `packages` are Maven coordinates, resolved only when given."""
    settings = settings or Settings.from_env()
    options = dict(_DEFAULTS)
    if settings.shuffle_partitions:
        options["spark.sql.shuffle.partitions"] = str(settings.shuffle_partitions)
    paths = (settings.raw_path, settings.bronze_path, settings.silver_path, settings.gold_path)
    coordinates = list(packages)
    if any(p.startswith("s3a://") for p in paths):
        options |= s3_options(settings)
        coordinates.append(settings.s3_package)
    if coordinates:
        options["spark.jars.packages"] = ",".join(coordinates)
    builder = SparkSession.builder.appName(name)
    for key, value in (options | dict(extra or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Days and hours are those of the session zone, and they must be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the session zone must be UTC, not {zone}")


def pin_utc(spark: SparkSession) -> SparkSession:
    """Days and hours are UTC; set that on a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
