"""Raw readings: header-less CSV entries `<root>/<room>/<file>.csv` with epoch and value.

An entry is a plain file or a folder of part files as Spark writes them. A `room=` or `file=`
prefix, which a write partitioned by these columns adds, is not part of the name.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtide import constants as C
from roomtide import schemas
from roomtide.config import child
from roomtide.functions import text

log = logging.getLogger(__name__)

_PART_FILE = r"(?<=\.csv)/[^/]*$"
_PREFIX = r"^(?:room|file)="
_SPLIT = "struct<file: string, start: bigint>"
_ENTRY = "room string, sensor string, path string"
_ROW = f"{_ENTRY}, split {_SPLIT}, line bigint, ts_raw string, value_raw string"


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _glob(root: str, rooms: Sequence[str], sensors: Sequence[str]) -> str:
    """Paths of the entries that may be wanted; other files are not even listed as input."""
    room_level = name_level = "*"
    if rooms:
        names = [re.sub(r"([*?\[\]{},\\])", r"\\\1", room) for room in rooms]
        room_level = "{" + ",".join([*names, *(f"room={name}" for name in names)]) + "}"
    aliases = [a for s in sensors for a in C.FILE_NAME_ALIASES.get(s.lower(), [])]
    if aliases:
        name_level = "{" + ",".join(f"*{_any_case(alias)}*" for alias in aliases) + "}"
    return child(root, room_level, f"{name_level}.csv")


def _described(files: DataFrame) -> DataFrame:
    """Add `room`, `sensor` and the entry's `path` to rows with a `file_path`."""
    entry = text.decoded_path(F.regexp_replace("file_path", _PART_FILE, ""))
    tail = F.substring_index("path", "/", -2)
    name = F.regexp_replace(F.lower(F.substring_index(tail, "/", -1)), _PREFIX, "")
    return files.withColumn("path", entry).withColumns(
        {
            "room": F.regexp_replace(F.substring_index(tail, "/", 1), _PREFIX, ""),
            "sensor": text.sensor_from_name(F.regexp_replace(name, r"\.csv$", "")),
        }
    )


def _wanted(df: DataFrame, rooms: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Known sensor types, and the listed rooms and types if any."""
    df = df.where(F.col("sensor").isNotNull())
    if rooms:
        df = df.where(F.col("room").isin(list(rooms)))
    if sensors:
        df = df.where(F.col("sensor").isin([s.lower() for s in sensors]))
    return df


def _found(read: Callable[[], DataFrame], glob: str) -> DataFrame | None:
    """What Spark lists for a glob; nothing, with a warning, where no name matches."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no entry matches %s", glob)
        return None


def _allowed(df: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows whose room, sensor type or both are in a table: a semi-join, which Spark broadcasts or
    shuffles by the table's size."""
    if allowed is None:
        return df
    keys = [c for c in ("room", "sensor") if c in allowed.columns]
    if not keys:
        raise ValueError("an allow-list table needs a column room or sensor")
    names = allowed.select(
        *[F.lower(c).alias(c) if c == "sensor" else F.col(c).cast("string").alias(c) for c in keys]
    )
    return df.join(names, keys, "left_semi").select(*df.columns)


def list_entries(
    spark: SparkSession,
    root: str,
    rooms: Sequence[str] = (),
    sensors: Sequence[str] = (),
    allowed: DataFrame | None = None,
) -> DataFrame:
    """(room, sensor, path) of each entry in path order; none if no entry matches. No file content
    is read. `allowed` is as in `read_rows`."""
    glob = _glob(root, rooms, sensors)
    listed = _found(lambda: spark.read.format("binaryFile").load(glob), glob)
    if listed is None:
        return spark.createDataFrame([], _ENTRY)
    paths = listed.select(F.col("_metadata.file_path").alias("file_path"))
    files = _allowed(_wanted(_described(paths), rooms, sensors), allowed)
    return files.select("room", "sensor", "path").distinct().orderBy("path")


def read_rows(
    spark: SparkSession,
    root: str,
    rooms: Sequence[str] = (),
    sensors: Sequence[str] = (),
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Raw rows (room, sensor, path, split, line, ts_raw, value_raw); none if no entry matches.

    `split` and `line` order the rows of a file: the scan cuts a file into splits at byte
    offsets, and line numbers grow within a split. Part files of one entry follow each other
    in name order. What a path says is worked out on the rows, by a projection of the scan.

    Short lists of `rooms` and `sensors` choose files by name. A long list comes as the table
    `allowed` with `room`, `sensor` or both: rows of other rooms and types are dropped right after
    the scan. Names in it match whole; NULL matches nothing.
    """
    glob = _glob(root, rooms, sensors)
    rows = _found(lambda: spark.read.schema(schemas.RAW_ROW).csv(glob), glob)
    if rows is None:
        return spark.createDataFrame([], _ROW)
    split = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    placed = rows.select(
        F.col("_metadata.file_path").alias("file_path"),
        split.alias("split"),
        F.monotonically_increasing_id().alias("line"),
        *rows.columns,
    )
    described = _allowed(_wanted(_described(placed), rooms, sensors), allowed)
    return described.select("room", "sensor", "path", "split", "line", *rows.columns)
