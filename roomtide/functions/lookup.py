from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    """A small fixed table as CASEs; an unknown or NULL key gives the default."""
    hits = [F.when(key == name, F.lit(value)) for name, value in table.items()]
    return F.coalesce(*hits, F.lit(default))
