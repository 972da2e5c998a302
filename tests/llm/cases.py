"""Small documents with every awkward case, and helpers to compare results."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " print bigint, row string, kind int, stack string, id string, label int"
)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(words))


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows and ids, odd white space and a long text."""
    return [
        (0, None),
        (1, ""),
        (2, " \n\t \x0b\x0c\r\n"),
        (3, "Ünïcode\u00a0ΣΑΣ 日本語 🙂 \u0085 İstanbul"),
        (4, "one"),
        (5, "One two"),
        (6, prose(1, 30_000)),
        (7, prose(2, 60)),
        (7, prose(2, 60)),
        (7, prose(3, 60)),
        (None, prose(2, 60)),
        (None, None),
        (None, prose(4, 60)),
        (-8, "a\x00b c\td\ne\rf"),
    ]


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with nulls in other columns and columns named like those operators make."""
    full = [
        (i, t, None, "src0", None if t is None else len(t), 1, "row", 2, "stack", "id", 3)
        for i, t in rows
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def sorted_rows(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
