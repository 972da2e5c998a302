"""Values of other forms: decimals, groups of thousands, names of several words."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roomtide.llm import decontaminate
from tests.llm.cases import awkward
from tests.llm.plain_decontamination import KINDS, plain_tokens
from tests.llm.test_decontaminate import asked, found

NUMBERS = (
    "A small boat needs 7.5 km of rope and 1,200 nails before it leaves the old harbour for good "
    "at night"
)
NAMES = "The old teacher asked young Pierre from Lyon why the last train was so late that day"


@pytest.mark.parametrize(
    ("question", "old", "new"),
    [
        (NUMBERS, "7.5", "12"),
        (NUMBERS, "1,200", "900"),
        (NUMBERS, "7.5", "1,050.25"),
        (NAMES, "Lyon", "New York"),
        (NAMES, "Lyon", "New\nYork City"),
        (NAMES, "Lyon", "Saint-Denis"),
        (NAMES.replace("Lyon", "New York"), "New York", "Rome"),
        (NAMES, "Pierre", "Anna Maria"),
    ],
)
def test_values_of_another_form(spark, question, old, new):
    assert old in question
    changed = question.replace(old, new)
    assert found(spark, [(1, question), (2, changed)], [question]) == {(1, 0): True, (2, 0): False}


def test_tokens_against_plain_version(spark):
    texts = [t for _, t in awkward() if t] + [
        asked(),
        NUMBERS,
        NAMES,
        "costs 1,200.50 euros, or 3.5-km, 7. Then 1.2.3 and .5 and 5. or ,5, and 3,x and x.y 2 .5",
        "from New York City, Los Angeles; Jean-Luc Picard met Paris-based Company men. New York is",
        "in New      York, of New \n York with McDonald Foo and O'Brien Bar, a USA Today, b É Ab",
        "saw José Maria and then 5 km 3.5 miles 4, km",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    by_text, by_tokens = (
        decontaminate._text_windows("text", 3),
        decontaminate._token_windows(decontaminate._tokens("text"), 3),
    )
    rows = df.select("text", decontaminate._tokens("text").alias("tokens"), by_text, by_tokens).collect()
    for row in rows:
        got = [
            (KINDS[t[0]], t[1:].replace(decontaminate._JOIN, " ")) if t[0] in KINDS else ("word", t)
            for t in row.tokens
        ]
        assert got == plain_tokens(row.text)
        assert row[2] == row[3]
