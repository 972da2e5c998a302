"""Questions of which a stretch is in a document, whatever contradicts it elsewhere."""

from __future__ import annotations

import random

from roomtide.llm import decontaminate
from tests.llm.cases import awkward, documents, prose, sorted_rows
from tests.llm.plain_decontamination import plain_contaminated
from tests.llm.test_decontaminate import QUESTION, asked, found

FIRST, LAST = QUESTION.split("120 km in")


def test_one_contradicting_value_leaves_the_rest(spark):
    """Word for word are 23 tokens behind the first 120 km, 21 between the two, 17 before Alice."""
    texts = [
        (1, f"{FIRST}250 km in{LAST}"),
        (2, asked(n120="20")),
        (3, asked(Alice="Lyon")),
        (4, f"{prose(1, 20)} {FIRST}250 km in{LAST} {prose(2, 20)}"),
    ]
    assert set(found(spark, texts)) == {(k, 0) for k, _ in texts}


def test_contradictions_in_every_13_tokens_are_another_question(spark):
    question = "in a box of 5 or of 5 or of 5 or of 5 and so on or of 5 or of 5 then"
    assert found(spark, [(1, question)], [question]) == {(1, 0): True}
    changed = "in a box of 6 or of 7 or of 8 or of 9 and so on or of 7 or of 8 then"
    assert found(spark, [(1, changed)], [question]) == {}


def test_changed_values_against_plain_version(spark):
    draw = random.Random(9)
    bank = [
        QUESTION,
        "If Bob has 12 apples, and Carol has 15 apples, then Bob gives Carol 3 apples; who has more?",
    ]
    rows = []
    for k in range(120):
        words = draw.choice(bank).split(" ")
        slots = [i for i, w in enumerate(words) if w[0].isdigit() or w in ("Lyon", "Alice", "Carol")]
        for at in draw.sample(slots, min(len(slots), draw.randint(0, 3))):
            new = ["7", "12", "20"] if words[at][0].isdigit() else ["Dora", "Alice", "Emil"]
            words[at] = draw.choice(new)
        rows.append((k, f"{prose(k, draw.randint(0, 9))} {' '.join(words)} {prose(k + 500, 3)}"))
    rows += awkward()
    benchmark = spark.createDataFrame(list(enumerate(bank)), "item_id bigint, text string")
    results = decontaminate.contaminated(documents(spark, rows), benchmark).collect()
    expected = plain_contaminated(rows, list(enumerate(bank)))
    assert sorted_rows(results) == sorted_rows(expected)
    assert {r[3] for r in expected} == {True, False} and len({r[2] for r in expected}) > 3
