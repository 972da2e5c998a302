from __future__ import annotations

import random

import pytest

from roomtide.llm import decontaminate, queries
from tests.llm.cases import awkward, documents, prose, sorted_rows
from tests.llm.plain_decontamination import plain_contaminated

QUESTION = (
    "A train leaves the city of Lyon at noon and travels 120 km in 3 hours, then Alice walks "
    "for 20 minutes to her house; how far has she gone when Alice arrives after 120 km?"
)


def asked(**new: str) -> str:
    text = QUESTION
    for old, value in new.items():
        text = text.replace(old.removeprefix("n"), value)
    return text


def found(spark, texts, questions=(QUESTION,)):
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame(
        [*enumerate(questions), (90, None), (91, ""), (92, "too short")],
        "item_id bigint, text string",
    )
    rows = decontaminate.contaminated(docs, benchmark).collect()
    return {(r.doc_id, r.item_id): r.exact for r in rows}


def test_exact_and_cased_copies_in_the_middle_of_a_text(spark):
    texts = [
        (1, QUESTION),
        (2, f"{prose(1, 50)}. {QUESTION} {prose(2, 50)}"),
        (3, prose(3, 100)),
        (4, QUESTION.replace(" ", "  \n")),
        (5, QUESTION.replace(",", " *** ").replace(";", " &&& ")),
    ]
    assert found(spark, texts) == {(1, 0): True, (2, 0): True, (4, 0): True, (5, 0): True}


def test_other_numbers_names_and_units(spark):
    texts = [
        (1, asked(n120="250", Alice="Bertha", Lyon="Paris")),
        (2, asked(n120="250").replace("km", "miles")),
    ]
    assert found(spark, texts) == {(1, 0): False, (2, 0): False}


def test_shape_alone_is_no_match(spark):
    numbers = " ".join(map(str, range(100, 130)))
    assert found(spark, [(1, numbers)], [numbers.replace("1", "2")]) == {}


def test_half_a_long_question_is_found_and_a_few_words_are_not(spark):
    question = prose(20, 40).translate({ord(c): None for c in "0123456789"})
    question = " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i, w in enumerate(question.split()))
    words = question.split()
    texts = [(1, " ".join(words[:20])), (2, " ".join(words[5:15])), (3, prose(21, 60))]
    assert found(spark, texts, [question]) == {(1, 0): True}


def test_awkward_rows_and_empty_tables(spark):
    rows = [*awkward(), (None, QUESTION), (7, QUESTION), (7, QUESTION)]
    assert found(spark, rows) == {(None, 0): True, (7, 0): True}
    assert found(spark, []) == {}
    assert found(spark, awkward(), []) == {}


def test_plan_has_no_python_and_joins_hashes_only(spark):
    docs = documents(spark, [(1, QUESTION)])
    benchmark = spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string")
    plan = decontaminate.contaminated(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["", "abc", None])
def test_short_texts_have_no_windows(spark, text):
    assert found(spark, [(1, text)]) == {}


def test_given_tables_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    expected = plain_contaminated(docs, items)
    assert len(expected) >= 3
    assert sorted_rows(queries.op2_decontamination(spark, sf).collect()) == sorted_rows(expected)


def test_changed_questions_against_plain_version(spark):
    draw = random.Random(8)
    bank = [asked(), "If Bob has 12 apples, and Carol has 15 apples, then Bob gives Carol 3 apples; who has more?"]
    bank.append("In 5 days, or 5 nights, the ship sails 900 km from Oslo to Bergen and 900 km back to Oslo.")
    rows = []
    for k in range(150):
        words = draw.choice(bank).split(" ")
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(words))
            words[at] = draw.choice(["7", "12", "Dora", "Bergen", "miles", "the", "", "days,", "x\ny"])
        rows.append((k, f"{prose(k, draw.randint(0, 9))} {' '.join(words)} {prose(k + 500, 3)}"))
    rows += awkward()
    benchmark = spark.createDataFrame(list(enumerate(bank)), "item_id bigint, text string")
    results = decontaminate.contaminated(documents(spark, rows), benchmark).collect()
    expected = plain_contaminated(rows, list(enumerate(bank)))
    assert sorted_rows(results) == sorted_rows(expected)
    assert {r[3] for r in expected} == {True, False} and 20 < len(expected) < 150
