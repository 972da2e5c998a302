"""Short questions, whatever stands before and after them."""

from __future__ import annotations

from roomtide.llm import decontaminate
from tests.llm.cases import documents
from tests.llm.test_decontaminate import found

RIVER = "What is the name of the longest river that flows through Europe?"
BEFORE = ["", "Question: ", "A heading without a full stop\n", "one, ", "Part Two ", "Done. ", "12 "]


def test_a_short_question_after_anything(spark):
    texts = [(k, f"{before}{RIVER} Nobody said.") for k, before in enumerate(BEFORE)]
    assert found(spark, texts, [RIVER]) == {(k, 0): True for k in range(len(BEFORE))}


def test_every_window_counts_in_every_context(spark):
    benchmark = spark.createDataFrame([(0, RIVER)], "item_id bigint, text string")
    texts = [(k, before + RIVER) for k, before in enumerate(BEFORE)]
    rows = decontaminate.contaminated(documents(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.n_windows) for r in rows} == {(k, 5) for k in range(len(BEFORE))}


def test_names_and_units_at_the_ends(spark):
    questions = [
        "Alice Smith sells seven old hats to the man from Oslo",
        "Miles are longer than feet by how much in the end",
    ]
    texts = [
        (1, f"Question: {questions[0]}\nAnswer: none"),
        (2, f"Question: {questions[0].replace('Alice Smith', 'Bob')}"),
        (3, f"from 12 {questions[1]}"),
        (4, f"Riddle {questions[1]}"),
    ]
    expected = {(1, 0): True, (2, 0): False, (3, 1): True, (4, 1): True}
    assert found(spark, texts, questions) == expected
