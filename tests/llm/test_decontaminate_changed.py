"""Questions asked again with other numbers, names and units: what share is found, and false alarms."""

from __future__ import annotations

import pytest

from roomtide.llm import decontaminate
from tests.llm.cases import documents, prose

APPLES = (
    "Alice has 12 apples in a small basket. Alice gives 3 apples to her brother and eats the rest "
    "on the way home from school"
)
PENS = "There are three red pens and two blue pens in the box so how many pens are there in all"
DISK = "The archive at NASA grows by 120 GB in a week and nobody knows when the old disks are full"
TRAIN = "A train leaves Lyon at noon and travels 120 km in 3 hours before it stops for the night in a village"
SHOP = "Bob pays $45 for two shirts and a hat that costs $9 more than one shirt so what does the hat cost"
TANK = "Water runs into the empty tank at 7.5 litres a minute while 2 litres a minute run out of it again"

#: Question, and its changes.
CHANGED = {
    APPLES: [
        {"Alice": "Bob"},
        {"Alice": "Bob", "12": "20"},
        {"Alice": "Mary Ann", "3": "five"},
        {"12": "twelve"},
        {"12": "1,200", "3": "300"},
        {"Alice": "ALICE"},
    ],
    PENS: [
        {"three": "five", "two": "six"},
        {"three": "3", "two": "2"},
        {"three": "twenty-five"},
        {"two": "two hundred"},
        {"three": "12.5"},
    ],
    DISK: [
        {"NASA": "ESA", "GB": "TB"},
        {"NASA": "CERN", "120": "4"},
        {"120 GB": "120GB"},
        {"GB": "gigabytes"},
        {"120 GB": "three terabytes"},
        {"NASA": "New York University"},
    ],
    TRAIN: [
        {"Lyon": "Paris"},
        {"Lyon": "New York City", "120": "90"},
        {"km": "miles"},
        {"120 km": "75.5 kilometres", "3 hours": "40 minutes"},
        {"3": "three"},
        {"Lyon": "Saint-Denis"},
    ],
    SHOP: [
        {"Bob": "Carol"},
        {"$45": "€60", "$9": "€12"},
        {"two": "three", "45": "90"},
        {"Bob": "Anna Maria", "$9": "$7.25"},
    ],
    TANK: [
        {"7.5": "12"},
        {"litres": "gallons"},
        {"litres": "ml", "minute": "second"},
        {"7.5": "nine", "2": "four"},
        {"minute": "hour"},
    ],
}
#: A unit that follows no number ("a minute") is a plain word, and two changes of it break the stretch.
MISSED = {(TANK, 2), (TANK, 4)}


def variants():
    for question, changes in CHANGED.items():
        for n, change in enumerate(changes):
            text = question
            for old, new in change.items():
                assert old in text
                text = text.replace(old, new)
            yield (question, n), text


def test_changed_questions_are_found_and_others_are_not(spark):
    bank = list(CHANGED)
    cases = list(variants())
    assert len(cases) >= 30
    rows = [(n, f"{prose(n, 30)}. {text}. {prose(n + 500, 20)}") for n, (_, text) in enumerate(cases)]
    clean = [
        "Alice has a brother who eats apples on the way home, and Bob has 12 pens in a box.",
        "There are 25 trains that leave Paris at noon, and 3 of them stop in Lyon for 20 minutes.",
        "The box in the archive is full of old disks, 120 GB each, and nobody at ESA knows why.",
        "Carol pays $9 for a hat and $45 for two shirts, one of which costs more than the other.",
        "Water runs out of the tank at 2 litres a minute when it is full, so it is empty at night.",
        "So how many pens are there in the three boxes that Bob and Alice gave to their school?",
    ]
    rows += [(1000 + n, text) for n, text in enumerate(clean)]
    rows += [(2000 + n, prose(n, 200)) for n in range(50)]
    benchmark = spark.createDataFrame(list(enumerate(bank)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), benchmark).collect()}
    expected = {(n, bank.index(key[0])) for n, (key, _) in enumerate(cases)}
    missed = {cases[n][0] for n, _ in expected - got}
    assert not got - expected
    assert missed <= MISSED, missed


def test_shared_instructions_pair_nothing(spark):
    """All questions begin alike; documents that have only the instruction are no hits, and alignments
    start where a question is itself."""
    instruction = "answer the following question with one short word and give no reason for the answer you give"

    def own(n):
        return " ".join(f"{w}{chr(97 + n % 26)}{chr(97 + n // 26)}" for w in "who met which old king under what green tree by the sea".split())

    bank = [(n, f"{instruction} {own(n)}") for n in range(100)]
    rows = [(n, f"{prose(n, 10)} {instruction} {prose(n + 7, 10)}") for n in range(300)]
    rows += [(1000 + n, f"{prose(n, 5)} {bank[n][1]}") for n in range(20)]
    benchmark = spark.createDataFrame(bank, "item_id bigint, text string")
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(1000 + n, n) for n in range(20)}
    items = decontaminate._items(benchmark, 8, 4)
    anchors = decontaminate._anchors(items, 8, decontaminate.SHARED)
    assert anchors.groupBy("hash").agg({"item_id": "count"}).where("`count(item_id)` > 2").count() == 0
