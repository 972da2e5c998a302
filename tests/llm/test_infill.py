from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtide.llm import infill
from tests.compare import TESTDATA
from tests.llm.cases import awkward, documents, prose, sorted_rows


def plain_version(doc_id, text, plain=10, spm=20):
    """Output, form and cuts by slicing the decoded text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or h[2] % 100 >= 100 - plain or any(m in text for m in infill.MARKS):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def mixed(seed, length, alphabet="aé日🙂\n"):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(length))


TEXTS = [
    "a" * 200_000,
    "é" * 70_000,
    mixed(1, 90_000),
    mixed(2, 150_000, "ab\n"),
    ("a" * 999 + "日") * 300,
    "é" * 32_768 + "a",
    "a" * 65_536,
    "\n" * 5,
    "one\ntwo",
    "日",
]


@pytest.mark.parametrize("unit", infill.UNITS)
@pytest.mark.parametrize("text", TEXTS)
def test_every_kind_of_container_selects_like_a_list(text, unit):
    raw = text.encode()
    units = infill.BoundarySet(raw, unit)
    if unit == "character":
        parts = text
    else:
        parts = text.splitlines(keepends=True)
    ends = np.cumsum([0] + [len(p.encode()) for p in parts])
    assert len(units) == len(parts)
    for n in {0, 1, len(parts) // 3, len(parts) // 2, max(len(parts) - 1, 0), len(parts)}:
        assert units.select(n) == ends[n]
    draw = random.Random(3)
    for n in draw.choices(range(len(parts) + 1), k=50):
        assert units.select(n) == ends[n]


def test_containers_of_each_kind_are_used():
    kinds = {
        type(c)
        for text in TEXTS
        for unit in infill.UNITS
        for c in infill.BoundarySet(text.encode(), unit).containers
    }
    assert kinds == {infill.ArrayContainer, infill.BitmapContainer, infill.RunContainer}


def test_against_slices_and_back(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(200 + i, mixed(i, i % 40)) for i in range(300)]
    rows += [(600, "has <P> in it"), (601, "has <M>"), (602, "< P><<S"), (603, "<S"), (604, "P>")]
    found = infill.fill_in_middle(documents(spark, rows))
    back = found.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = back.collect()
    expected = [plain_version(i, t) for i, t in rows]
    assert sorted_rows([r[:6] for r in got]) == sorted_rows(expected)
    assert sorted_rows([(r.doc_id, r.back) for r in got]) == sorted_rows(
        [(i, t or "") for i, t in rows]
    )
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_lines_as_units(spark):
    rows = [(i, prose(i, 30).replace(" ", "\n")) for i in range(40)]
    found = infill.fill_in_middle(documents(spark, rows), unit="line", plain_percent=0)
    for r in found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        lines = dict(rows)[r.doc_id].splitlines(keepends=True)
        middle = "".join(lines[r.prefix_units : r.prefix_units + r.middle_units])
        assert r.output.endswith("<M>" + middle) and r.back == dict(rows)[r.doc_id]


def test_shares_follow_the_parameters(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    forms = infill.fill_in_middle(docs, plain_percent=0, spm_percent=100).groupBy("form").count()
    assert set(r.form for r in forms.where("count > 10").collect()) == {"spm"}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("a", "", "b"), ("a", "xay", "b")])
def test_marks_that_could_be_confused(spark, marks):
    with pytest.raises(ValueError):
        infill.fill_in_middle(documents(spark, [(1, "a")]), marks=marks)


def test_unknown_unit_and_no_rows(spark):
    with pytest.raises(ValueError):
        infill.fill_in_middle(documents(spark, [(1, "a")]), unit="word")
    assert infill.fill_in_middle(documents(spark, [(1, "a")]).limit(0)).collect() == []
