from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from roomtide.llm import line_dedup
from tests.llm.cases import awkward, documents, prose, sorted_rows

BLANKS = " \t\n\x0b\x0c\r"


def plain_key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_dedup(rows, min_chars=40, min_documents=5):
    holders: dict[str, set] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(plain_key(line)) >= min_chars:
                holders.setdefault(plain_key(line), set()).add(doc_id)
    keeper = {
        key: max(ids, key=lambda i: (i is not None, i or 0))
        for key, ids in holders.items()
        if len(ids) >= min_documents
    }
    results = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(plain_key(x), doc_id) == doc_id]
        results.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return results


def corpus() -> list[tuple[int | None, str | None]]:
    """One line is in every document, others in four, five or many, some twice in a document."""
    draw = random.Random(5)
    shared = [prose(50 + k, 9) for k in range(12)]
    accents = "é" * 39, "É" * 40
    rows: list[tuple[int | None, str | None]] = list(awkward())
    for doc in range(400):
        lines = [prose(1000 + doc, 10), "  " + shared[0].upper() + "\t\x0b"]
        lines += [shared[1]] * (doc % 3) + [shared[2]] * (doc < 4) + [shared[3]] * (doc < 5)
        lines += [draw.choice(shared[4:])] * draw.randint(0, 2) + list(accents) + ["short", ""]
        draw.shuffle(lines)
        rows.append((1000 + 3 * doc, "\n".join(lines)))
    return [*rows, (None, shared[3]), (5000, shared[3]), (5000, shared[3])]


@pytest.mark.parametrize("partitions", ["3", "64"])
def test_against_plain_version(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set(coalesce, "false")
    try:
        found = line_dedup.dedup_lines(documents(spark, corpus())).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(coalesce, "true")
    assert sorted_rows(found) == sorted_rows(plain_dedup(corpus()))


def test_small_arrow_batches_give_the_same(spark):
    """Runs go on over many batches."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        found = line_dedup.dedup_lines(documents(spark, corpus())).collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted_rows(found) == sorted_rows(plain_dedup(corpus()))


def test_a_document_that_is_a_third_of_all_rows(spark):
    """Its repeats are one entry for each of its lines, in the bitmaps and in a task's memory."""
    shared, copied = prose(1, 12), f"{prose(1, 12)}\n{prose(2, 12)}\n{prose(1, 12)}"
    rows = [(k, f"{shared}\n{prose(100 + k, 3)}") for k in range(600)]
    rows += [(7000, f"{shared}\nlast")] + [(6000, copied)] * 2000 + [(None, copied)] * 1000
    found = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert sorted_rows(found) == sorted_rows(plain_dedup(rows))


@pytest.mark.parametrize("most_waiting", [0, 2])
def test_rows_given_on_undecided_are_settled(monkeypatch, most_waiting):
    """What the streams of a sorted table say together is the same, wherever the table is cut."""
    draw = random.Random(4)
    rows = sorted(
        ((key, 0, -draw.randrange(9), text) for key in range(30) for text in range(draw.randrange(14))),
    )
    columns = ["h1", "h2", "doc_id", "text_hash"]

    def batch(part):
        named = {c: [abs(r[i]) if c == "doc_id" else r[i] for r in part] for i, c in enumerate(columns)}
        return pa.RecordBatch.from_pydict(named)

    going = {}
    for cuts in ([], [40, 41, 90]):
        # As the ranges of the sort do, cuts leave the rows of a document together.
        heads = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
        bounds = [0, *(next(h for h in heads if h >= c) for c in cuts), len(rows)]
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            parts = [batch(rows[i : min(i + 5, b)]) for i in range(a, b, 5)]
            for found in line_dedup._stream(iter(parts), 5, most_waiting):
                out += found.to_pylist()
        total, top = {}, {}
        for r in out:
            if r["kind"] == line_dedup._SUMMARY:
                total[r["h1"]] = total.get(r["h1"], 0) + r["docs"]
                top[r["h1"]] = max(top.get(r["h1"], -1), r["doc_id"])
        going[len(cuts)] = {
            tuple(r[c] for c in columns)
            for r in out
            if r["kind"] == line_dedup._GOES
            or (r["kind"] == line_dedup._OPEN and total[r["h1"]] >= 5 and r["doc_id"] != top[r["h1"]])
        }
    having = {}
    for key, _, doc, _ in rows:
        having.setdefault(key, set()).add(-doc)
    expected = {
        (key, 0, -doc, text)
        for key, _, doc, text in rows
        if len(having[key]) >= 5 and -doc != max(having[key])
    }
    assert going[0] == expected and going[3] == expected


def test_bitmaps_only_for_documents_that_lose_lines(spark):
    found = line_dedup.keep_bitmaps(documents(spark, corpus())).collect()
    losing = [r for r in plain_dedup(corpus()) if r[3]]
    assert len(found) == len(set(losing))
    assert all(len(r.bitmap) < 100 for r in found)


def test_bitmap_round_trip():
    keep = np.random.default_rng(1).integers(0, 2, 1001).astype(np.uint8)
    packed = line_dedup.pack_bitmap(keep)
    assert (line_dedup.unpack_bitmap(packed, 1001) == keep).all()


def test_empty_table(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []
