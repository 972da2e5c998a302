from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtide.llm import hard_negatives
from tests.llm.cases import sorted_rows

SCHEMA = "vec_id bigint, label int, vector array<bigint>, low int, block string, window int"


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_hand(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows if None not in (i, label, v)})
    found = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-product(v, w), j, other) for j, other, w in rows)
        near = [(s, j) for s, j, other in scored if other == label and j != i][:positives]
        for s, j in near:
            window = [
                (t, k) for t, k, other in scored if other != label and low * -s <= 100 * -t <= high * -s
            ]
            found += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(window[:negatives])]
    return found


def frame(spark, rows):
    full = [(i, label, v, 1, "b", 2) for i, label, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def clustered(seed, n, dims, labels, spread=20):
    draw = random.Random(seed)
    centres = [[draw.randint(-100, 100) for _ in range(dims)] for _ in range(labels + 2)]
    return [
        (i, draw.randrange(labels), [x + draw.randint(-spread, spread) for x in draw.choice(centres)])
        for i in range(n)
    ]


def check(spark, rows, every=5, **arguments):
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % every == 0, **arguments).collect()
    expected = by_hand(rows, lambda i: i % every == 0, **arguments)
    assert sorted_rows(got) == sorted_rows(expected)
    return got


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "_BLOCKS_PER_TASK", 2)


@pytest.mark.parametrize("seed,dims,labels", [(1, 20, 3), (2, 64, 10), (3, 1, 2), (4, 9, 40)])
def test_against_all_scores(spark, seed, dims, labels):
    assert check(spark, clustered(seed, 300, dims, labels))


def test_blocks_of_few_rows(spark, small_blocks):
    assert check(spark, clustered(5, 150, 12, 4))


def test_other_windows(spark):
    rows = clustered(6, 200, 16, 4)
    assert check(spark, rows, positives=2, negatives=7, low=-20, high=100)


def test_copies_ties_and_repeats(spark, small_blocks):
    """A third of the rows are one vector, others tie in score, some rows repeat."""
    rows = clustered(7, 120, 8, 3)
    rows += [(1000 + i, i % 3, [3, 1, 4, 1, 5, 9, 2, 6]) for i in range(60)]
    rows += [(i, label, list(reversed(v))) for i, label, v in rows[:20]]
    assert check(spark, rows + rows[:30])


def test_nulls_zeros_lengths_and_large_numbers(spark):
    rows = clustered(8, 60, 6, 2)
    rows += [(None, 1, [1] * 6), (200, None, [1] * 6), (205, 1, None), (210, 1, []), (215, 0, [0] * 6)]
    rows += [(220, 0, [5, 5]), (225, 1, [7] * 30), (230, 1, [-50] * 6)]
    rows += [(300 + i, i % 2, [2**27 + i, 2**27 - i, i]) for i in range(20)]
    assert check(spark, rows)


def test_scores_of_zero_have_negatives_of_zero(spark):
    rows = [(0, 1, [1, 0]), (1, 1, [0, 3]), (2, 2, [0, 5]), (3, 2, [1, 0])]
    assert check(spark, rows) == [(0, 1, 1, 2, 0, 0)]


def test_empty_tables(spark):
    nothing = frame(spark, clustered(1, 10, 4, 2)).limit(0)
    assert hard_negatives.mine(nothing, F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, clustered(1, 10, 4, 2)), F.lit(False)).collect() == []


def test_vectors_become_whole_numbers(spark):
    rows = [
        (1, 1, [0.5, -0.001, 1 / 3]),
        (2, 1, [float("nan"), 0.0]),
        (3, 1, [float("-inf")]),
        (4, 1, [None, 1.0]),
        (5, 1, [1e30]),
        (None, 1, [1.0]),
        (6, None, [1.0]),
        (7, 1, None),
        (8, 1, []),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    found = hard_negatives.integer_vectors(table).collect()
    assert sorted_rows(found) == [(1, 1, [128, -1, 85]), (8, 1, [])]


def test_trailing_dimensions_stay_out_of_the_index():
    """Rows whose rest can't lift a score to the threshold are indexed in part, and pairs are only
    completed where their bound allows."""
    draw = np.random.default_rng(0)
    scale = np.where(np.arange(64) < 8, 200, 4)
    rows = (draw.normal(size=(200, 64)) * scale).astype(np.int64)
    index = hard_negatives.Postings(rows[:10], rows)
    truth = rows[:10] @ rows.T
    threshold = np.sort(truth, axis=1)[:, -3].astype(float)
    i, j, score = index.probe(threshold, np.ones(truth.shape, bool))
    assert index.depth.max() < len(index.chunks)
    assert (score == truth[i, j]).all()
    assert {*zip(*np.nonzero(truth >= threshold[:, None]))} <= {*zip(i, j)}
    assert len(i) < truth.size / 4
