from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtide.llm import katz
from roomtide.llm.queries import op13_katz
from tests.compare import TESTDATA
from tests.llm.cases import awkward, documents, prose, sorted_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, END = " ", "\n"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


class PlainKatz:
    """The model with one dictionary for each length, after the textbook."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            words = [BEGIN] * (order - 1) + [*WORD.findall(lowered(text or "")), END]
            for at in range(order - 1, len(words)):
                for n in range(order):
                    self.counts[n][tuple(words[at - n : at + 1])] += 1
        self.kept, self.after = [], []
        for table in self.counts:
            of = Counter(table.values())
            self.kept.append(katz.discounts(np.array([of[r] for r in range(1, katz.CUT + 2)], float)))
            after = defaultdict(dict)
            for gram, n in table.items():
                after[gram[:-1]][gram[-1]] = n
            self.after.append(after)
        self.weights = {}

    def kept_count(self, n, count):
        return count * self.kept[n][count if count <= katz.CUT else 0]

    def chance(self, gram):
        n = len(gram) - 1
        seen = self.after[n].get(gram[:-1])
        if n == 0:
            total = sum(self.after[0][()].values())
            if gram[0] in self.after[0][()]:
                return self.kept_count(0, self.after[0][()][gram[0]]) / total
            return 1 - math.fsum(self.kept_count(0, c) for c in self.after[0][()].values()) / total if total else 1.0
        if not seen:
            return self.chance(gram[1:])
        total = sum(seen.values())
        if gram[-1] in seen:
            return self.kept_count(n, seen[gram[-1]]) / total
        if gram[:-1] not in self.weights:
            left = 1 - math.fsum(self.kept_count(n, c) for c in seen.values()) / total
            taken = math.fsum(self.chance((*gram[1:-1], w)) for w in seen)
            self.weights[gram[:-1]] = left / (1 - taken)
        return self.weights[gram[:-1]] * self.chance(gram[1:])

    def row(self, text):
        words = [*WORD.findall(lowered(text or "")), END]
        padded = [BEGIN] * (self.order - 1) + words
        score = math.fsum(
            math.log10(self.chance(tuple(padded[at : at + self.order]))) for at in range(len(words))
        )
        known, total = self.counts[0], sum(self.counts[0].values())
        base = math.fsum(
            math.log10((known[w,] + 0.1) / (total + 0.1 * (len(known) + 1))) for w in words
        )
        return len(words), sum((w,) in known for w in words), total, base, score


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


LEARN = "crc32(CAST(doc_id AS STRING)) % 10 != 0"


def check(spark, rows, order, **arguments):
    got = katz.score_texts(documents(spark, rows), F.expr(LEARN), order, **arguments).collect()
    model = PlainKatz([t for i, t in rows if learns(i)], order)
    expected = [(i, learns(i), *model.row(t)) for i, t in rows]
    found = sorted_rows([(r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got])
    assert [r[:5] for r in found] == [r[:5] for r in sorted_rows(expected)]
    for a, b in zip(found, sorted_rows(expected), strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def sentences(seed, n, words="a b c d e f g h the The of".split()):
    draw = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(draw.choices(words, weights, k=draw.randint(0, 30))) for _ in range(n)]


def rows_of(seed, n):
    return list(enumerate(sentences(seed, n))) + [(n + i, prose(i, 12)) for i in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain_version(spark, order):
    check(spark, rows_of(order, 120) + awkward(), order)


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("frequent", [0, 20])
def test_small_blocks_and_partitions_and_frequent_contexts(spark, order, frequent):
    check(
        spark, rows_of(5, 150), order, block_tokens=200, partition_grams=64, frequent=frequent
    )


def test_one_word_is_most_of_the_corpus(spark):
    rows = [(i, "is onhe. " * 40 + f"w{i % 7} onhe. x{i}") for i in range(60)]
    check(spark, rows, 2, frequent=100, block_tokens=500)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_after_every_context_sum_to_one(spark, order):
    """Scores of texts that differ in their last word only are those of the words."""
    learned = [t for t in sentences(3, 200) if t]
    known = sorted({w for t in learned for w in t.split()} | {w.lower() for t in learned for w in t.split()})
    known = sorted({lowered(w) for w in known})
    starts = ["the", "a of", "b c", "a a", "zzz", "h the of"]
    model = PlainKatz(learned, order)
    for start in starts:
        context = tuple(([BEGIN] * order + start.split())[-(order - 1) :])
        total = math.fsum(model.chance((*context, w)) for w in [*known, END, "never seen"])
        assert total == pytest.approx(1, abs=1e-12)
    rows = [(i, t) for i, t in enumerate(learned)]
    rows += [(10_000 + i, t) for i, t in enumerate(starts)]
    docs = documents(spark, rows)
    got = katz.score_texts(docs, F.col("doc_id") < 10_000, order).where("doc_id >= 10000").collect()
    for r in got:
        assert r.score == pytest.approx(model.row(starts[r.doc_id - 10_000])[4], rel=1e-9)


def test_discounts():
    kept = katz.discounts(np.array([1000, 400, 220, 140, 100, 70], float))
    assert (kept[1:] > 0).all() and (kept[1:] < 1).all()
    common = 6 * 70 / 1000
    assert kept[1] == pytest.approx((2 * 400 / 1000 - common) / (1 - common))
    # No n-gram is counted three times, so Good-Turing says nothing.
    kept = katz.discounts(np.array([100, 10, 0, 5, 1, 1], float))
    assert kept[1:].tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]
    assert katz.discounts(np.zeros(6))[1:].tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_packing():
    numbers = np.array([0, -1, 2**63 - 1, -(2**63), 5] * 1000)
    assert (katz.unpacked(katz.packed(numbers)) == numbers).all()
    assert katz.unpacked(katz.packed(np.array([], np.int64))).tolist() == []


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(katz, "_PIECE", 10)
    text = prose(3, 500).encode()
    numbers = katz._Numbers()
    found = katz.tokens_of(text, numbers).tolist()
    words = list(numbers)
    assert [words[i] for i in found] == [*text.split(), b"\n"]


def test_nothing_to_learn_from_and_no_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = katz.score_texts(docs, F.lit(False)).collect()
    assert sorted((r.doc_id, r.score, r.base_score, r.n_known, r.train_tokens) for r in got) == [
        (1, 0.0, 0.0, 0, 0),
        (2, 0.0, 0.0, 0, 0),
    ]
    assert katz.score_texts(docs.limit(0), F.lit(True)).collect() == []


def test_given_documents(spark):
    """Whole table against the plain version, and better than single words on texts kept aside."""
    sf_dir = f"{TESTDATA}/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    model = PlainKatz([t for i, t in rows if learns(i)], 2)
    texts = dict(rows)
    got = op13_katz(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = model.row(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == expected[:3]
        assert (r.base_score, r.score) == pytest.approx(expected[3:], rel=1e-9)
        assert r.held_out != learns(r.doc_id)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
