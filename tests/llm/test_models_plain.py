"""Language and toxicity models against versions that go letter by letter and weight by weight."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from roomtide.llm import language, toxicity
from roomtide.llm.common import share
from tests.llm.cases import documents, prose


def plain_buckets(text: str, sizes, dims: int) -> Counter:
    letters = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    letters = f" {letters} "
    while "  " in letters:
        letters = letters.replace("  ", " ")
    found = Counter()
    for size in sizes:
        for at in range(len(letters) - size + 1):
            rolling = 0
            for c in letters[at : at + size]:
                rolling = (rolling * 0x01000193 + ord(c)) % 2**32
            mixed = (rolling * 0x9E3779B1 + size) % 2**32
            mixed ^= mixed >> 15
            mixed = mixed * 0x2C1B3C6D % 2**32
            mixed ^= mixed >> 13
            found[mixed % dims] += 1
    return found


def chances(logits: list[float]) -> list[float]:
    raised = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(raised) for x in raised]


class PlainLanguages:
    """TF-IDF, follow-the-regularised-leader and temperature, one coordinate at a time."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.names = sorted({lang for _, lang in rows})
        grams = [plain_buckets(text, language.SIZES, language.BUCKETS) for text, _ in rows]
        self.n, self.df = len(rows), Counter(b for g in grams for b in g)
        self.z, self.squares = Counter(), Counter()
        vectors = [self.vector(g) for g in grams]
        labels = [self.names.index(lang) for _, lang in rows]
        learned = [k for k in range(len(rows)) if k % 5]
        order = np.random.default_rng(0)
        for _ in range(3):
            for at in order.permutation(len(learned)):
                self.learn(vectors[learned[at]], labels[learned[at]])
        aside = [k for k in range(len(rows)) if k % 5 == 0]
        losses = {}
        for t in np.geomspace(0.02, 50, 96).tolist():
            found = [chances([x / t for x in self.logits(vectors[k])]) for k in aside]
            right = [max(c[labels[k]], 1e-12) for c, k in zip(found, aside, strict=True)]
            losses[t] = -sum(map(math.log, right)) / len(right)
        self.temperature = min(losses, key=losses.get)

    def vector(self, grams: Counter) -> dict[int, float]:
        values = {
            b: (1 + math.log(c)) * (math.log((1 + self.n) / (1 + self.df[b])) + 1)
            for b, c in grams.items()
        }
        length = math.sqrt(sum(v * v for v in values.values()))
        return {b: v / length for b, v in values.items()}

    def weight(self, label: int, bucket: int) -> float:
        z, n = self.z[label, bucket], self.squares[label, bucket]
        if abs(z) <= 0.02:
            return 0.0
        return -(z - math.copysign(0.02, z)) / ((1 + math.sqrt(n)) / 0.5 + 0.001)

    def logits(self, vector: dict[int, float]) -> list[float]:
        return [
            sum(v * self.weight(k, b) for b, v in vector.items()) for k in range(len(self.names))
        ]

    def learn(self, vector: dict[int, float], label: int) -> None:
        found = chances(self.logits(vector))
        for k, chance in enumerate(found):
            for b, v in vector.items():
                gradient, n, w = (chance - (k == label)) * v, self.squares[k, b], self.weight(k, b)
                step = (math.sqrt(n + gradient**2) - math.sqrt(n)) / 0.5
                self.z[k, b] += gradient - step * w
                self.squares[k, b] += gradient**2

    def predict(self, text: str) -> tuple[str, float]:
        vector = self.vector(plain_buckets(text, language.SIZES, language.BUCKETS))
        found = chances([x / self.temperature for x in self.logits(vector)])
        return self.names[found.index(max(found))], max(found)


WORDS = {"de": "der und schön nicht", "en": "the and was not", "fr": "le et été pas"}


def spoken() -> list[tuple[str, str]]:
    draw, rows = random.Random(3), []
    for lang, count in (("de", 20), ("en", 34), ("fr", 11)):
        for k in range(count):
            words = [draw.choice(WORDS[lang].split()) for _ in range(6)]
            rows.append((f"{' '.join(words)} {prose(k, 3)}", lang))
    # Some rows are marked wrongly, so that the chances are not all near one.
    return [(t, "en" if k % 9 == 4 else lang) for k, (t, lang) in enumerate(rows)]


def test_languages_against_plain_version(spark):
    table = spark.createDataFrame(spoken(), "text string, lang string")
    model = language.train(table)
    # Rows are learned from in the order of their draw.
    ordered = table.orderBy(share(3, "text", "lang")).collect()
    plain = PlainLanguages([(r.text, r.lang) for r in ordered])
    assert model.languages == plain.names
    assert model.temperature == pytest.approx(plain.temperature)
    for label, bucket in random.Random(1).sample(sorted(plain.z), 400):
        assert model.weights[label, bucket] == pytest.approx(plain.weight(label, bucket), abs=1e-9)
    assert np.count_nonzero(model.weights) == sum(plain.weight(*at) != 0 for at in plain.z)
    asked = [f"{' '.join(words.split()[::-1])} {prose(90, 2)}" for words in WORDS.values()]
    for text in [*asked, "Schön 12!", "x", "ÉTÉ  le\npas", "the der le"]:
        lang, score = plain.predict(text)
        assert model.predict(text) == (lang, pytest.approx(score, abs=1e-9))


def plain_toxicity(rows: list[tuple[str, int]], asked: list[str]) -> list[float]:
    """Log-count ratios of all n-grams, and a regression on those that tell something."""
    sets = [set(plain_buckets(t, toxicity.SIZES, toxicity.BUCKETS)) for t, _ in rows]
    labels = [label for _, label in rows]
    n_toxic, n_clean = sum(labels), len(labels) - sum(labels)
    toxic, clean = Counter(), Counter()
    for grams, label in zip(sets, labels, strict=True):
        (toxic if label else clean).update(grams)
    ratios = {}
    for b in toxic | clean:
        ratio = math.log((toxic[b] + 1) / (n_toxic + 2) * (n_clean + 2) / (clean[b] + 1))
        if toxic[b] + clean[b] >= 6 and abs(ratio) >= 2:
            ratios[b] = ratio
    sets = [sorted(grams & ratios.keys()) for grams in sets]
    weights, scale = dict.fromkeys(ratios, 0.0), dict.fromkeys(ratios, 1e-8)
    bias, bias_scale = math.log(n_toxic / n_clean), 1e-8
    for _ in range(100):
        gradient, total = {b: 1e-4 * w for b, w in weights.items()}, 0.0
        for grams, label in zip(sets, labels, strict=True):
            logit = bias + sum(ratios[b] * weights[b] for b in grams)
            error = (1 / (1 + math.exp(-logit)) - label) / len(rows)
            total += error
            for b in grams:
                gradient[b] += error * ratios[b]
        for b, g in gradient.items():
            scale[b] += g * g
            weights[b] -= 0.1 * g / math.sqrt(scale[b])
        bias_scale += total * total
        bias -= 0.1 * total / math.sqrt(bias_scale)
    scores = []
    for text in asked:
        grams = set(plain_buckets(text, toxicity.SIZES, toxicity.BUCKETS)) & ratios.keys()
        logit = bias + sum(ratios[b] * weights[b] for b in grams)
        scores.append(1 / (1 + math.exp(-logit)))
    return scores


def test_toxicity_against_plain_version(spark):
    draw, rows = random.Random(5), []
    for k in range(160):
        words = prose(k, 12).split()
        if k % 4 == 0:
            words.insert(draw.randint(0, 12), draw.choice(["nastyword", "Vile-Term", "übel"]))
        rows.append((" ".join(words), int(k % 4 == 0 or k % 37 == 1)))
    labels = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id bigint, toxic int")
    asked = ["", "vile", "a nastyword, übel", prose(7, 40), *(prose(k, 9) + " vile term" for k in range(9))]
    model = toxicity.train(documents(spark, [(k, t) for k, (t, _) in enumerate(rows)]), labels)
    found = toxicity.toxicity_scores(documents(spark, list(enumerate(asked))), model).collect()
    scores = {r.doc_id: r.score for r in found}
    for k, score in enumerate(plain_toxicity(rows, asked)):
        assert scores[k] == pytest.approx(score, abs=1e-4)
