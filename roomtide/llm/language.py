"""Language of a text by sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed n-grams of one to three letters; document frequencies come
from all rows that may be learned from. The weights are trained with follow-the-regularised-leader
and an elastic net, which leaves most of them zero, on a bounded sample with as many rows of each
language as there are. Part of the sample is kept aside for the temperature that makes the
probabilities fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, share
from roomtide.llm.ngrams import bucket_counts

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
SAMPLE_ROWS = 2048
UNKNOWN = "und"
_EPOCHS = 3
_ALPHA, _BETA, _L1, _L2 = 0.5, 1.0, 0.02, 0.001
_FOLD_ASIDE = 5
Sparse = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        buckets, values = tf_idf(*bucket_counts(text, SIZES, BUCKETS), self.idf)
        chances = softmax(self.weights[:, buckets] @ values / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(min(chances[best], 1.0))


def tf_idf(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Sparse:
    values = (1 + np.log(counts)) * idf[buckets]
    return buckets, values / (np.linalg.norm(values) or 1.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=0))
    return raised / raised.sum(axis=0)


def train_ftrl(rows: list[Sparse], labels: np.ndarray, classes: int, dims: int) -> np.ndarray:
    """Weights (classes x dims) after a few passes of the proximal update with per-coordinate
    learning rates; a coordinate whose sum stays within the L1 penalty has weight zero."""
    sums, squares = np.zeros((classes, dims)), np.zeros((classes, dims))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - _L1, 0)
        return -shrunk / ((_BETA + np.sqrt(n)) / _ALPHA + _L2)

    order = np.random.default_rng(0)
    for _ in range(_EPOCHS):
        for row in order.permutation(len(rows)):
            buckets, values = rows[row]
            z, n = sums[:, buckets], squares[:, buckets]
            w = weights(z, n)
            error = softmax(w @ values)
            error[labels[row]] -= 1
            gradient = np.outer(error, values)
            grown = n + gradient**2
            sums[:, buckets] = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / _ALPHA * w
            squares[:, buckets] = grown
    return weights(sums, squares)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature (rows of `logits` are classes) that gives `labels` the highest likelihood."""
    if not logits.size:
        return 1.0

    def loss(t: float) -> float:
        chances = softmax(logits / t)[labels, np.arange(len(labels))]
        return -float(np.log(np.maximum(chances, 1e-12)).mean())

    return min(np.geomspace(0.02, 50, 96).tolist(), key=loss)


def fit(rows: list[Sparse], names: list[str], df: np.ndarray, n_docs: int) -> LanguageModel:
    languages = sorted(set(names))
    number = {name: k for k, name in enumerate(languages)}
    labels = np.array([number[n] for n in names], np.int64)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    weighted = [tf_idf(buckets, counts, idf) for buckets, counts in rows]
    aside = np.arange(len(rows)) % _FOLD_ASIDE == 0
    learned = np.flatnonzero(~aside if (~aside).any() else aside)
    weights = train_ftrl(
        [weighted[i] for i in learned], labels[learned], len(languages), len(idf)
    )
    checked = np.flatnonzero(aside)
    logits = np.array([weights[:, weighted[i][0]] @ weighted[i][1] for i in checked]).T
    return LanguageModel(languages, idf, weights, fit_temperature(logits, labels[checked]))


def _frequency_batches(batches: Batches) -> Batches:
    """Document frequencies of the rows of one task."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts[bucket_counts(text, SIZES, BUCKETS)[0]] += 1
    buckets = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(counts[buckets])], names=["bucket", "df"]
    )


def _feature_batches(batches: Batches) -> Batches:
    for batch in batches:
        found = [bucket_counts(t, SIZES, BUCKETS) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("draw"),
                pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.int32())),
            ],
            names=["lang", "draw", "buckets", "counts"],
        )


def train(labelled: DataFrame, sample: int = SAMPLE_ROWS) -> LanguageModel:
    """A model of `labelled` (`text`, `lang`); rows with a null are left out. Document frequencies
    cover all rows. The weights are learned from about `sample` rows, at most 1.5 times as many,
    shared evenly among the languages; a language with fewer gives all. No rows give a model that
    knows no language. The model has one weight for each language and bucket."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    row = [c for c in ("doc_id", "text", "lang") if c in labelled.columns]
    known = known.select(*row)
    totals = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    if not totals:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), 1.0)
    frequencies = (
        map_batches(
            known.select("text"),
            _frequency_batches,
            [field("bucket", T.IntegerType()), field("df", T.LongType())],
        )
        .groupBy("bucket")
        .agg(F.sum("df").alias("df"))
        .toPandas()
    )
    df = np.zeros(BUCKETS)
    df[frequencies["bucket"].to_numpy(np.int64)] = frequencies["df"]
    each = sample / len(totals)
    wanted = F.create_map(
        *[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, 1.2 * each / n))]
    )
    # Rows are drawn, not texts: copies of one text don't come all together.
    drawn = known.withColumn("draw", share(3, *row)).where(
        F.col("draw") < wanted[F.col("lang")]
    )
    fields = [
        field("lang", T.StringType()),
        field("draw", T.DoubleType()),
        field("buckets", T.ArrayType(T.IntegerType())),
        field("counts", T.ArrayType(T.IntegerType())),
    ]
    rows = (
        map_batches(drawn, _feature_batches, fields)
        .orderBy("draw", "lang", "buckets", "counts")
        .limit(sample + sample // 2)
        .toPandas()
    )
    sparse = [
        (np.asarray(b, np.int64), np.asarray(c, np.float64))
        for b, c in zip(rows["buckets"], rows["counts"], strict=True)
    ]
    return fit(sparse, rows["lang"].tolist(), df, sum(totals.values()))


def _predict_batches(batches: Batches, model: LanguageModel) -> Batches:
    for batch in batches:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ],
            names=["doc_id", "lang_pred", "score"],
        )


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` for every row of `docs`, from the text alone. A null text or
    one without a letter is `und` with score 0, as is everything if no language was learned. Other
    columns are ignored."""
    fields = [
        docs.schema["doc_id"],
        field("lang_pred", T.StringType()),
        field("score", T.DoubleType()),
    ]
    return map_batches(docs.select("doc_id", "text"), _predict_batches, fields, model=model)
