"""Toxic texts by a linear classifier on character n-grams scaled by naive Bayes.

The feature of a hashed n-gram is the logarithm of how much likelier it is in a toxic than in a
clean text, if the text has it. These ratios count all labelled rows. N-grams that say little
either way are left out, and a logistic regression on a bounded sample weighs the others.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, share
from roomtide.llm.ngrams import pieces
from roomtide.sources.scratch import stored

SIZES = (4, 6, 8)
BUCKETS = 1 << 20
#: N-grams in use are in so many labelled texts and so much likelier in one class, as a logarithm.
MIN_DOCUMENTS = 6
MIN_RATIO = 2.0
SAMPLE_ROWS = 8192
THRESHOLD = 0.3
_BLOCK = 1 << 12
_STEPS, _RATE, _L2 = 100, 0.1, 1e-4


def buckets_of(text: str) -> np.ndarray:
    """The buckets the n-grams of a whole text fall in, ascending. A text too short for the longest
    n-grams has those that fit."""
    parts = [np.unique(buckets) for buckets in pieces(text, SIZES, BUCKETS)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass(frozen=True)
class ToxicityModel:
    """`kept` are the buckets in use, `ratios` their log-count ratios, `weights` what they count."""

    kept: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """Score of a text. The table of all buckets is made once for each task."""
        table = np.zeros(BUCKETS, np.float32)
        table[self.kept] = self.ratios * self.weights

        def score(text: str | None) -> float:
            total = self.bias
            found = [b[table[b] != 0] for b in pieces(text or "", SIZES, BUCKETS)]
            total += float(table[np.unique(np.concatenate(found))].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-min(max(total, -500.0), 500.0))))

        return score


def log_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    return np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))


def fit_logistic(
    rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, ratios: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights and bias of a regression on rows of feature numbers, by gradient steps scaled for
    each coordinate. `importance` undoes the unequal sampling of the classes."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    value, share_of = ratios[feature], importance / importance.sum()
    weights, scale = np.zeros(len(ratios)), np.full(len(ratios), 1e-8)
    base = float((share_of * labels).sum())
    bias, bias_scale = float(np.log(base / (1 - base))), 1e-8
    for _ in range(_STEPS):
        logits = np.bincount(row, value * weights[feature], minlength=len(rows)) + bias
        error = share_of * (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - labels)
        gradient = np.bincount(feature, value * error[row], minlength=len(ratios)) + _L2 * weights
        scale += gradient**2
        bias_scale += error.sum() ** 2
        weights -= _RATE * gradient / np.sqrt(scale)
        bias -= _RATE * error.sum() / np.sqrt(bias_scale)
    return weights, bias


def _count_batches(batches: Batches) -> Batches:
    """In how many clean and toxic rows of one task each bucket is, as compressed blocks."""
    counts = np.zeros((BUCKETS // _BLOCK, 2, _BLOCK), np.int32)
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for text, label in zip(batch.column("text").to_pylist(), labels, strict=True):
            buckets = buckets_of(text or "")
            counts[buckets // _BLOCK, label, buckets % _BLOCK] += 1
    blocks = np.flatnonzero(counts.any(axis=(1, 2)))
    packed = [zlib.compress(counts[block].tobytes(), 1) for block in blocks]
    yield pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"]
    )


def _telling_batches(
    batches: Batches, n_clean: int, n_toxic: int, min_documents: int, min_ratio: float
) -> Batches:
    """Sums the blocks that were dealt to one task, and gives the buckets that tell something. It
    holds the sums of its blocks, at most one number for each bucket and class."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        packed = batch.column("counts").to_pylist()
        for block, counts in zip(batch.column("block").to_pylist(), packed, strict=True):
            part = np.frombuffer(zlib.decompress(counts), np.int32).reshape(2, _BLOCK)
            sums[block] = sums.get(block, 0) + part.astype(np.int64)
    for block, (clean, toxic) in sorted(sums.items()):
        ratios = log_ratios(toxic, clean, n_toxic, n_clean)
        kept = np.flatnonzero((clean + toxic >= min_documents) & (np.abs(ratios) >= min_ratio))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block * _BLOCK + kept, pa.int32()), pa.array(ratios[kept])],
            names=["bucket", "ratio"],
        )


def _kept_batches(batches: Batches, kept: np.ndarray) -> Batches:
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [number[buckets_of(t or "")] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("label"),
                pa.array([f[f >= 0] for f in found], pa.list_(pa.int32())),
            ],
            names=["doc_id", "label", "features"],
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE_ROWS,
    min_documents: int = MIN_DOCUMENTS,
    min_ratio: float = MIN_RATIO,
) -> ToxicityModel | None:
    """A model of the rows of `docs` that `labels` (`doc_id`, `toxic`) marks; null labels are left
    out, and if a document has several the largest counts. The texts of `docs` are shuffled to meet
    their labels, so give only rows that may be learned from; of several texts of
    one id all count, and that with the smallest features is drawn. Ratios count all marked rows; the
    regression takes about `sample` rows, at most 1.5 times as many, half of them toxic if there
    are so many. None if there is no toxic or no clean row."""
    known = (
        labels.where("toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    present = stored(
        known.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labels"
    )
    totals = {row["label"]: row["count"] for row in present.groupBy("label").count().collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        return None
    # Labels grow with the documents: one plan at every size, which sorts no texts.
    dealt = present.hint("shuffle_hash")
    labelled = docs.select("doc_id", "text").join(dealt, "doc_id").select("text", "label")
    blocks = map_batches(
        labelled,
        _count_batches,
        [field("block", T.IntegerType()), field("counts", T.BinaryType())],
    )
    telling = (
        map_batches(
            blocks.repartition("block"),
            _telling_batches,
            [field("bucket", T.IntegerType()), field("ratio", T.DoubleType())],
            n_clean=n_clean,
            n_toxic=n_toxic,
            min_documents=min_documents,
            min_ratio=min_ratio,
        )
        .toPandas()
        .sort_values("bucket")
    )
    kept, ratios = telling["bucket"].to_numpy(np.int64), telling["ratio"].to_numpy(float)
    draw = share(5, "doc_id")
    wanted = F.when(F.col("label") == 1, min(1.0, 0.6 * sample / n_toxic)).otherwise(
        min(1.0, 0.6 * sample / n_clean)
    )
    chosen = stored(
        present.where(draw < wanted).orderBy(draw, "doc_id").limit(sample + sample // 2), "chosen"
    )
    fields = [
        docs.schema["doc_id"],
        field("label", T.IntegerType()),
        field("features", T.ArrayType(T.IntegerType())),
    ]
    rows = (
        map_batches(
            docs.select("doc_id", "text").join(chosen, "doc_id"), _kept_batches, fields, kept=kept
        )
        .groupBy("doc_id")
        .agg(F.min(F.struct("features", "label")).alias("first"))
        .select("doc_id", "first.*")
        .orderBy("doc_id")
        .toPandas()
    )
    drawn = rows["label"].to_numpy(np.int64)
    sampled = np.bincount(drawn, minlength=2)
    if not sampled.all():
        return None
    importance = np.array([n_clean, n_toxic])[drawn] / sampled[drawn]
    features = [np.asarray(f, np.int64) for f in rows["features"]]
    weights, bias = fit_logistic(features, drawn, importance, ratios)
    return ToxicityModel(kept, ratios, weights, bias)


def _score_batches(batches: Batches, model: ToxicityModel | None) -> Batches:
    score = model.scorer() if model else lambda _: 0.0
    for batch in batches:
        scores = [score(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
        )


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """`doc_id`, `score` (0 to 1) for every row of `docs`, from the whole text alone. Null and empty
    texts get the score of a text without telling n-grams; without a model every score is 0.
    Repeated rows score alike; other columns are ignored."""
    fields = [docs.schema["doc_id"], field("score", T.DoubleType())]
    return map_batches(docs.select("doc_id", "text"), _score_batches, fields, model=model)
