"""Quality by the votes of the nearest labelled documents in a latent semantic space.

Terms are the words (A-Z lower-cased, hashed), which say what a text is about, and the shapes of words
and their neighbours (capitals, letters, digits and symbols, runs shortened), which say how it is
written in any language; both have a fixed share of a text's length. Document frequencies come from
all documents; the latent space is the singular vectors of a bounded sample of labelled documents,
which are also the voters. Every document is compared with every voter by blocked matrix products.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, share, small_batches, text_bytes
from roomtide.sources.scratch import stored

SHAPES, WORDS = 1 << 12, 1 << 14
TERMS = SHAPES + WORDS
WORD_SHARE = 0.5
DIMENSIONS = 64
VOTERS = 4096
NEIGHBOURS = 25
FOLDS = 5
THRESHOLD = 0.3
_SHARPNESS = 8
_SPARE_DIRECTIONS, _ROUNDS = 16, 6
_BLOCK = 256
_BATCH = 2 << 20
_PIECE = 1 << 20
_WORD_END = re.compile(rb"(?<=[^ \t\n\x0b\x0c\r])[ \t\n\x0b\x0c\r]")

_CLASS = bytes(
    ord("X") if 0x41 <= b <= 0x5A
    else ord("x") if 0x61 <= b <= 0x7A or b >= 0x80
    else ord("9") if 0x30 <= b <= 0x39
    else ord(" ") if b in b" \t\x0b\x0c\r"
    else b
    for b in range(256)
)


@lru_cache(maxsize=1 << 16)
def _term(*shape: bytes) -> int:
    return crc32(b" ".join(shape)) % SHAPES


def _shapes(piece: bytes) -> list[bytes]:
    """The shapes of words, and line breaks, in order."""
    shape = np.frombuffer(piece.translate(_CLASS), np.uint8)
    changes = np.ones(len(shape), bool)
    changes[1:] = shape[1:] != shape[:-1]
    return [s for s in shape[changes].tobytes().replace(b"\n", b" \n ").split(b" ") if s]


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in pieces of bounded size where a word ends."""
    at = 0
    while at < len(text):
        found = _WORD_END.search(text, at + _PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def term_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a whole text, ascending (shapes first, then words), and how often each occurs."""
    shape_counts, word_counts, n_words = Counter(), Counter(), 0
    last_word, last_shape = [], []
    for piece in _cuts(text or b""):
        words, shapes = last_word + piece.split(), last_shape + _shapes(piece)
        shape_counts[b"same",] += sum(map(eq, words, words[1:]))
        n_words += len(words) - len(last_word)
        word_counts.update(words[len(last_word) :])
        shape_counts.update(zip(shapes[len(last_shape) :], strict=True))
        shape_counts.update(zip(shapes, shapes[1:], strict=False))
        last_word, last_shape = words[-1:], shapes[-1:]
    shape_counts[b"other",] += n_words - len(word_counts)
    counts = np.zeros(TERMS)
    for shape, n in shape_counts.items():
        counts[_term(*shape)] += n
    for word, n in word_counts.items():
        counts[SHAPES + crc32(word.lower()) % WORDS] += n
    terms = np.flatnonzero(counts)
    return terms, counts[terms]


@dataclass(frozen=True)
class Voters:
    """Labelled vectors of unit length in the latent space, and how to get there."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = _weighted(terms, counts, self.weights)
        vector = values @ self.projection[terms]
        return vector / (np.linalg.norm(vector) or 1.0)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """The share of good neighbours, each weighted by a power of its similarity."""
        n = min(NEIGHBOURS, len(self.labels))
        if not n:
            return np.full(len(vectors), self.prior)
        scores = []
        for at in range(0, len(vectors), _BLOCK):
            similar = vectors[at : at + _BLOCK] @ self.vectors.T
            nearest = np.argpartition(-similar, n - 1, axis=1)[:, :n]
            votes = np.maximum(np.take_along_axis(similar, nearest, axis=1), 0) ** _SHARPNESS
            total = votes.sum(axis=1)
            good = (votes * self.labels[nearest]).sum(axis=1)
            scores.append(np.where(total > 0, good / np.maximum(total, 1e-300), self.prior))
        return np.clip(np.concatenate(scores) if scores else np.zeros(0), 0.0, 1.0)


def _weighted(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """TF-IDF; shapes and words each get their share of the vector, however many there are."""
    values = (1 + np.log(counts)) * weights[terms]
    words = np.searchsorted(terms, SHAPES)
    for part, share_of in ((values[:words], 1 - WORD_SHARE), (values[words:], WORD_SHARE)):
        part *= np.sqrt(share_of) / (np.linalg.norm(part) or 1.0)
    return values


def singular_directions(rows: list[tuple[np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
    """The first right singular vectors of a sparse matrix (terms and values of each row), by
    subspace iteration from fixed random directions; the matrix is never made dense. Fewer if
    there are fewer rows or terms."""
    wide = min(dimensions + _SPARE_DIRECTIONS, len(rows), TERMS)
    basis = np.random.default_rng(0).standard_normal((TERMS, wide))
    for _ in range(_ROUNDS):
        turned = np.zeros_like(basis)
        for terms, values in rows:
            turned[terms] += values[:, None] * (values @ basis[terms])
        basis = np.linalg.qr(turned)[0]
    images = np.array([values @ basis[terms] for terms, values in rows]).reshape(len(rows), wide)
    _, lengths, turn = np.linalg.svd(images, full_matrices=False)
    found = min(dimensions, int((lengths > 1e-9 * lengths.max(initial=0)).sum()))
    return basis @ turn[:found].T


def fit_voters(
    sample: list[tuple[np.ndarray, np.ndarray, int]], df: np.ndarray, n_docs: int
) -> Voters:
    """The latent space of a labelled sample (terms, counts, label)."""
    weights = np.log((1 + n_docs) / (1 + df)) + 1
    labels = np.array([label for _, _, label in sample], np.float64)
    rows = [(terms, _weighted(terms, counts, weights)) for terms, counts, _ in sample]
    projection = singular_directions(rows, DIMENSIONS)
    vectors = np.array([values @ projection[terms] for terms, values in rows])
    vectors = vectors.reshape(len(rows), projection.shape[1])
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(lengths > 0, lengths, 1)
    return Voters(weights, projection, vectors, labels, float(labels.mean()) if len(labels) else 0.5)


def _term_batches(batches: Batches) -> Batches:
    for batch in small_batches(batches, _BATCH):
        found = [term_counts(t) for t in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())),
            ],
            names=["doc_id", "terms", "counts"],
        )


def surface_terms(docs: DataFrame) -> DataFrame:
    """`doc_id`, `terms`, `counts` of every row; null and empty texts have none."""
    fields = [
        docs.schema["doc_id"],
        field("terms", T.ArrayType(T.IntegerType())),
        field("counts", T.ArrayType(T.IntegerType())),
    ]
    return map_batches(docs.select("doc_id", "text"), _term_batches, fields)


def _score_batches(batches: Batches, voters: Voters) -> Batches:
    for batch in small_batches(batches, _BATCH):
        found = zip(batch.column("terms"), batch.column("counts"), strict=True)
        vectors = [
            voters.latent(t.values.to_numpy(), c.values.to_numpy(zero_copy_only=False))
            for t, c in found
        ]
        stacked = np.array(vectors).reshape(len(vectors), voters.projection.shape[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(voters.score(stacked))], names=["doc_id", "score"]
        )


def quality_scores(docs: DataFrame, labels: DataFrame, voters: int = VOTERS) -> DataFrame:
    """`doc_id`, `score` for every row of `docs`.

    `labels` (`doc_id`, `quality`) holds the rows that may be learned from; null labels are left
    out, and if a document has several the largest counts. At most `voters` labelled rows of `docs`
    vote, the same ones every time (of several texts of one id, that with the smallest terms); document
    frequencies cover all rows. A document without terms, or like no voter, gets the share of good voters; without voters every score is 0.5. Repeated
    rows score alike; other columns are ignored; no rows give no rows."""
    terms = stored(surface_terms(docs), "surface-terms")
    df = terms.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
    frequencies = np.zeros(TERMS)
    frequencies[df["term"].to_numpy(np.int64)] = df["count"]
    known = (
        labels.where("quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
    )
    labelled = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    draw = share(11, "doc_id")
    wanted = min(1.0, 1.2 * voters / max(labelled.count(), 1))
    chosen = stored(labelled.where(draw <= wanted).orderBy(draw, "doc_id").limit(voters), "voters")
    sample = (
        terms.join(chosen, "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("terms", "counts", "label")).alias("first"))
        .orderBy("doc_id")
        .select("first.*")
        .toPandas()
    )
    rows = [
        (np.asarray(t, np.int64), np.asarray(c), int(label))
        for t, c, label in sample.itertuples(index=False)
    ]
    model = fit_voters(rows, frequencies, terms.count())
    fields = [docs.schema["doc_id"], field("score", T.DoubleType())]
    return map_batches(terms, _score_batches, fields, voters=model)
