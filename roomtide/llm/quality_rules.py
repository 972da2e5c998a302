"""Rule statistics of documents, and an isolation forest that judges them.

The statistics are counted in one pass over the whole texts. The forest is grown on a bounded
sample of their ratios: rows that random splits isolate early are anomalous. The score above which
a document goes is calibrated on all labelled rows, so that few good ones are lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, share, text_bytes
from roomtide.sources.scratch import stored

STATS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_capitals",
    "n_marks",
    "n_symbol_words",
    "n_letterless_words",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 8192
MAX_GOOD_LOSS = 0.005
_TREES, _ROWS_PER_TREE, _DEPTH = 128, 256, 8
_BINS = 4096
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = list(b"#*$%&|<>")
_MARKS = list(b"!?.,;:")
_WINDOW = 3
_LETTER, _SYMBOL, _OTHER = 1, 2, 4
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KINDS[_SYMBOLS] = _SYMBOL
_KINDS[list(_BLANKS)] = 0


def word_kinds(characters: np.ndarray) -> tuple[int, int]:
    """Words with a symbol, and words without a letter (bytes beyond ASCII count as letters)."""
    kinds = _KINDS[characters]
    inside = kinds > 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    words = np.bitwise_or.reduceat(kinds, starts) if len(starts) else kinds[:0]
    return int((words & _SYMBOL > 0).sum()), int((words & _LETTER == 0).sum())


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in windows that occur twice or more, and different words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(ids) < _WINDOW + 1:
        return 0, len(numbers)
    codes = ids[: 1 - _WINDOW]
    for at in range(1, _WINDOW):
        if codes.max() >= (1 << 62) // len(numbers):
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * len(numbers) + ids[at : len(ids) - _WINDOW + 1 + at]
    _, kinds, counts = np.unique(codes, return_inverse=True, return_counts=True)
    found = np.flatnonzero(counts[kinds] > 1)
    covered = np.zeros(len(ids), bool)
    for at in range(_WINDOW):
        covered[found + at] = True
    return int(covered.sum()), len(numbers)


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The counts named in STATS; a null text counts as an empty one."""
    text = text or b""
    words = text.split()
    characters = np.frombuffer(text, np.uint8)
    bytes_of = np.bincount(characters, minlength=256)
    blank = sum(bytes_of[list(_BLANKS)])
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    repeats, distinct = repeated_words(words)
    return (
        len(words),
        int(len(text) - bytes_of[0x80:0xC0].sum() - blank),
        int(bytes_of[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        distinct,
        int(bytes_of[0x41:0x5B].sum()),
        int(bytes_of[_MARKS].sum()),
        *word_kinds(characters),
    )


def _stat_batches(batches: Batches) -> Batches:
    for batch in batches:
        rows = np.array([text_stats(t) for t in text_bytes(batch)], np.int64)
        columns = [pa.array(c) for c in rows.reshape(-1, len(STATS)).T]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *columns],
            names=["doc_id", "text_hash", *STATS],
        )


def rule_stats(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_hash` (that of `identified`) and STATS for every row of `docs`; other columns
    are ignored."""
    fields = [
        docs.schema["doc_id"],
        field("text_hash", T.LongType()),
        *(field(name, T.LongType()) for name in STATS),
    ]
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    return map_batches(docs.select("doc_id", "text", text_hash), _stat_batches, fields)


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on, for rows of STATS."""
    counts = np.maximum(stats.astype(np.float64), 0).T
    words, chars, symbols, dup_lines, repeats, lines, distinct, capitals, marks = counts[:9]
    symbol_words, letterless_words = counts[9:]
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack(
        [
            np.log1p(words),
            chars / per_word,
            symbols / per_word,
            dup_lines / np.maximum(lines, 1),
            repeats / per_word,
            distinct / per_word,
            capitals / per_char,
            marks / per_word,
            np.log1p(words / np.maximum(lines, 1)),
            symbol_words / per_word,
            letterless_words / per_word,
        ],
        axis=1,
    )


def _mean_depth(rows: int) -> float:
    """Mean depth at which a random binary search tree of so many rows ends."""
    if rows < 2:
        return 0.0
    return 2 * (math.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows


@dataclass(frozen=True)
class Forest:
    """Trees as heaps: children of node k are 2k + 1 and 2k + 2; at the bottom, path lengths."""

    features: np.ndarray
    cuts: np.ndarray
    lengths: np.ndarray
    mean_length: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        """0 to 1: the earlier a row is isolated, the higher."""
        x = ratios(stats)
        if not len(self.features):
            return np.zeros(len(x))
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for features, cuts, lengths in zip(self.features, self.cuts, self.lengths, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(_DEPTH):
                node = 2 * node + 1 + (x[rows, features[node]] >= cuts[node])
            total += lengths[node - len(features)]
        return np.exp2(-total / len(self.features) / self.mean_length)


def grow_forest(stats: np.ndarray, seed: int = 0) -> Forest:
    """A forest of random splits; without two different rows it isolates nothing."""
    random, x = np.random.default_rng(seed), ratios(stats)
    inner = (1 << _DEPTH) - 1
    trees = _TREES if len(x) > 1 else 0
    features = np.zeros((trees, inner), np.int64)
    cuts = np.full((trees, inner), np.inf)
    lengths = np.zeros((trees, inner + 1))
    rows_per_tree = min(_ROWS_PER_TREE, len(x))

    def grow(tree: int, node: int, depth: int, rows: np.ndarray) -> None:
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (0, 0)
        wide = np.flatnonzero(high > low) if len(rows) > 1 else []
        if depth == _DEPTH or not len(wide):
            # Cuts of infinity lead to the leftmost leaf below.
            leaf = ((node + 1) << (_DEPTH - depth)) - 1 - inner
            lengths[tree, leaf] = depth + _mean_depth(len(rows))
            return
        features[tree, node] = f = random.choice(wide)
        cuts[tree, node] = cut = random.uniform(low[f], high[f])
        right = rows[:, f] >= cut
        grow(tree, 2 * node + 1, depth + 1, rows[~right])
        grow(tree, 2 * node + 2, depth + 1, rows[right])

    for tree in range(trees):
        grow(tree, 0, 0, x[random.choice(len(x), rows_per_tree, replace=False)])
    return Forest(features, cuts, lengths, _mean_depth(rows_per_tree) or 1.0)


def _score_batches(batches: Batches, forest: Forest) -> Batches:
    for batch in batches:
        stats = np.stack([batch.column(c).to_numpy() for c in STATS], axis=1)
        columns = [*batch.columns, pa.array(forest.score(stats))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "anomaly"])


def sample_rows(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most `rows` rows, the same ones every time. The share drawn is set a little high from the
    row count, so that only about `rows` rows are sorted."""
    draw = share(7, *key)
    wanted = min(1.0, 1.2 * rows / max(df.count(), 1))
    return df.where(draw <= wanted).orderBy(draw, *key).limit(rows)


def calibrated_threshold(scored: DataFrame, labels: DataFrame, max_good_loss: float) -> float:
    """The lowest score, in steps of a histogram over all labelled rows, at which documents may go:
    at most `max_good_loss` of the good ones reach it. Nothing goes if no good row is labelled."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    bins = (
        scored.join(known, "doc_id")
        .where("q = 1")
        .groupBy(F.floor(F.col("anomaly") * _BINS).alias("bin"))
        .count()
        .collect()
    )
    good = np.zeros(_BINS + 1)
    for row in bins:
        good[row["bin"]] = row["count"]
    if not good.sum():
        return math.inf
    lost = good[::-1].cumsum()[::-1]
    allowed = np.flatnonzero(lost <= max_good_loss * good.sum())
    return float(allowed[0] / _BINS) if len(allowed) else math.inf


def judge(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE_ROWS,
    max_good_loss: float = MAX_GOOD_LOSS,
) -> DataFrame:
    """STATS, `anomaly`, `base_failed` and `kept` with `doc_id` and `text_hash` of every row of `docs`.

    The base rules fail texts with few words or with too many words in repeated windows; null and
    empty texts have no words. The forest is grown on at most `sample` rows of `docs`, drawn by id and
    text, so only rows equal in both are drawn together; the score at
    which documents go is set on all labelled rows that pass the base rules, labels without document
    and null labels aside; if a document has several quality labels the largest counts. Repeated
    rows are judged alike, rows without id get no label. An empty table gives no rows."""
    stats = stored(rule_stats(docs), "rule-stats")
    # Rows are drawn, not texts: copies of one text don't come all together.
    row = ("doc_id", "text_hash", *STATS)
    drawn = sample_rows(stats.select(*row), sample, *row).select(*STATS).toPandas()
    forest = grow_forest(drawn.to_numpy(np.int64).reshape(-1, len(STATS)))
    fields = [*stats.schema.fields, field("anomaly", T.DoubleType())]
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    scored = map_batches(stats, _score_batches, fields, forest=forest).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | repeated
    )
    scored = stored(scored, "anomalies")
    passed = scored.where(~F.col("base_failed"))
    threshold = calibrated_threshold(passed, labels.select("doc_id", "quality"), max_good_loss)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
