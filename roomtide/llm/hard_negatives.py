"""Hard negatives for contrastive training, by threshold joins over an inverted index.

An anchor's positives are its best rows of the same label. For each of them, hard negatives are the
best rows of other labels whose score lies in a window below the positive's. Both are searches for
the best rows in score windows, done by the L2AP bounds: rows are indexed by dimension, but the
trailing dimensions of a row stay out of the index as long as their norm alone can't lift a score to
the threshold; scores are accumulated over the index, candidates are dropped when what they have and
the norms of what remains can't reach the threshold, and thresholds are lowered until every window
is full or its lower end is reached. Scores are exact integers.

Rows and anchors are packed into blocks of bounded size, and blocks of anchors meet blocks of rows
in a join on grid cells, so that a task holds one pair of blocks at a time. Only the best rows of a
window leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches
from roomtide.sources.scratch import stored

POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in percent of the positive's.
LOW, HIGH = 50, 95
ROWS_PER_BLOCK, ANCHORS_PER_BLOCK = 2048, 256
_VALUES_PER_BLOCK = 1 << 18
#: A cell of the grid has so many blocks of rows and of anchors.
_CELL_ROWS, _CELL_ANCHORS = 2, 16
#: A task packs so many blocks of rows.
_BLOCKS_PER_TASK = 8
_CHUNK = 8
_SHARES = (0.6, 0.3, 0.0)
_EXACT = 2.0**53
_LARGEST = 2.0**62


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """`vec_id`, `label`, `vector`: components times `scale`, rounded down. Rows without id, label or
    vector, and those with a component that is null, not finite or beyond a bigint, are left out."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * float(scale))
    usable = F.forall("scaled", lambda x: x.isNotNull() & (F.abs(x) < _LARGEST))
    return (
        rows.select("vec_id", "label", scaled.alias("scaled"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
        .select("vec_id", "label", F.transform("scaled", lambda x: F.floor(x)).alias("vector"))
    )


@dataclass(frozen=True)
class Block:
    """Rows with their ids and labels; vectors of unequal length are filled up with zeros."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def unpacked(cls, row: dict, prefix: str = "") -> Block:
        ids, labels, vectors, kind = (row[prefix + c] for c in ("ids", "labels", "vectors", "kind"))
        ids = np.frombuffer(ids, np.int64)
        vectors = np.frombuffer(vectors, kind).reshape(len(ids), -1)
        return cls(ids, np.frombuffer(labels, np.int64), vectors)


def _pack_batches(batches: Batches, most_rows: int) -> Batches:
    """Blocks of at most `most_rows` rows, fewer if vectors are long."""
    held: list[tuple[int, int, np.ndarray]] = []
    longest = 0

    def packed() -> pa.RecordBatch:
        ids, labels = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
        vectors = np.zeros((len(held), longest), np.int64)
        for at, (_, _, vector) in enumerate(held):
            vectors[at, : len(vector)] = vector
        top = int(np.abs(vectors).max(initial=0))
        kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
        return pa.RecordBatch.from_pydict(
            {
                "kind": [kind],
                "ids": [ids.tobytes()],
                "labels": [labels.tobytes()],
                "vectors": [vectors.astype(kind).tobytes()],
                "first_label": [int(labels.min())],
                "last_label": [int(labels.max())],
            }
        )

    for batch in batches:
        ids, labels = (batch.column(c).to_pylist() for c in ("vec_id", "label"))
        for ident, label, vector in zip(ids, labels, batch.column("vector"), strict=True):
            vector = vector.values.to_numpy()
            widest = max(longest, len(vector))
            if held and (len(held) == most_rows or (len(held) + 1) * widest > _VALUES_PER_BLOCK):
                yield packed()
                held, widest = [], len(vector)
            longest = widest
            held.append((ident, label, vector))
    if held:
        yield packed()


def _blocks(rows: DataFrame, n_rows: int, most_rows: int) -> DataFrame:
    """The rows in blocks sorted by label, each with a number of its own in `block`."""
    binary, bigint = T.BinaryType(), T.LongType()
    fields = [
        field("kind", T.StringType()),
        field("ids", binary),
        field("labels", binary),
        field("vectors", binary),
        field("first_label", bigint),
        field("last_label", bigint),
    ]
    narrow = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        "vector",
    )
    # Labels are cut anywhere, so that one label may hold most rows.
    order = [F.col("label"), F.col("vec_id"), F.xxhash64("vector")]
    tasks = -(-max(n_rows, 1) // (most_rows * _BLOCKS_PER_TASK))
    dealt = narrow.repartitionByRange(tasks, *order).sortWithinPartitions(*order).coalesce(tasks)
    packed = map_batches(dealt, _pack_batches, fields, most_rows=most_rows)
    return packed.withColumn("block", F.monotonically_increasing_id())


class Windows:
    """The best rows found so far in each score window of each anchor, at most `size` of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int):
        self.low, self.high, self.size = low, high, size
        #: What a row must score to get into a window.
        self.needed = low.astype(float)
        none = np.zeros(0, np.int64)
        self.anchor, self.window, self.score, self.id = none, none, none, none

    def floors(self) -> np.ndarray:
        """The score below which nothing gets into any window of an anchor."""
        return np.where(self.low > self.high, np.inf, self.needed).min(axis=1, initial=np.inf)

    def tops(self) -> np.ndarray:
        return np.where(self.low > self.high, -np.inf, self.high).max(axis=1, initial=-np.inf)

    def add(self, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        fits = (score[:, None] >= self.needed[anchor]) & (score[:, None] <= self.high[anchor])
        row, window = np.nonzero(fits)
        if not len(row):
            return
        anchors = np.concatenate((self.anchor, anchor[row]))
        windows = np.concatenate((self.window, window))
        scores = np.concatenate((self.score, score[row]))
        ids = np.concatenate((self.id, ident[row]))
        order = np.lexsort((ids, -scores, windows, anchors))
        group = (anchors * self.low.shape[1] + windows)[order]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        kept = order[place < self.size]
        self.anchor, self.window, self.score, self.id = (
            column[kept] for column in (anchors, windows, scores, ids)
        )
        last = order[place == self.size - 1]
        self.needed[anchors[last], windows[last]] = scores[last]


class Postings:
    """An inverted index of a block of rows, probed by a block of anchors.

    Dimensions come in chunks, those with most energy first. `depth` says for each row how many
    chunks are indexed; the norm of the others is below what the threshold needs."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        # What one side lacks counts as zero.
        width = min(anchors.shape[1], rows.shape[1])
        anchors, rows = anchors[:, :width], rows[:, :width]
        energy = (rows.astype(float) ** 2).sum(axis=0)
        order = np.argsort(-energy, kind="stable")
        self.anchors, self.rows = anchors[:, order], rows[:, order]
        self.q, self.x = self.anchors.astype(float), self.rows.astype(float)
        self.chunks = [slice(at, at + _CHUNK) for at in range(0, width, _CHUNK)]
        self.q_rest, self.x_rest = self._rests(self.q), self._rests(self.x)
        self.partial = np.zeros((len(anchors), len(rows)))
        self.depth = np.zeros(len(rows), np.int64)
        self.exact = self.q_rest[:, 0].max(initial=0) * self.x_rest[:, 0].max(initial=0) < _EXACT

    def _rests(self, vectors: np.ndarray) -> np.ndarray:
        """The norm of each vector from each chunk on, ending with 0."""
        squares = [(vectors[:, c] ** 2).sum(axis=1) for c in self.chunks]
        padded = np.array([*squares, np.zeros(len(vectors))])
        return np.sqrt(padded[::-1].cumsum(axis=0)[::-1]).T

    def reach(self) -> np.ndarray:
        """The highest score an anchor can have with any row."""
        return self.q_rest[:, 0] * self.x_rest[:, 0].max(initial=0)

    def _index(self, threshold: np.ndarray) -> None:
        """Accumulate the chunks that the lowered thresholds bring into the index."""
        norms = self.q_rest[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(norms > 0, threshold / norms, np.where(threshold > 0, np.inf, -np.inf))
        depth = np.minimum((self.x_rest >= needed.min(initial=np.inf)).sum(axis=1), len(self.chunks))
        for k, chunk in enumerate(self.chunks):
            listed = np.flatnonzero((self.depth <= k) & (k < depth))
            if len(listed):
                self.partial[:, listed] += self.q[:, chunk] @ self.x[listed, chunk].T
        self.depth = np.maximum(self.depth, depth)

    def probe(
        self, threshold: np.ndarray, undone: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of all undone pairs that score at least the anchor's threshold, and
        perhaps of others."""
        slack = 1e-9 * self.reach() + 1e-6
        needed = np.where(np.isinf(threshold), threshold, threshold - slack)
        self._index(needed)
        rest = np.take_along_axis(self.x_rest, self.depth[:, None], axis=1)[:, 0]
        bound = self.partial + self.q_rest[:, self.depth] * rest
        i, j = np.nonzero((bound >= needed[:, None]) & undone)
        score = self.partial[i, j]
        for k, chunk in enumerate(self.chunks):
            more = self.depth[j] <= k
            if not more.any():
                continue
            a, b = i[more], j[more]
            score[more] += np.einsum("ij,ij->i", self.q[a, chunk], self.x[b, chunk])
            alive = score + self.q_rest[i, k + 1] * self.x_rest[j, k + 1] >= needed[i]
            alive |= ~more
            i, j, score = i[alive], j[alive], score[alive]
        if not self.exact:
            products = self.anchors[i].astype(object) * self.rows[j].astype(object)
            return i, j, products.sum(axis=1).astype(np.int64)
        return i, j, np.rint(score).astype(np.int64)


def search(anchors: Block, rows: Block, wanted: np.ndarray, windows: Windows) -> None:
    """Add the best of the wanted pairs to the windows, lowering thresholds until they are full."""
    index = Postings(anchors.vectors, rows.vectors)
    reach, floor = index.reach(), windows.floors()
    top = np.minimum(windows.tops(), reach)
    floor = np.maximum(floor, -reach - 1)
    undone = wanted.copy()
    open_ = floor <= top
    for share in _SHARES:
        if not open_.any():
            return
        low = np.where(open_, floor, 0.0)
        threshold = np.where(open_, low + share * (np.where(open_, top, 0.0) - low), np.inf)
        i, j, score = index.probe(threshold, undone)
        undone[i, j] = False
        windows.add(i, score, rows.ids[j])
        # Rows left out score less than the threshold; full windows need at least as much.
        open_ &= windows.floors() < threshold


def _pair_batches(batches: Batches, size: int, same_label: bool) -> Batches:
    """The best rows in the windows of every anchor, over the pairs of blocks of one task."""
    found: dict[int, Windows] = {}
    for batch in batches:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            anchors, rows = Block.unpacked(row, "a_"), Block.unpacked(row)
            windows = found.get(row["a_block"])
            if windows is None:
                shape = (len(anchors.ids), row["n_windows"])
                low, high = (
                    np.frombuffer(row[c], np.int64).reshape(shape) for c in ("low", "high")
                )
                windows = found[row["a_block"]] = Windows(low, high, size)
            wanted = anchors.labels[:, None] == rows.labels
            if same_label:
                wanted &= anchors.ids[:, None] != rows.ids
            else:
                wanted = ~wanted
            search(anchors, rows, wanted, windows)
    for block, best in found.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(best.id), block), pa.int64()),
                *(pa.array(c, pa.int64()) for c in (best.anchor, best.window, best.score, best.id)),
            ],
            names=["a_block", "anchor", "window", "score", "vec_id"],
        )


def _best(
    anchors: DataFrame, rows: DataFrame, size: int, same_label: bool, shape: tuple[int, int]
) -> DataFrame:
    """`a_block`, `anchor`, `window`, `place`, `score`, `vec_id`: the best rows of each window.

    `shape` is the number of blocks of anchors and of rows. Cells of the grid hold a few blocks of
    each; anchors and rows are sent once to every cell in their line and column."""
    columns = -(-max(shape[1], 1) // _CELL_ROWS)
    lines = -(-max(shape[0], 1) // _CELL_ANCHORS)
    tasks = min(lines * columns, 20_000)

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def dealt(n: int, name: str, block: str) -> Column:
        return F.pmod(F.xxhash64(block), F.lit(n)).cast("int").alias(name)

    asked = anchors.select(
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in ("low", "high", "n_windows")],
        "low",
        "high",
        "n_windows",
        dealt(lines, "line", "block"),
        every(columns, "column"),
    ).repartition(tasks, "line", "column")
    held = rows.select("*", dealt(columns, "column", "block"), every(lines, "line")).repartition(
        tasks, "line", "column"
    )
    one_label = (F.col("first_label") == F.col("last_label")) & (
        F.col("a_first_label") == F.col("a_last_label")
    )
    if same_label:
        meets = (F.col("first_label") <= F.col("a_last_label")) & (
            F.col("last_label") >= F.col("a_first_label")
        )
    else:
        meets = ~(one_label & (F.col("first_label") == F.col("a_first_label")))
    pairs = asked.join(held.hint("shuffle_merge"), ["line", "column"]).where(meets)
    names = ["a_block", "anchor", "window", "score", "vec_id"]
    found = map_batches(
        pairs,
        _pair_batches,
        [field(name, T.LongType()) for name in names],
        size=size,
        same_label=same_label,
    )
    order = Window.partitionBy("a_block", "anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


_WINDOW_FIELDS = [
    field("low", T.BinaryType()),
    field("high", T.BinaryType()),
    field("n_windows", T.IntegerType()),
]


def _with_windows(row: pa.RecordBatch, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    extra = [[low.tobytes()], [high.tobytes()], pa.array([low.shape[1]], pa.int32())]
    names = [*row.schema.names, "low", "high", "n_windows"]
    return pa.RecordBatch.from_arrays(
        [*row.columns, *(e if isinstance(e, pa.Array) else pa.array(e, pa.binary()) for e in extra)],
        names=names,
    )


def _open_windows(batches: Batches) -> Batches:
    """One window for each anchor, without bounds."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            n = len(row.column("ids")[0].as_py()) // 8
            bounds = np.iinfo(np.int64)
            yield _with_windows(row, np.full((n, 1), bounds.min), np.full((n, 1), bounds.max))


def _score_windows(batches: Batches, positives: int, low: int, high: int) -> Batches:
    """A window for each positive of each anchor; those an anchor lacks are empty."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            n = len(row.column("ids")[0].as_py()) // 8
            lows, highs = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)
            for p in row.column("near")[0].as_py():
                lows[p["anchor"], p["place"] - 1] = -(-low * p["score"] // 100)
                highs[p["anchor"], p["place"] - 1] = high * p["score"] // 100
            yield _with_windows(row.select([c for c in row.schema.names if c != "near"]), lows, highs)


def _anchor_ids(batches: Batches) -> Batches:
    for batch in batches:
        for block, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "ids")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), block), pa.int64()),
                    pa.array(np.arange(len(ids)), pa.int64()),
                    pa.array(ids, pa.int64()),
                ],
                names=["a_block", "anchor", "anchor_id"],
            )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `vectors` has `vec_id`, `label` (whole numbers) and `vector` (of bigints, no nulls in it). A score
    is the inner product, dimensions that one side lacks counting as zero; higher ones come first,
    ties by smaller id. Every anchor has its first `positives` rows of the same label and another
    id, and for each of them the first `negatives` rows of other labels whose score lies between
    `low` and `high` percent of the positive's. Rows without id, label or vector take no part; exact
    repeats count once, different rows of one id each for itself. Anchors and positives without a
    negative, and empty tables, give no rows; a score beyond a bigint is an error. Other columns are
    ignored."""
    narrow = vectors.select("vec_id", "label", "vector").dropna().distinct()
    kept = stored(narrow, "vectors")
    chosen = kept.where(is_anchor)
    rows = stored(_blocks(kept, kept.count(), ROWS_PER_BLOCK), "row-blocks")
    anchors = stored(_blocks(chosen, chosen.count(), ANCHORS_PER_BLOCK), "anchor-blocks")
    shape = anchors.count(), rows.count()
    everything = map_batches(anchors, _open_windows, [*anchors.schema.fields, *_WINDOW_FIELDS])
    near = stored(_best(everything, rows, positives, True, shape), "positives")
    listed = near.groupBy("a_block").agg(
        F.collect_list(F.struct("anchor", "place", "score")).alias("near")
    )
    asked = map_batches(
        anchors.join(listed, anchors["block"] == listed["a_block"]).drop("a_block"),
        _score_windows,
        [*anchors.schema.fields, *_WINDOW_FIELDS],
        positives=positives,
        low=low,
        high=high,
    )
    hard = _best(asked, rows, negatives, False, shape).select(
        "a_block",
        "anchor",
        (F.col("window") + 1).cast("int").alias("near_place"),
        F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    ids = map_batches(
        anchors.select("block", "ids"),
        _anchor_ids,
        [field(c, T.LongType()) for c in ("a_block", "anchor", "anchor_id")],
    )
    named = near.join(ids, ["a_block", "anchor"]).select(
        "a_block",
        "anchor",
        F.col("place").alias("near_place"),
        "anchor_id",
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return named.join(hard, ["a_block", "anchor", "near_place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
