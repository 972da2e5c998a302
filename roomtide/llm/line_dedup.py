"""Lines that many documents share are dropped from all but one of them.

Every document names the keys of its long lines once, with their positions. The rows are dealt in
ranges of (key, document) and sorted, largest document first, and each task streams through its
range: the first occurrence stays, the others go once enough documents have named the key. Ranges
cut through a key that very many documents share, so no key has to fit in a task; the runs at the
ends of a task are settled together with those of its neighbours, from one summary row each.
What comes back is a compressed bitmap of the lines to keep, not text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, identified, map_batches, text_bytes
from roomtide.sources.scratch import stored

MIN_CHARS = 40
MIN_DOCUMENTS = 5
_BLANKS = b" \t\n\x0b\x0c\r"
_TEXT_SEED = 42
_MOST_WAITING = 4096


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANKS).lower()


def _is_long(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars or key.isascii():
        return len(key) >= min_chars
    return sum(b & 0xC0 != 0x80 for b in key) >= min_chars


def _key_batches(batches: Batches, min_chars: int) -> Batches:
    """One row for each document and long key: hash, document, text hash, positions, line count."""
    for batch in batches:
        digests, rows, positions, texts, counts = [], [], [], [], []
        for row, text in enumerate(text_bytes(batch)):
            lines = text.split(b"\n") if text else []
            at: dict[bytes, list[int]] = {}
            for position, line in enumerate(lines):
                key = line_key(line)
                if _is_long(key, min_chars):
                    at.setdefault(xxhash.xxh3_128_digest(key), []).append(position)
            if at:
                digests += at.keys()
                positions += at.values()
                rows += [row] * len(at)
                texts += [xxhash.xxh64_intdigest(text, _TEXT_SEED)] * len(at)
                counts += [len(lines)] * len(at)
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(halves[:, 0]),
                pa.array(halves[:, 1]),
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(np.array(texts, np.uint64).view(np.int64)),
                pa.array(positions, pa.list_(pa.int32())),
                pa.array(counts, pa.int32()),
            ],
            names=["h1", "h2", "doc_id", "text_hash", "positions", "n_lines"],
        )


def _line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    fields = [
        field("h1", T.LongType()),
        field("h2", T.LongType()),
        docs.schema["doc_id"],
        field("text_hash", T.LongType()),
        field("positions", T.ArrayType(T.IntegerType())),
        field("n_lines", T.IntegerType()),
    ]
    return map_batches(docs.select("doc_id", "text"), _key_batches, fields, min_chars=min_chars)


#: What a streamed row says: its lines go; undecided; summary of a run at the end of a task.
_GOES, _OPEN, _SUMMARY = 0, 1, 2


class _Run:
    """A run of one key that goes on in the next batch or touches an end of the task."""

    def __init__(self, first: bool, key: tuple, head: pa.RecordBatch):
        self.first, self.key, self.head = first, key, head
        #: Whether rows of it were given on undecided, so that its summary is needed.
        self.open = first
        self.docs, self.last_doc, self.last_row = 0, None, None
        self.top = head.column("doc_id")[0].as_py()
        self.waiting: list[pa.RecordBatch] = []
        self.n_waiting = 0


def _marked(batch: pa.RecordBatch, kind: int, docs: int = 0) -> pa.RecordBatch:
    n = batch.num_rows
    extra = [pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, docs, np.int64))]
    names = [*batch.schema.names, "kind", "docs"]
    return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)


def _stream(batches: Batches, min_documents: int, most_waiting: int = _MOST_WAITING) -> Batches:
    """Rows sorted by key, descending document and text. Of a run, at most the rows of fewer than
    `min_documents` documents are held, repeats once; those beyond `most_waiting` are given on
    undecided, and settled with the runs at the ends of tasks."""
    run, started = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        doc_ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
        cuts = 1 + np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        bounds = [0, *cuts.tolist(), batch.num_rows]
        goes: list[int] = []
        for begin, end in zip(bounds, bounds[1:], strict=False):
            if run is None or run.key != (h1[begin], h2[begin]):
                if run is not None and run.open:
                    yield _marked(run.head, _SUMMARY, run.docs)
                run = None
                if started and end < batch.num_rows:
                    if end - begin >= min_documents:
                        ids = doc_ids[begin:end]
                        if len(set(ids)) >= min_documents:
                            goes += [begin + i for i, d in enumerate(ids) if d != ids[0]]
                    continue
                run = _Run(not started, (h1[begin], h2[begin]), batch.slice(begin, 1))
                started = True
            others = []
            for i in range(begin, end):
                run.docs += not run.docs or doc_ids[i] != run.last_doc
                run.last_doc = doc_ids[i]
                row = doc_ids[i], texts[i]
                if doc_ids[i] != run.top and row != run.last_row:
                    others.append(i)
                run.last_row = row
            if run.first:
                yield _marked(batch.slice(begin, end - begin), _OPEN)
            elif others:
                run.waiting.append(batch.take(pa.array(others)))
                run.n_waiting += len(others)
                if run.docs >= min_documents or run.n_waiting > most_waiting:
                    run.open |= run.docs < min_documents
                    kind = _GOES if run.docs >= min_documents else _OPEN
                    yield from (_marked(rows, kind) for rows in run.waiting)
                    run.waiting, run.n_waiting = [], 0
        if goes:
            yield _marked(batch.take(pa.array(goes)), _GOES)
    if run is not None:
        if not run.first:
            yield from (_marked(rows, _OPEN) for rows in run.waiting)
        yield _marked(run.head, _SUMMARY, run.docs)


def _settled(streamed: DataFrame, min_documents: int) -> DataFrame:
    """Rows that go: those known from one task, and those of runs that lie in several."""
    keys = ["h1", "h2"]
    runs = (
        streamed.where(F.col("kind") == _SUMMARY)
        .groupBy(keys)
        .agg(F.sum("docs").alias("total"), F.max("doc_id").alias("top"))
        .where(F.col("total") >= min_documents)
    )
    # Written, so that Spark knows the size: about two summaries for each task of the sort.
    runs = stored(runs, "open-runs")
    undecided = streamed.where(F.col("kind") == _OPEN).join(runs, keys)
    found = ["doc_id", "text_hash", "positions", "n_lines"]
    return (
        streamed.where(F.col("kind") == _GOES)
        .select(found)
        .unionByName(undecided.where(~F.col("doc_id").eqNullSafe(F.col("top"))).select(found))
    )


def pack_bitmap(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)


def _bitmap_batches(batches: Batches) -> Batches:
    for batch in batches:
        bitmaps = []
        for n, gone in zip(
            batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True
        ):
            keep = np.ones(n, np.uint8)
            for positions in gone:
                keep[positions] = 0
            bitmaps.append(pack_bitmap(keep))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "text_hash", "n_lines")),
                pa.array(bitmaps, pa.binary()),
            ],
            names=["doc_id", "text_hash", "n_lines", "bitmap"],
        )


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """`doc_id`, `text_hash`, `n_lines`, `bitmap` of every document that loses lines.

    A key is a line without blanks at its ends, A-Z in lower case. Rows that share a doc_id count
    as one document; rows without a doc_id count together as one that is smaller than all others.
    Repeated rows share a bitmap; rows of one doc_id with different texts have one each, told apart
    by the hash of the text. Null and empty texts have no long line. No document, no bitmap."""
    keys = stored(_line_keys(docs, min_chars), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order, "text_hash")
    fields = [*keys.schema.fields, field("kind", T.ByteType()), field("docs", T.LongType())]
    streamed = stored(map_batches(dealt, _stream, fields, min_documents=min_documents), "line-runs")
    gone = (
        _settled(streamed, min_documents)
        .groupBy("doc_id", "text_hash")
        # Repeated rows name the same positions: a set holds at most one entry for each line.
        .agg(F.max("n_lines").alias("n_lines"), F.collect_set("positions").alias("gone"))
    )
    fields = [
        docs.schema["doc_id"],
        field("text_hash", T.LongType()),
        field("n_lines", T.IntegerType()),
        field("bitmap", T.BinaryType()),
    ]
    return map_batches(gone, _bitmap_batches, fields)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`id`, `row` and `bitmap` of every row of `docs`; no bitmap where all lines stay."""
    named = bitmaps.select(
        F.col("doc_id").alias("losing_id"), F.col("text_hash").alias("losing_hash"), "bitmap"
    )
    same = F.col("id").eqNullSafe(F.col("losing_id")) & (F.col("hash") == F.col("losing_hash"))
    return identified(docs).join(named, same, "left").select("id", "row", "bitmap")


def kept_text(text: str | bytes, bitmap: bytes | None) -> tuple[str | bytes, int, int]:
    """The text without the dropped lines, its lines before, and the number dropped."""
    newline = b"\n" if isinstance(text, bytes) else "\n"
    n_lines = text.count(newline) + 1
    if bitmap is None:
        return text, n_lines, 0
    keep = unpack_bitmap(bitmap, n_lines)
    lines = text.split(newline)
    kept = newline.join([line for line, stays in zip(lines, keep.tolist(), strict=True) if stays])
    return kept, n_lines, n_lines - int(keep.sum())


@F.pandas_udf(T.StringType())
def kept_text_column(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """Texts without the lines their bitmaps drop; null stays null."""
    pairs = zip(text, bitmap, strict=True)
    return pd.Series([t if t is None or b is None else kept_text(t, b)[0] for t, b in pairs])


def _kept_batches(batches: Batches) -> Batches:
    for batch in batches:
        bitmaps = batch.column("bitmap").to_pylist()
        rows = [
            kept_text(t or b"", b) for t, b in zip(text_bytes(batch), bitmaps, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["doc_id", "kept", "n_lines", "n_dropped"],
        )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """`doc_id`, `kept` (text), `n_lines` (before), `n_dropped` for every row of `docs`. A null or
    empty text is one empty line. Other columns are ignored."""
    narrow = docs.select("doc_id", "text")
    marked = with_bitmaps(narrow, keep_bitmaps(narrow, min_chars, min_documents)).select(
        F.col("id").alias("doc_id"), "row.text", "bitmap"
    )
    fields = [
        docs.schema["doc_id"],
        field("kept", T.StringType()),
        field("n_lines", T.LongType()),
        field("n_dropped", T.LongType()),
    ]
    return map_batches(marked, _kept_batches, fields)
