"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits. The bits are dealt over the 2^(r+1) - 1 nonzero vectors of r + 1 bits;
each such vector v also names a table, whose mask keeps the bits dealt to vectors m with an odd
number of ones in common with v. A pair that differs in at most r bits gives r equations in r + 1
unknowns, so some v is even with all of them: its mask leaves out every differing bit, and the pair
collides in that table. No pair within the radius can be missed.

A bucket may hold any number of fingerprints, so its pairs are never listed. Two fingerprints
within two bits have a fingerprint between them that is at most one bit from either; members of a
bucket therefore name the points one bit away (over the bits their masks left out), and all that
name the same point are within two bits of each other. At most 65 fingerprints can name a point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, text_bytes
from roomtide.llm.components import connected_components
from roomtide.sources.scratch import stored

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
_HASH_SEED = 42
_SHINGLES_AT_ONCE = 1 << 16


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bits each table keeps."""
    size = 1 << (radius + 1)
    dealt = [1 + i % (size - 1) for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() % 2) for v in range(1, size)
    ]


def simhash(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a text: a bit is set if it is in over half of the shingle hashes."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(joined)]))
    if len(found) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        span = slice(at, at + _SHINGLES_AT_ONCE)
        pairs = zip(starts[span].tolist(), ends[span].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], _HASH_SEED) for s, e in pairs], np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Batches, words: int) -> Batches:
    for batch in batches:
        texts = text_bytes(batch)
        prints = np.array([simhash(t, words) for t in texts], np.uint64)
        hashes = np.array([xxhash.xxh64_intdigest(t or b"", _HASH_SEED) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(hashes.view(np.int64)),
                pa.array(prints.view(np.int64)),
            ],
            names=["doc_id", "text_hash", "print"],
        )


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """`doc_id`, `text_hash`, `print` (the 64 bits as a long) for every row; whole texts are read. A
    null or empty text, or one of white space only, has fingerprint 0."""
    fields = [
        docs.schema["doc_id"],
        field("text_hash", T.LongType()),
        field("print", T.LongType()),
    ]
    return map_batches(docs.select("doc_id", "text"), _fingerprint_batches, fields, words=words)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links `a`, `b` between different fingerprints (`print`, distinct) at most two bits apart,
    as stars around points between them: fingerprints within the radius are joined directly or
    through the smallest one that names the same point."""
    if radius not in (1, 2):
        raise ValueError("points between two fingerprints cover a radius of 1 or 2")
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in covering_masks(radius)]
    tables = prints.select(
        "print",
        F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in masks])).alias(
            "table", "key"
        ),
    )
    crowded = tables.groupBy("table", "key").count().where("count > 1").drop("count")
    left_out = F.array(*[F.lit(~m) for m in masks])
    free = (
        tables.join(crowded, ["table", "key"])
        .groupBy("print")
        .agg(F.bit_or(left_out[F.col("table")]).alias("free"))
    )
    bits = [F.lit((1 << i) - (1 << BITS) if i == BITS - 1 else 1 << i) for i in range(BITS)]
    flips = F.filter(F.array(*bits), lambda b: F.col("free").bitwiseAND(b) != 0)
    points = free.select(
        "print",
        F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip"),
    ).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("point"))
    near = points.groupBy("point").agg(F.collect_list("print").alias("near"))
    return (
        near.where(F.size("near") > 1)
        .select(F.array_min("near").alias("b"), F.explode("near").alias("a"))
        .where("a != b")
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """`doc_id`, `fingerprint`, `component_id`, `text_hash`, `component` for every row of `docs`.

    The component_id is the smallest doc_id reachable over links. Rows without a doc_id take part
    and get that of the rows they reach, or null; `component` (the smallest fingerprint reachable)
    is never null. Repeated rows are equal fingerprints and so belong together. Other columns of
    `docs` are ignored; an empty table gives no rows."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(
        prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints"
    )
    roots = connected_components(links(distinct.select("print"), radius))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root")
    )
    rooted = stored(rooted, "rooted")
    components = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(components, "root").select("print", "component_id", "root")
    return prints.join(named, "print").select(
        "doc_id",
        _hex("print").alias("fingerprint"),
        "component_id",
        "text_hash",
        _hex("root").alias("component"),
    )


def _hex(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
