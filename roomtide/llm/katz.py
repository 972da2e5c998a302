"""Log probabilities of texts by a Katz backoff model that is learned from the same table.

The probability of a word after a context is its Good-Turing discounted share of the context's count
where the model has seen it there, and otherwise the context's backoff weight times its probability
after the context without its first word. A weight is what the discounts leave, divided by what the
shorter context gives to words not seen after the longer one, so that the probabilities after every
context sum to one.

Texts become blocks of token numbers. For each length of n-gram, every block sends its distinct
n-grams with their counts to the partitions of that length's table, dealt by a hash of the context,
and gets back the counts over the whole corpus and what the backoff weights of unseen n-grams are
made of. Contexts that are too frequent for one partition are dealt by the whole n-gram instead, and
their weights are joined to the texts at the end. Tables stay in their partitions; the driver sees a
few numbers for each length.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, small_batches, text_bytes
from roomtide.sources.scratch import scratch_path, stored

ORDER = 2
#: Counts up to this one are discounted by Good-Turing.
CUT = 5
#: What larger counts leave to unseen words.
RESERVE = 0.001
#: Discount where the counts of counts give none, of each count up to `CUT`.
FALLBACK = 0.5
BLOCK_TOKENS = 1 << 20
PARTITION_GRAMS = 1 << 19
#: Contexts counted more often than this are dealt by the whole n-gram.
FREQUENT = 1 << 20
_PIECE = 1 << 22
#: Neither can be a word: words have no blanks.
_BEGIN, _END = b" ", b"\n"
_KEY_BITS = (1 << 48) - 1


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte place."""
    places = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(places.tobytes())


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(places.reshape(8, -1).T).view(kind).ravel()


def _packed_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of which few differ: those, and which of them stands where."""
    different, place = np.unique(values, return_inverse=True)
    return packed(different), packed(place.astype(np.int64))


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A key of a context's key and a word's, 64 bits each."""
    with np.errstate(over="ignore"):
        key = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(31))).astype(np.int64)


# --- blocks of tokens -----------------------------------------------------------------------------


class _Numbers(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens_of(text: bytes | None, numbers: _Numbers) -> np.ndarray:
    """The numbers of a text's words in lower case, and of its end."""
    text, parts, at = text or b"", [], 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].lower().split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate([*parts, [numbers[_END]]]).astype(np.int32)


def _block_batches(batches: Batches, most_tokens: int) -> Batches:
    """Rows of about `most_tokens` tokens, more only if one text has more."""
    numbers, texts, ids, learned, held = _Numbers(), [], [], [], 0

    def block() -> pa.RecordBatch:
        words = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64).view(np.int64)
        tokens = np.concatenate(texts)
        # Frequent words get small numbers, which compress better.
        frequent = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[frequent] = np.arange(len(words))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[frequent].tobytes()], pa.binary()),
                pa.array([packed(place[tokens])], pa.binary()),
                pa.array([packed(np.array([len(t) for t in texts], np.int64))], pa.binary()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([learned], pa.list_(pa.bool_())),
                pa.array([len(words)], pa.int64()),
                pa.array([len(tokens)], pa.int64()),
            ],
            names=["words", "tokens", "lengths", "ids", "learned", "n_words", "n_tokens"],
        )

    for batch in small_batches(batches):
        id_type = batch.column("doc_id").type
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "learned"))
        for text, ident, learn in zip(text_bytes(batch), *columns, strict=True):
            texts.append(tokens_of(text, numbers))
            ids.append(ident)
            learned.append(bool(learn))
            held += len(texts[-1])
            if held >= most_tokens:
                yield block()
                numbers, texts, ids, learned, held = _Numbers(), [], [], [], 0
    if texts:
        yield block()


def _token_blocks(docs: DataFrame, learn: Column, block_tokens: int) -> DataFrame:
    """The blocks as a table bucketed by `block`, so that answers are joined to it without moving it."""
    spark = docs.sparkSession
    binary, bigint = T.BinaryType(), T.LongType()
    fields = [
        field("words", binary),
        field("tokens", binary),
        field("lengths", binary),
        field("ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        field("learned", T.ArrayType(T.BooleanType())),
        field("n_words", bigint),
        field("n_tokens", bigint),
    ]
    rows = docs.select("doc_id", "text", learn.alias("learned"))
    blocks = map_batches(rows, _block_batches, fields, most_tokens=block_tokens)
    name = f"token_blocks_{uuid.uuid4().hex}"
    (
        blocks.withColumn("block", F.monotonically_increasing_id())
        .write.bucketBy(_buckets(spark), "block")
        .option("path", scratch_path(spark, name))
        .saveAsTable(name)
    )
    return spark.table(name)


def _buckets(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)


# --- the model's numbers --------------------------------------------------------------------------


def discounts(counts: np.ndarray) -> np.ndarray:
    """What share of the counts 1 to CUT is kept, at indices 1 to CUT, from how many n-grams have
    which count. The largest cut up to CUT is taken at which Good-Turing gives shares between 0 and
    1; where none does, each count loses FALLBACK. Index 0 holds the share larger counts keep."""
    kept = np.array([1 - RESERVE] * (CUT + 1))
    n = np.append(0.0, counts[: CUT + 1])
    for cut in range(CUT, 1, -1):
        if not n[1 : cut + 2].all():
            continue
        common = (cut + 1) * n[cut + 1] / n[1]
        if common >= 1:
            continue
        r = np.arange(1, cut + 1)
        shares = ((r + 1) * n[2 : cut + 2] / (n[1 : cut + 1] * r) - common) / (1 - common)
        if (shares > 0).all() and (shares < 1).all():
            kept[1 : cut + 1] = np.minimum(shares, 1 - RESERVE)
            return kept
    r = np.arange(1, CUT + 1)
    kept[1:] = (r - FALLBACK) / r
    return kept


def kept_counts(totals: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return totals * kept[np.where(totals > CUT, 0, totals)]


def left_over(rare: np.ndarray, rest: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What a context's discounts leave, as a count: from how many of its n-grams have the counts 1 to
    CUT (rows of `rare`), and the sum of the larger counts."""
    lost = (1 - kept[1:]) * np.arange(1, CUT + 1)
    return (rare * lost[:, None]).sum(axis=0) + rest * (1 - kept[0])


@dataclass(frozen=True)
class Level:
    """What is known of the n-grams of one length: how many partitions their table has, which contexts
    are too frequent for one, and what share of a count is `kept`."""

    partitions: int
    frequent: int
    kept: np.ndarray = attribute(default_factory=lambda: np.ones(CUT + 1))


@dataclass(frozen=True)
class Totals:
    """Over the texts learned from: tokens, different tokens, texts, and what level 1 leaves."""

    tokens: int
    words: int
    texts: int
    left: float

    def unknown(self) -> float:
        """The probability of a word never seen."""
        return self.left / self.tokens if self.tokens else 1.0


# --- one block ------------------------------------------------------------------------------------


class Grams:
    """The n-grams of one length in a block, sorted by context. `place` says which stands at each
    position; for each of them there is the `first` position, the keys of its context and its word,
    and the `count` in texts to learn from. Later come the count of its `context_total` and its own
    `total` in the corpus, and what its context's weight is made of (`rare`, `rest`, `lower`)."""

    def __init__(
        self,
        place: np.ndarray,
        first: np.ndarray,
        context: np.ndarray,
        word: np.ndarray,
        count: np.ndarray,
    ):
        self.place, self.first = place, first
        self.context, self.word, self.count = context, word, count
        self.parcels: list[tuple[int, bool, np.ndarray]] = []
        self.frequent = self.context_total = None
        self.total = self.rare = self.rest = self.lower = None

    def chances(self, kept: np.ndarray) -> np.ndarray:
        """The probabilities of seen n-grams; 0 for others."""
        return kept_counts(self.total, kept) / np.maximum(self.context_total, 1)

    def deal(self, frequent: np.ndarray, partitions: int) -> None:
        """Make `parcels`: (partition, frequent, n-grams in the order sent)."""
        self.frequent = frequent
        rare, often = np.flatnonzero(~frequent), np.flatnonzero(frequent)
        keys = _mixed(self.context[often], self.word[often])
        for is_frequent, grams, dealt_by in (
            (False, rare, self.context[rare]),
            (True, often, keys),
        ):
            if not len(grams):
                continue
            high = dealt_by.view(np.uint64) >> np.uint64(32)
            part = (high * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
            if is_frequent:
                order = np.argsort(part, kind="stable")
                grams, part = grams[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            self.parcels += [
                (int(p), is_frequent, g)
                for p, g in zip(part[np.append(0, cuts)], np.split(grams, cuts), strict=True)
            ]


class TokenBlock:
    """A block of texts and the answers it has got so far."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.int64)
        begin = np.array([xxhash.xxh64_intdigest(_BEGIN)], np.uint64).view(np.int64)
        self.and_begin = np.append(self.words, begin)
        self.tokens, self.lengths = unpacked(row["tokens"]), unpacked(row["lengths"])
        self.learned = np.array(row["learned"], bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.counted = np.repeat(self.learned, self.lengths)
        self.levels: list[Grams] = []

    def _before(self, distance: int) -> np.ndarray:
        """The number of the word so far before each position; that of the beginning is the number
        of words."""
        at = np.arange(len(self.tokens)) - distance
        inside = at >= np.repeat(self.starts, self.lengths)
        return np.where(inside, self.tokens[np.maximum(at, 0)], len(self.words))

    def add_level(self) -> Grams:
        """The n-grams one word longer than the longest so far."""
        size, n_words = len(self.levels) + 1, len(self.words)
        if size == 1:
            # Token numbers are the single words already.
            place, context = self.tokens, np.zeros(n_words, np.int64)
            first, word = np.empty(n_words, np.int64), self.words
            first[place[::-1]] = np.arange(len(place))[::-1]
        else:
            keys = self._key_before(size - 1)
            if size == 2:
                by_key = np.argsort(self.and_begin.view(np.uint64))
                rank = np.empty(n_words + 1, np.int64)
                rank[by_key] = np.arange(n_words + 1)
                rank = rank[self._before(1)]
            else:
                rank = np.unique(keys.view(np.uint64), return_inverse=True)[1]
            code = rank * n_words + self.tokens
            _, first, place = np.unique(code, return_index=True, return_inverse=True)
            context, word = keys[first], self.words[self.tokens[first]]
        count = np.bincount(place[self.counted], minlength=len(first))
        self.levels.append(Grams(place, first, context, word, count))
        return self.levels[-1]

    def _key_before(self, n: int) -> np.ndarray:
        """At each position, the key of the n words before it."""
        key = self.and_begin[self._before(n)]
        for distance in range(n - 1, 0, -1):
            key = _mixed(key, self.and_begin[self._before(distance)])
        return key

    def context_totals(self, totals: Totals) -> np.ndarray:
        """How often the context of each n-gram of the longest level was counted."""
        grams = self.levels[-1]
        if len(self.levels) == 1:
            return np.full(len(grams.first), totals.tokens)
        shorter = self.levels[-2]
        starts_text = np.isin(grams.first, self.starts)
        previous = np.maximum(grams.first - 1, 0)
        return np.where(starts_text, totals.texts, shorter.total[shorter.place[previous]])

    def deal(self, level: Level, totals: Totals) -> None:
        grams = self.levels[-1]
        grams.context_total = self.context_totals(totals)
        # Single words all have one context, the empty one.
        is_frequent = len(self.levels) == 1
        grams.deal(is_frequent | (grams.context_total > level.frequent), level.partitions)

    def answer(self, answers: list[dict]) -> None:
        """Take in what the partitions of the longest level's table say."""
        grams = self.levels[-1]
        n = len(grams.first)
        grams.total, grams.lower = np.zeros(n, np.int64), np.zeros(n)
        grams.rare, grams.rest = np.zeros((CUT, n), np.int64), np.zeros(n, np.int64)
        said = {(a["part"], a["frequent"]): a for a in answers}
        for part, frequent, sent in grams.parcels:
            told = said[part, frequent]
            grams.total[sent] = unpacked(told["totals"])
            if not frequent:
                unseen = sent[unpacked(told["unseen"])]
                weights = unpacked(told["weights"]).reshape(CUT + 1, -1)
                grams.rare[:, unseen], grams.rest[unseen] = weights[:CUT], weights[CUT]
                grams.lower[unseen] = unpacked(told["lower"], np.float64)


def _block_until(row: dict, size: int, levels: list[Level], totals: Totals) -> TokenBlock:
    """The block with the answers to all n-grams below `size`, and those of `size` dealt."""
    block = TokenBlock(row)
    for number in range(1, size + 1):
        block.add_level()
        block.deal(levels[number - 1], totals)
        if number < size:
            block.answer([a for a in row["answers"] if a["level"] == number])
    return block


# --- from blocks to the tables and back -----------------------------------------------------------

_ASKED = [
    field("block", T.LongType()),
    field("part", T.IntegerType()),
    field("frequent", T.BooleanType()),
    field("contexts", T.BinaryType()),
    field("sizes", T.BinaryType()),
    field("grams", T.BinaryType()),
    field("counts", T.BinaryType()),
    field("values", T.BinaryType()),
    field("value_at", T.BinaryType()),
]


def _asking_batches(batches: Batches, levels: list[Level], totals: Totals) -> Batches:
    """One row for each partition of a table that a block has n-grams for."""
    for batch in batches:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            block = _block_until(row, len(levels), levels, totals)
            grams = block.levels[-1]
            lower = np.zeros(len(grams.first))
            if len(levels) > 1:
                # All but the first word of an n-gram, as it ends at the same position.
                shorter = block.levels[-2]
                chances = shorter.chances(levels[-2].kept)
                lower = np.where(grams.count > 0, chances[shorter.place[grams.first]], 0.0)
            parcels = []
            for part, frequent, sent in grams.parcels:
                context = grams.context[sent]
                changes = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                word = grams.word[sent]
                parcels.append(
                    (
                        row["block"],
                        part,
                        frequent,
                        packed(np.diff(context[changes], prepend=0)),
                        packed(np.diff(np.append(changes, len(sent)))),
                        packed(word if frequent else word & _KEY_BITS),
                        packed(grams.count[sent]),
                        *_packed_values(lower[sent]),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        zip(*parcels, strict=True),
                        [pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 6],
                        strict=True,
                    )
                ],
                names=[f.name for f in _ASKED],
            )


_CONTEXT = T.StructType(
    [
        field("context", T.LongType()),
        field("rare", T.ArrayType(T.LongType())),
        field("rest", T.LongType()),
        field("lower", T.DoubleType()),
    ]
)
_ANSWERED = T.StructType(
    [
        field("block", T.LongType()),
        field("part", T.IntegerType()),
        field("frequent", T.BooleanType()),
        field("totals", T.BinaryType()),
        field("unseen", T.BinaryType()),
        field("weights", T.BinaryType()),
        field("lower", T.BinaryType()),
        # Of the whole partition, on a row without a block.
        field("counts", T.ArrayType(T.LongType())),
        field("n_grams", T.LongType()),
        field("contexts", T.ArrayType(_CONTEXT)),
    ]
)


def _merged_partition(table: pa.Table) -> pa.Table:
    """The counts of one partition's n-grams over all blocks, and the answers to the blocks."""
    rows = table.to_pylist()
    sizes = [unpacked(r["sizes"]) for r in rows]
    contexts = [np.cumsum(unpacked(r["contexts"])) for r in rows]
    context = np.concatenate([np.repeat(c, s) for c, s in zip(contexts, sizes, strict=True)])
    gram = np.concatenate([unpacked(r["grams"]) for r in rows])
    count = np.concatenate([unpacked(r["counts"]) for r in rows])
    lower = np.concatenate(
        [unpacked(r["values"], np.float64)[unpacked(r["value_at"])] for r in rows]
    )
    ends = np.cumsum([s.sum() for s in sizes])

    order = np.lexsort((gram, context))
    differs = (context[order][1:] != context[order][:-1]) | (gram[order][1:] != gram[order][:-1])
    starts = np.flatnonzero(np.concatenate(([True], differs)))
    total = np.add.reduceat(count[order], starts)
    chance = np.maximum.reduceat(lower[order], starts)
    of_gram = np.empty(len(gram), np.int64)
    of_gram[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gram))))

    of_context = context[order][starts]
    heads = np.flatnonzero(np.concatenate(([True], of_context[1:] != of_context[:-1])))
    rare = np.array([np.add.reduceat((total == r).astype(np.int64), heads) for r in range(1, CUT + 1)])
    rest = np.add.reduceat(np.where(total > CUT, total, 0), heads)
    seen_lower = np.add.reduceat(np.where(total > 0, chance, 0.0), heads)
    context_no = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(starts))))

    # A context is dealt in one way everywhere, so that rows of one kind never meet the other's.
    frequent_contexts = np.unique(
        np.concatenate([c for c, r in zip(contexts, rows, strict=True) if r["frequent"]] or [[]])
    )
    out = []
    for row, end, size in zip(rows, ends, sizes, strict=True):
        mine = of_gram[end - size.sum() : end]
        answer = {"block": row["block"], "part": row["part"], "frequent": row["frequent"]}
        answer["totals"] = packed(total[mine])
        if not row["frequent"]:
            place = context_no[mine]
            known = rare[:, place].any(axis=0) | (rest[place] > 0)
            unseen = np.flatnonzero((total[mine] == 0) & known)
            at = place[unseen]
            answer["unseen"] = packed(unseen)
            answer["weights"] = packed(np.concatenate([*rare[:, at], rest[at]]))
            answer["lower"] = packed(seen_lower[at])
        out.append(answer)
    partial = np.flatnonzero(np.isin(of_context[heads], frequent_contexts))
    out.append(
        {
            "counts": [int((total == r).sum()) for r in range(1, CUT + 2)],
            "n_grams": int((total > 0).sum()),
            "contexts": [
                {
                    "context": int(of_context[heads[c]]),
                    "rare": rare[:, c].tolist(),
                    "rest": int(rest[c]),
                    "lower": float(seen_lower[c]),
                }
                for c in partial
            ],
        }
    )
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("part", pa.int32()),
            ("frequent", pa.bool_()),
            ("totals", pa.binary()),
            ("unseen", pa.binary()),
            ("weights", pa.binary()),
            ("lower", pa.binary()),
            ("counts", pa.list_(pa.int64())),
            ("n_grams", pa.int64()),
            (
                "contexts",
                pa.list_(
                    pa.struct(
                        [
                            ("context", pa.int64()),
                            ("rare", pa.list_(pa.int64())),
                            ("rest", pa.int64()),
                            ("lower", pa.float64()),
                        ]
                    )
                ),
            ),
        ]
    )
    return pa.Table.from_pylist(out, schema)


def _with_answers(blocks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """The blocks with a column `answers`; the blocks themselves are not moved."""
    if answers is None:
        return blocks
    n = _buckets(blocks.sparkSession)
    answer = F.struct("level", "part", "frequent", "totals", "unseen", "weights", "lower")
    said = (
        answers.where("block IS NOT NULL")
        .repartition(n, "block")
        .groupBy("block")
        .agg(F.collect_list(answer).alias("answers"))
    )
    return blocks.join(said.hint("merge"), "block")


_SCORED = [
    field("n_tokens", T.LongType()),
    field("n_known", T.LongType()),
    field("base_score", T.DoubleType()),
    field("score", T.DoubleType()),
    field(
        "waiting",
        T.ArrayType(
            T.StructType(
                [field("level", T.IntegerType()), field("context", T.LongType()), field("n", T.LongType())]
            )
        ),
    ),
    field("row", T.LongType()),
]


def _log10(values: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(values, 1e-300))


def _scoring_batches(batches: Batches, levels: list[Level], totals: Totals) -> Batches:
    """Each text's score, recursively from the longest n-grams down. Weights of frequent contexts are
    left out of it and listed in `waiting`."""
    for batch in batches:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            block = _block_until(row, len(levels), levels, totals)
            block.answer([a for a in row["answers"] if a["level"] == len(levels)])
            n_texts = len(block.lengths)
            text_of = np.repeat(np.arange(n_texts), block.lengths)
            score, open_ = np.zeros(len(block.tokens)), np.ones(len(block.tokens), bool)
            waiting: list[list[tuple]] = [[] for _ in range(n_texts)]
            for size in range(len(levels), 0, -1):
                grams, kept = block.levels[size - 1], levels[size - 1].kept
                seen = grams.total > 0
                step = np.where(seen, _log10(grams.chances(kept)), 0.0)
                if size == 1:
                    step[~seen] = _log10(np.array(totals.unknown()))
                else:
                    left = left_over(grams.rare, grams.rest, kept) / np.maximum(grams.context_total, 1)
                    weight = left / np.maximum(1 - grams.lower, 1e-300)
                    known = ~seen & ~grams.frequent & (grams.context_total > 0)
                    step[known] = _log10(weight[known])
                    waits = np.flatnonzero(open_ & (~seen & grams.frequent)[grams.place])
                    pairs = np.stack([text_of[waits], grams.context[grams.place[waits]]], axis=1)
                    for (text, context), n in zip(
                        *np.unique(pairs, axis=0, return_counts=True), strict=True
                    ):
                        waiting[text].append((size, int(context), int(n)))
                score += np.where(open_, step[grams.place], 0.0)
                open_ &= ~seen[grams.place]
            words = block.levels[0]
            known = words.total[words.place] > 0
            base = np.log10(
                (words.total[words.place] + 0.1) / (totals.tokens + 0.1 * (totals.words + 1))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                    pa.array(block.learned),
                    pa.array(block.lengths),
                    pa.array(np.add.reduceat(known.astype(np.int64), block.starts)),
                    pa.array(np.add.reduceat(base, block.starts)),
                    pa.array(np.add.reduceat(score, block.starts)),
                    pa.array(
                        [[dict(zip(("level", "context", "n"), w, strict=True)) for w in t] for t in waiting],
                        pa.list_(
                            pa.struct(
                                [("level", pa.int32()), ("context", pa.int64()), ("n", pa.int64())]
                            )
                        ),
                    ),
                    pa.array(np.arange(n_texts)),
                ],
                names=["doc_id", "learned", *(f.name for f in _SCORED)],
            )


def _frequent_weights(answers: DataFrame, levels: list[Level]) -> DataFrame:
    """`level`, `context`, `log_weight` of the contexts that are dealt by the whole n-gram."""
    parts = answers.where("block IS NULL AND level > 1").select("level", F.inline("contexts"))
    summed = parts.groupBy("level", "context").agg(
        *[F.sum(F.col("rare")[r]).alias(f"rare{r + 1}") for r in range(CUT)],
        F.sum("rest").alias("rest"),
        F.sum("lower").alias("lower"),
    )

    def kept(r: int) -> Column:
        shares = F.array(*[F.lit(float(level.kept[r])) for level in levels])
        return F.element_at(shares, F.col("level"))

    counted = sum((F.col(f"rare{r}") * r for r in range(1, CUT + 1)), F.col("rest"))
    left = sum(
        (F.col(f"rare{r}") * r * (1 - kept(r)) for r in range(1, CUT + 1)),
        F.col("rest") * (1 - kept(0)),
    )
    free = F.greatest(1 - F.col("lower"), F.lit(1e-300))
    return summed.where(counted > 0).select(
        "level", "context", F.log10(left / counted / free).alias("log_weight")
    )


def score_texts(
    docs: DataFrame,
    learn: Column,
    order: int = ORDER,
    block_tokens: int = BLOCK_TOKENS,
    partition_grams: int = PARTITION_GRAMS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """`doc_id`, `learned`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` for every row.

    The model of n-grams up to `order` words is learned from the rows where `learn` holds and scores
    all rows. Tokens are runs of anything but blanks, with A-Z in lower case, and one end for each
    text; contexts reach back to the text's beginning. `score` is the text's log10 probability,
    `base_score` that of single words with 0.1 added to each count; `n_known` tokens were learned.
    All unknown words together have what single words leave by Good-Turing. Null and empty texts
    consist of their end. Repeated rows are learned from and scored each; null ids are kept, other
    columns ignored; with nothing to learn from, every score is 0; no rows give none. Words are told
    apart by 64 bits of their hash, and words after one context by 48."""
    blocks = _token_blocks(docs, F.coalesce(learn, F.lit(False)), block_tokens)
    learned = F.size(F.filter("learned", lambda x: x))
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum(learned)).first()
    n_words, n_tokens, n_texts = (n or 0 for n in sizes)
    levels: list[Level] = []
    totals, answers = Totals(0, 0, 0, 0.0), None
    for size in range(1, order + 1):
        sent = n_words if size == 1 else n_tokens
        levels.append(Level(max(1, -(-sent // partition_grams)), frequent))
        asked = map_batches(
            _with_answers(blocks, answers), _asking_batches, _ASKED, levels=levels, totals=totals
        )
        merged = asked.groupBy("part").applyInArrow(_merged_partition, _ANSWERED)
        told = stored(merged.withColumn("level", F.lit(size)), f"grams-{size}")
        answers = told if answers is None else answers.unionByName(told)
        counts = [F.sum(F.col("counts")[r]) for r in range(CUT + 1)]
        *counts, n_grams = told.where("block IS NULL").agg(*counts, F.sum("n_grams")).first()
        kept = discounts(np.array([c or 0 for c in counts], float))
        levels[-1] = Level(levels[-1].partitions, frequent, kept)
        if size == 1:
            sums = (
                told.where("block IS NULL")
                .select(F.inline("contexts"))
                .agg(*[F.sum(F.col("rare")[r]) for r in range(CUT)], F.sum("rest"))
                .first()
            )
            rare = np.array([[s or 0] for s in sums[:CUT]])
            rest = np.array([sums[CUT] or 0])
            counted = int((rare[:, 0] * np.arange(1, CUT + 1)).sum() + rest[0])
            totals = Totals(counted, n_grams or 0, n_texts, float(left_over(rare, rest, kept)[0]))
    scored = stored(
        map_batches(
            _with_answers(blocks, answers),
            _scoring_batches,
            [field("doc_id", docs.schema["doc_id"].dataType), field("learned", T.BooleanType()), *_SCORED],
            levels=levels,
            totals=totals,
        ).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    missing = (
        scored.select("row", F.inline("waiting"))
        .join(_frequent_weights(answers, levels), ["level", "context"])
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("log_weight")).alias("added"))
    )
    score = F.col("score") + F.coalesce("added", F.lit(0.0))
    return scored.join(missing, "row", "left").select(
        "doc_id",
        "learned",
        "n_tokens",
        "n_known",
        F.lit(totals.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        score.alias("score"),
    )
