"""Byte-pair encoding and decoding with certain cuts.

A merge only ever makes a token of the vocabulary. Two neighbouring bytes that are neighbours in no
token can therefore never end up in one, and the place between them is a cut, whatever the merge
order does elsewhere. Words are cut at all such places, and the fragments are encoded on their own
and put one after the other; fragments and words are remembered by each worker.

The vocabulary file is read where it is used; its path must exist on every node.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, small_batches

_END = "</w>"
# Fixed values of the tokenizer: how normalised text is cut into words. The second says the same
# of ASCII text.
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
)
_ASCII_WORDS = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+")
_REMEMBERED = 250_000
_LONGEST_REMEMBERED = 64
_PIECE_CHARS = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Encoder and decoder of one vocabulary file (lower-casing byte-level BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.ids: dict[str, int] = described["model"]["vocab"]
        merges = described["model"]["merges"]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: k for k, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.letters = dict(enumerate(byte_letters()))
        self.inner, self.last = self._neighbours()
        marks = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.split_special = re.compile(f"({'|'.join(marks)})").split if marks else lambda t: [t]
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _neighbours(self) -> tuple[set, set]:
        """Pairs of byte letters that are neighbours inside a token, and those that are the last
        two of a token that ends a word."""
        inner, last = set(), set()
        for token in self.ids:
            letters = token.removesuffix(_END)
            pairs = list(zip(letters, letters[1:], strict=False))
            if pairs and letters != token:
                last.add(pairs.pop())
            inner.update(pairs)
        return inner, last

    def in_letters(self, word: str) -> str:
        """The letters of a word's bytes; printable ASCII stands for itself."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.letters)

    def cut(self, letters: str) -> list[str]:
        """The fragments of a word between certain cuts."""
        if len(letters) < 2:
            return [letters]
        ends = (letters[-2], letters[-1]) in self.last
        if self.inner.issuperset(zip(letters[:-1], letters[1:-1], strict=False)):
            return [letters] if ends else [letters[:-1], letters[-1]]
        pairs = zip(letters[:-1], letters[1:-1], strict=False)
        cuts = [k for k, pair in enumerate(pairs, 1) if pair not in self.inner]
        if not ends:
            cuts.append(len(letters) - 1)
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]

    def _merged_short(self, ids: list[int]) -> tuple[int, ...]:
        """Merges by rank, leftmost first, over a list."""
        rank, made, never = self.ranks.get, self.made, len(self.made)
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (lowest := min(ranks)) < never:
            at = ranks.index(lowest)
            ids[at] = new = made[lowest]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | new, never)
            if at < len(ranks):
                ranks[at] = rank(new << 32 | ids[at + 1], never)
        return tuple(ids)

    def _merged_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same over a linked list with a heap, for fragments of any length."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                left, right = ids[at], ids[after[at]]
                rank = self.ranks.get(left << 32 | right)
                if rank is not None:
                    heapq.heappush(heap, (rank, at, left, right))

        for at in range(len(ids)):
            offer(at)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            gone = after[at]
            if ids[at] != left or gone < 0 or ids[gone] != right:
                continue
            ids[at], ids[gone] = self.made[rank], -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return tuple([i for i in ids if i >= 0])

    def _merged(self, letters: str, ends_word: bool) -> tuple[int, ...]:
        ids = [self.ids[c] for c in letters]
        if ends_word:
            ids[-1] = self.ids[letters[-1] + _END]
        short = len(ids) <= _LONGEST_REMEMBERED
        return self._merged_short(ids) if short else self._merged_long(ids)

    def _fragment(self, letters: str, ends_word: bool) -> tuple[int, ...]:
        if len(letters) > _LONGEST_REMEMBERED:
            return self._merged(letters, ends_word)
        found = self.fragments.get((letters, ends_word))
        if found is None:
            if len(self.fragments) >= _REMEMBERED:
                self.fragments.clear()
            found = self.fragments[letters, ends_word] = self._merged(letters, ends_word)
        return found

    def _new_word(self, word: str) -> tuple[int, ...]:
        *firsts, last = self.cut(self.in_letters(word))
        if firsts:
            parts = [self._fragment(f, False) for f in firsts]
            found = (*chain.from_iterable(parts), *self._fragment(last, True))
        else:
            found = self._merged(last, True)
        if len(word) <= _LONGEST_REMEMBERED:
            if len(self.words) >= _REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found

    def _encode_plain(self, text: str) -> Iterator[int]:
        if text.isascii():
            words = _ASCII_WORDS.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # Each letter is lowered on its own: a sigma is the same at the end of a word.
            words = _WORDS.findall(text.replace("Σ", "σ").lower())
        known = self.words.get
        return chain.from_iterable([known(w) or self._new_word(w) for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; a null text has none. The strings of special tokens are these tokens."""
        parts = []
        for piece in _pieces(text or ""):
            ids: list[int] = []
            for part in self.split_special(piece):
                if part in self.special:
                    ids.append(self.special[part])
                else:
                    ids.extend(self._encode_plain(part))
            parts.append(np.array(ids, np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids, special ones too, joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_BLANK = re.compile(r"[ \n]")


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of bounded size where its blanks allow: no word reaches over a blank."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _PIECE_CHARS)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _encoded_batches(batches: Batches, path: str) -> Batches:
    model = tokenizer(path)
    for batch in small_batches(batches):
        ids = [model.encode(t) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                pa.array([model.decode(i) for i in ids], pa.string()),
            ],
            names=["doc_id", "ids", "decoded"],
        )


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids`, `decoded` for every row of `docs`, with the vocabulary at `path`. Null and
    empty texts have no ids and decode to an empty text. Other columns are ignored."""
    fields = [
        docs.schema["doc_id"],
        field("ids", T.ArrayType(T.IntegerType())),
        field("decoded", T.StringType()),
    ]
    return map_batches(docs.select("doc_id", "text"), _encoded_batches, fields, path=path)
