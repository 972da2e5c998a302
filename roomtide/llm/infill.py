"""Fill-in-the-middle: texts cut at two places and put together again in another order.

Where a text may be cut is a set of byte offsets, kept as a roaring set keeps integers: offsets are
grouped by their high bits into containers of at most 65,536, and a container is an array, a bitmap
or a list of runs, whichever is smallest. Running totals of the containers' sizes find the container
of the n-th offset, and a select inside it finds the offset. So a cut after n units, units being code
points or lines, takes two searches and never decodes the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches, small_batches, text_bytes

PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Marks in front of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("character", "line")
_CONTAINER = 1 << 16
_BITMAP_BYTES = _CONTAINER // 8


class ArrayContainer:
    """Few offsets, ascending."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, n: int) -> int:
        return int(self.low[n])


class BitmapContainer:
    """A bit for each offset, with running totals of the set bits of every 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_CONTAINER, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").reshape(-1, 8)
        self.totals = np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))

    def select(self, n: int) -> int:
        word = int(np.searchsorted(self.totals, n, side="right"))
        before = int(self.totals[word - 1]) if word else 0
        inside = np.flatnonzero(np.unpackbits(self.words[word], bitorder="little"))
        return word * 64 + int(inside[n - before])


class RunContainer:
    """Stretches of neighbouring offsets, with running totals of their lengths."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.totals = starts, np.cumsum(lengths)

    def select(self, n: int) -> int:
        run = int(np.searchsorted(self.totals, n, side="right"))
        before = int(self.totals[run - 1]) if run else 0
        return int(self.starts[run]) + n - before


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of ascending offsets below 65,536."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    n_runs = len(breaks) + 1
    if 4 * n_runs < min(2 * len(low), _BITMAP_BYTES):
        firsts = np.concatenate(([0], breaks))
        return RunContainer(low[firsts], np.diff(np.append(firsts, len(low))))
    return ArrayContainer(low) if 2 * len(low) <= _BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """The byte offsets at which the units of a text start."""

    def __init__(self, text: bytes, unit: str = "character"):
        self.end, self.keys, self.containers, sizes = len(text), [], [], []
        raw = np.frombuffer(text, np.uint8)
        for key in range(0, len(text), _CONTAINER):
            part = raw[key : key + _CONTAINER]
            if unit == "character":
                low = np.flatnonzero(part & 0xC0 != 0x80)
            else:
                before = raw[key - 1] if key else 0x0A
                low = np.flatnonzero(np.concatenate(([before], part[:-1])) == 0x0A)
            if len(low):
                self.keys.append(key)
                self.containers.append(container(low))
                sizes.append(len(low))
        self.totals = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.totals[-1]) if len(self.totals) else 0

    def select(self, n: int) -> int:
        """The offset after n units: that of unit n, or the end of the text."""
        at = int(np.searchsorted(self.totals, n, side="right"))
        if at == len(self.totals):
            return self.end
        before = int(self.totals[at - 1]) if at else 0
        return self.keys[at] + self.containers[at].select(n - before)


def _cut_batches(batches: Batches, unit: str, marks: Sequence[str], plain: int, spm: int) -> Batches:
    mark = [m.encode() for m in marks]
    for batch in small_batches(batches):
        draws = batch.column("draws").to_pylist()
        n, forms, cuts, outputs = [], [], [], []
        for text, (h1, h2, h3, h4) in zip(text_bytes(batch), draws, strict=True):
            text = text or b""
            units = BoundarySet(text, unit)
            n.append(len(units))
            if not text or h3 % 100 >= 100 - plain or any(m in text for m in mark):
                forms.append("plain")
                cuts.append((None, None))
                outputs.append(text)
                continue
            first, second = sorted((h1 % (n[-1] + 1), h2 % (n[-1] + 1)))
            a, b = units.select(first), units.select(second)
            before, middle, after = mark[0] + text[:a], mark[2] + text[a:b], mark[1] + text[b:]
            is_spm = h4 % 100 < spm
            forms.append("spm" if is_spm else "psm")
            cuts.append((first, second - first))
            outputs.append(b"".join((after, before, middle) if is_spm else (before, after, middle)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array([c[0] for c in cuts], pa.int64()),
                pa.array([c[1] for c in cuts], pa.int64()),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
        )


def _draws(doc_id: Column) -> Column:
    """The first four groups of eight digits of a hash of the id, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    return F.array(*groups)


def _checked(marks: Sequence[str]) -> list[str]:
    """Marks that can be told apart wherever they stand: none begins as any ends."""
    marks = list(marks)
    overlap = any(
        a.endswith(b[:size]) for a in marks for b in marks for size in range(1, len(b))
    )
    contained = any(a in b for a, b in permutations(marks, 2))
    if len(marks) != 3 or not all(marks) or overlap or contained:
        raise ValueError(f"marks must be three texts that can't overlap: {marks}")
    return marks


def fill_in_middle(
    docs: DataFrame,
    unit: str = "character",
    marks: Sequence[str] = MARKS,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """`doc_id`, `n`, `form`, `prefix_units`, `middle_units`, `output` for every row of `docs`.

    A text of `n` units (code points, or lines with their newlines) is cut at two places drawn from
    its id: "psm" puts prefix, suffix and middle behind their marks in this order, "spm" the suffix
    first. A share of the texts stays "plain", as do empty and null texts (output empty) and those
    that contain a mark; they have no cuts. A null id counts as an empty one, rows of one id have
    the same draws, repeated rows the same output; other columns are ignored and no rows give none."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    fields = [
        docs.schema["doc_id"],
        field("n", T.LongType()),
        field("form", T.StringType()),
        field("prefix_units", T.LongType()),
        field("middle_units", T.LongType()),
        field("output", T.StringType()),
    ]
    drawn = docs.select("doc_id", "text", _draws(F.col("doc_id")).alias("draws"))
    return map_batches(
        drawn,
        _cut_batches,
        fields,
        unit=unit,
        marks=_checked(marks),
        plain=plain_percent,
        spm=spm_percent,
    )


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that `fill_in_middle` made an output from."""
    parts = F.split(output, "|".join(re.escape(m) for m in _checked(marks)), -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )
