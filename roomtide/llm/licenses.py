"""Licence notices in documents, by the Dice coefficient over word bigrams.

A unit of a document (a line, a block between blank lines, or the whole text) is compared with every
template whose size lets it reach the threshold: with a and b different bigrams the coefficient is
2 |A and B| / (a + b), at most 2 min(a, b) / (a + b), so only templates with a size between
b t / (2 - t) and b (2 - t) / t come into question.

Notices with other words beside them are found in windows of the text's words, wherever its lines end.
A window starts with a bigram of its template and is as long as the template, up to (2 - t) / t times
as long; where the text ends before that, it ends with the text. Of windows that share words, the one
with the most bigrams of its template counts (of equal ones, that with the highest coefficient), so
that a whole header counts before the short notice in it; then the next that shares no word with it,
and so on. So a shortened notice right before another one, whose first words its window needs, is no
window of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import Batches, field, map_batches

THRESHOLD = 0.8
#: Words of normalised text: letters and digits, with version numbers whole.
WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
_WORDS = re.compile(WORD)
#: Blocks end at one or more lines without a visible character.
BLANK_LINES = r"\n(?:[\t-\r ]*\n)+"
_BLANK_LINES = re.compile(BLANK_LINES)

#: Notices that licences ask for or that name them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

Bigrams = frozenset[tuple[str, str]]


def bigrams(words: list[str]) -> Bigrams:
    return frozenset(zip(words, words[1:], strict=False))


class Matcher:
    """Templates by size, with the words of which a match must have enough."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        named = [(bigrams(_WORDS.findall(t.lower())), name) for name, t in templates.items()]
        self.templates = sorted(((b, n) for b, n in named if b), key=lambda x: (len(x[0]), x[1]))
        self.sizes = [len(b) for b, _ in self.templates]
        self.threshold = threshold
        self.all_bigrams = frozenset().union(*(b for b, _ in self.templates))
        self.vocabulary = {w for pair in self.all_bigrams for w in pair}
        self.places = [len(_WORDS.findall(templates[name].lower())) - 1 for _, name in self.templates]
        self.holders = defaultdict(list)
        for number, (template, _) in enumerate(self.templates):
            for pair in template:
                self.holders[pair].append(number)

    def best(self, words: list[str]) -> tuple[str, float, int] | None:
        """The template with the highest coefficient, of equal ones the first by name."""
        if len(words) < 2 or len(self.vocabulary.intersection(words)) < 2:
            return None
        found = bigrams(words)
        # Bigrams of no template only lower the coefficient; count the others once.
        shared = found & self.all_bigrams
        t, n, best = self.threshold, len(found), None
        low = bisect_left(self.sizes, n * t / (2 - t) - 1e-9)
        high = bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        for template, name in self.templates[low:high]:
            dice = 2.0 * len(shared & template) / (n + len(template))
            if dice >= t and (best is None or (-dice, name) < (-best[1], best[0])):
                best = (name, dice, n)
        return best

    def windows(self, words: list[str]) -> list[tuple[int, int, str, float, int]]:
        """First word, number of words, template, coefficient and bigrams of the best windows that
        share no word."""
        pairs = list(zip(words, words[1:], strict=False))
        shared = [(k, pair) for k, pair in enumerate(pairs) if pair in self.all_bigrams]
        places_of = defaultdict(list)
        for k, pair in shared:
            for number in self.holders[pair]:
                places_of[number].append(k)
        found = []
        for number, places in places_of.items():
            name = self.templates[number][1]
            for i, start in enumerate(places):
                best = self._best_length(pairs, places, i, number)
                if best:
                    dice, length, distinct, common = best
                    found.append((-common, -dice, start, length + 1, name, distinct))
        return _apart(sorted(found))

    def _best_length(
        self, pairs: list[tuple[str, str]], places: list[int], i: int, number: int
    ) -> tuple[float, int, int, int] | None:
        template, t = self.templates[number][0], self.threshold
        start, left = places[i], len(pairs) - places[i]
        shortest = min(self.places[number], left)
        longest = min(int(self.places[number] * (2 - t) / t + 1e-9), left)
        # Fewer shared places than the lower size bound cannot reach the threshold.
        if bisect_left(places, start + longest, i) - i < len(template) * t / (2 - t) - 1e-9:
            return None
        seen, common, best = set(), 0, None
        for length, pair in enumerate(pairs[start : start + longest], 1):
            if pair not in seen:
                seen.add(pair)
                common += pair in template
            if length >= shortest:
                dice = 2.0 * common / (len(seen) + len(template))
                if dice >= t and (best is None or dice > best[0]):
                    best = (dice, length, len(seen), common)
        return best


def _apart(
    found: list[tuple[int, float, int, int, str, int]],
) -> list[tuple[int, int, str, float, int]]:
    taken, chosen = [], []
    for _, minus, first, n_words, name, distinct in found:
        place = bisect_left(taken, (first, 0))
        free_before = place == 0 or taken[place - 1][1] <= first
        if free_before and (place == len(taken) or first + n_words <= taken[place][0]):
            insort(taken, (first, first + n_words))
            chosen.append((first, n_words, name, -minus, distinct))
    return chosen


def units(text: str) -> list[tuple[str, int, str]]:
    """Lines; blocks of several lines, cut at blank lines; the text if it has several blocks."""
    lines = [("line", k, line) for k, line in enumerate(text.split("\n"))]
    blocks = _BLANK_LINES.split(text)
    several = [("block", k, block) for k, block in enumerate(blocks) if "\n" in block]
    return lines + several + ([("text", 0, text)] if len(blocks) > 1 else [])


def _notice_batches(batches: Batches, templates: dict[str, str], threshold: float) -> Batches:
    matcher = Matcher(templates, threshold)
    for batch in batches:
        rows, found = [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for kind, number, unit in units(text) if text else ():
                words = _WORDS.findall(unit.lower())
                best = matcher.best(words)
                if best:
                    rows.append(row)
                    found.append((kind, number, len(words), *best))
            for first, *window in matcher.windows(_WORDS.findall(text.lower())) if text else ():
                rows.append(row)
                found.append(("window", first, *window))
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        kinds = [pa.string(), *[pa.int32()] * 2, pa.string(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
            ],
            names=["doc_id", "unit", "unit_no", "n_words", "license", "dice", "n_bigrams"],
        )


def scan(
    docs: DataFrame, templates: Mapping[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """`doc_id`, `unit`, `unit_no`, `n_words`, `license`, `dice`, `n_bigrams` for every unit and every
    window of every text of `docs` that is like a template, with the one it is most like.

    A notice that has a line to itself is found as that line and as a window. `unit_no` counts lines or
    blocks; of a window it is the text's word that it starts with, from 0. Texts are compared in lower case, words only. Null and empty texts have no units, units and
    templates of fewer than two words have no bigrams. Repeated rows give repeated results; null ids
    are kept; other columns are ignored."""
    fields = [
        docs.schema["doc_id"],
        field("unit", T.StringType()),
        field("unit_no", T.IntegerType()),
        field("n_words", T.IntegerType()),
        field("license", T.StringType()),
        field("dice", T.DoubleType()),
        field("n_bigrams", T.IntegerType()),
    ]
    return map_batches(
        docs.where(F.col("text").isNotNull()).select("doc_id", "text"),
        _notice_batches,
        fields,
        templates=dict(TEMPLATES if templates is None else templates),
        threshold=threshold,
    )
