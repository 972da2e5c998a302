from __future__ import annotations

import re

import pytest

from roomtide.llm import licenses
from tests.llm.cases import awkward, documents, prose, sorted_rows


def words_of(text):
    return re.findall(licenses.WORD, text.lower())


def pairs(words):
    return set(zip(words, words[1:], strict=False))


def plain_windows(text, templates, threshold):
    """The best window of every start and template, most shared bigrams first, each kept if it
    shares no word with one kept."""
    words, candidates = words_of(text), []
    for name, template in templates.items():
        t_words = words_of(template)
        wanted = pairs(t_words)
        for first in range(len(words) - 1):
            if (words[first], words[first + 1]) not in wanted:
                continue
            left = len(words) - first
            longest = int((len(t_words) - 1) * (2 - threshold) / threshold + 1e-9) + 1
            lengths = []
            for n in range(min(len(t_words), left), min(longest, left) + 1):
                a = pairs(words[first : first + n])
                dice = 2.0 * len(a & wanted) / (len(a) + len(wanted))
                if dice >= threshold:
                    lengths.append((-dice, n, len(a), len(a & wanted)))
            if lengths:
                minus, n, size, common = min(lengths)
                candidates.append((-common, minus, first, n, name, size))
    kept = []
    for _, minus, first, n, name, size in sorted(candidates):
        if all(first >= f + m or first + n <= f for f, m, *_ in kept):
            kept.append((first, n, name, -minus, size))
    return kept


def plain_units(text):
    """Lines, blocks and text, line by line."""
    lines = text.split("\n")
    blocks, blank = [[]], False
    for k, line in enumerate(lines):
        if 0 < k < len(lines) - 1 and not line.strip(" \t\n\x0b\x0c\r"):
            blank = True
            continue
        if blank:
            blocks.append([])
            blank = False
        blocks[-1].append(line)
    units = [("line", k, line) for k, line in enumerate(lines)]
    units += [("block", k, "\n".join(b)) for k, b in enumerate(blocks) if len(b) > 1]
    return units + ([("text", 0, text)] if len(blocks) > 1 else [])


def plain_scan(rows, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    results = []
    for doc_id, text in rows:
        for kind, number, unit in plain_units(text) if text else []:
            a = pairs(words_of(unit))
            scored = [
                (-2.0 * len(a & pairs(words_of(t))) / (len(a) + len(pairs(words_of(t)))), name)
                for name, t in templates.items()
                if a and pairs(words_of(t))
            ]
            if scored and -min(scored)[0] >= threshold:
                dice, name = min(scored)
                results.append((doc_id, kind, number, len(words_of(unit)), name, -dice, len(a)))
        for first, *window in plain_windows(text or "", templates, threshold):
            results.append((doc_id, "window", first, *window))
    return results


def test_against_all_templates(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    rows = [
        *awkward(),
        (20, "x\nLicensed under the Apache License, Version 2.0.\nEnd"),
        (20, "x\nLicensed under the Apache License, Version 2.0.\nEnd"),
        (21, f"{prose(1, 20)}\n\n{wrapped}\n\n{prose(2, 30)}"),
        (22, wrapped.upper()),
        (23, "licensed under CC-BY-NC 4.0!"),
        (24, "Licensed under CC BY 3.0."),
        (25, mit.replace("hereby", "now").replace("sublicense", "sell")),
        (None, "This work is licensed under the GNU General Public License, version 2."),
        (26, " ".join(mit.split()[:30])),
        (27, f"{prose(3, 9)}\r\n \t\r\n" + wrapped.replace("\n", "\r\n") + "\r\n\r\nend\r\n"),
        (28, f"{prose(4, 30)} {' '.join(mit.split()[2:])} {prose(9, 2)} {mit} {prose(5, 40)}"),
        (32, f"{prose(4, 30)} {' '.join(mit.split()[2:])} {mit} {prose(5, 40)}"),
        (29, f"/* {wrapped} */\nint main() {{}}\n{prose(6, 90)}"),
        (30, "the license " * 2_000),
        (31, "\n\n  \nReleased under\nthe MIT License.\n\n"),
    ]
    found = licenses.scan(documents(spark, rows)).collect()
    expected = plain_scan(rows)
    assert sorted_rows(found) == sorted_rows(expected)
    assert {r[4] for r in expected} >= {"Apache-2.0", "MIT-text", "CC-BY-NC-4.0", "GPL-2.0"}
    assert [r[4] for r in expected if r[0] == 28 and r[1] == "window"] == ["MIT-text"] * 2
    # A shortened copy right before another needs two of its words: only the better one is a row.
    assert [r[4] for r in expected if r[0] == 32 and r[1] == "window"] == ["MIT-text"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This project is released under the MIT License.", {(3, "MIT")}),
        (
            "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0.",
            {(4, "Apache-2.0")},
        ),
        (
            "See below. Licensed under the\nApache License, Version 2.0. Released under the MIT License.",
            {(2, "Apache-2.0"), (9, "MIT")},
        ),
        ("Prose here, licensed under CC BY 3.0 or later, and more of it.", set()),
        ("The text is licensed under CC BY-NC 4.0 since last year.", {(3, "CC-BY-NC-4.0")}),
    ],
)
def test_notices_beside_other_words(spark, text, expected):
    found = licenses.scan(documents(spark, [(1, text)])).collect()
    assert {(r["unit_no"], r["license"]) for r in found if r["unit"] == "window"} == expected


def test_header_in_its_usual_paragraphs_before_code(spark):
    header = licenses.TEMPLATES["Apache-2.0-header"]
    parts = re.split(r" (?=You may obtain|http|Unless)", header.replace("specific", "exact"))
    text = "# Copyright 2020\r\n# " + "\r\n#\r\n# ".join(parts) + "\r\nimport os\r\n" + prose(1, 500)
    found = licenses.scan(documents(spark, [(1, text)])).collect()
    assert [(r["unit"], r["license"]) for r in found] == [("window", "Apache-2.0-header")]
    assert found[0]["n_words"] == len(words_of(header)) and found[0]["dice"] < 1


def test_pruning_loses_nothing_at_other_thresholds(spark):
    rows = [(k, " ".join(t.split()[k % 5 :])) for k, t in enumerate(licenses.TEMPLATES.values())]
    for threshold in (0.3, 0.5, 0.95, 1.0):
        found = licenses.scan(documents(spark, rows), threshold=threshold).collect()
        assert sorted_rows(found) == sorted_rows(plain_scan(rows, threshold=threshold))


def test_no_templates_and_no_documents(spark):
    assert licenses.scan(documents(spark, awkward()), templates={"x": "word"}).collect() == []
    assert licenses.scan(documents(spark, [])).collect() == []
