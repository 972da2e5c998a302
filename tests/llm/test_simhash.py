from __future__ import annotations

import re
from itertools import combinations

import pytest
import xxhash

from roomtide.llm import queries, simhash
from roomtide.llm.components import connected_components
from tests.llm.cases import awkward, documents, prose, sorted_rows


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows: list[tuple[int | None, str | None]]) -> tuple[list[int], list[int]]:
    """Fingerprint and group number of every row, from all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            group[find(i)] = find(j)
    return prints, [find(i) for i in range(len(rows))]


def plain_components(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    prints, groups = plain_groups(rows)
    members: dict[int, list[int]] = {}
    for group, (doc_id, _) in zip(groups, rows, strict=True):
        members.setdefault(group, []).extend([] if doc_id is None else [doc_id])
    smallest = {g: min(ids, default=None) for g, ids in members.items()}
    return [
        (doc_id, f"{p:016x}", smallest[g])
        for (doc_id, _), p, g in zip(rows, prints, groups, strict=True)
    ]


def near_copies(base: str, n: int) -> list[str]:
    """Copies of a text with one word changed each: most differ in few bits."""
    words = base.split()
    return [" ".join([*words[:k], f"changed{k}", *words[k + 1 :]]) for k in range(n)]


def result(spark, rows):
    found = simhash.near_duplicates(documents(spark, rows))
    return found.select("doc_id", "fingerprint", "component_id").collect()


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in combinations(range(64), radius):
        differing = sum(1 << b for b in bits)
        assert any(not mask & differing for mask in masks)


@pytest.mark.parametrize("text", [t for _, t in awkward()])
def test_fingerprints(text):
    assert simhash.simhash(text.encode() if text else None) == plain_fingerprint(text)


def test_awkward_rows_against_all_pairs(spark):
    assert sorted_rows(result(spark, awkward())) == sorted_rows(plain_components(awkward()))


def test_groups_of_copies_against_all_pairs(spark):
    texts = near_copies(prose(11, 900), 250) + near_copies(prose(12, 400), 80)
    texts += [prose(13, 40)] * 60 + [prose(k, 50) for k in range(100, 160)]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)]
    expected = plain_components(rows)
    assert sorted_rows(result(spark, rows)) == sorted_rows(expected)
    sizes = [sum(c == component for *_, c in expected) for component in {c for *_, c in expected}]
    assert max(sizes) > 60 and 1 in sizes


def test_links_join_what_is_within_two_bits_and_nothing_else(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1, base ^ (1 << 63), base ^ 0b11, base ^ 0b111000, 0, 1 << 63, 0b11 << 20]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint")
    links = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    roots = {r.node: r.root for r in connected_components(simhash.links(frame)).collect()}
    for a, b in combinations(signed, 2):
        linked = roots.get(a, a) == roots.get(b, b)
        reached = plain_linked(signed, a, b)
        assert linked == reached


def plain_linked(prints: list[int], a: int, b: int) -> bool:
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for y in prints:
            if y not in seen and ((x ^ y) % (1 << 64)).bit_count() <= 2:
                seen.add(y)
                todo.append(y)
    return b in seen


def test_long_chain_is_one_component(spark):
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    roots = connected_components(chain).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 201


def test_empty_table(spark):
    assert result(spark, []) == []


def test_given_table_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op3_simhash(spark, sf).select("doc_id", "fingerprint", "component_id")
    assert sorted_rows(found.collect()) == sorted_rows(plain_components([tuple(r) for r in docs]))
