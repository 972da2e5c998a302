from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roomtide.llm import bpe, queries
from roomtide.llm.queries import bpe_digests
from tests.llm.cases import awkward, documents, prose, sorted_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    reference = Tokenizer.from_file(PATH)
    reference.no_padding()
    reference.no_truncation()
    return reference


def expected(library, text: str | None) -> tuple[list[int], str]:
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def same(library, text: str | None) -> None:
    model = bpe.tokenizer(PATH)
    ids = model.encode(text)
    assert (ids.tolist(), model.decode(ids)) == expected(library, text), repr(text)


def test_random_texts(library):
    draw = random.Random(3)
    letters = [*"aAbB'stredm \n\t.,!<|>éÉß1٣ΣσΑ日本\u0301🙂\x00\x85\u00a0\u1680", "<|endoftext|>"]
    letters += ["<|startoftext|>", "'LL", "'ve", "thing", "İ", "ﬁ", "e\u0301", "\u212a"]
    for _ in range(3000):
        same(library, "".join(draw.choice(letters) for _ in range(draw.randint(0, 40))))


def test_every_assigned_letter_of_the_first_planes(library):
    for code in [*range(0x558), *range(0x1E00, 0x2000), *range(0x3000, 0x3400), 0x1F600]:
        same(library, f"a{chr(code)}b {chr(code)}{chr(code)}'s")


def test_long_words_and_texts_of_many_pieces(library, monkeypatch):
    same(library, "ab" * 3000 + " " + "the" * 2000)
    monkeypatch.setattr(bpe, "_PIECE_CHARS", 50)
    same(library, prose(1, 2000).replace(" ", "\n", 99) + " <|endoftext|> x")


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 4)
    model = bpe.WordTokenizer(PATH)
    text = prose(5, 500)
    assert model.encode(text).tolist() == expected(library, text)[0]


def test_cuts_are_where_no_token_joins():
    model = bpe.tokenizer(PATH)
    fragments = model.cut("qzxqthing")
    assert "".join(fragments) == "qzxqthing" and len(fragments) > 1
    assert model.cut("thing") == ["thing"]


def test_awkward_rows(spark, library):
    rows = awkward()
    encoded = bpe.encode_documents(documents(spark, rows), PATH)
    found = [(r.doc_id, r.ids, r.decoded) for r in encoded.collect()]
    assert sorted_rows(found) == sorted_rows([(i, *expected(library, t)) for i, t in rows])
    digests = {r.doc_id: r for r in bpe_digests(encoded).collect()}
    assert digests[1].n_tokens == 0
    assert digests[1].ids_sha256 == digests[1].decoded_sha256 == hashlib.sha256().hexdigest()
    ids, text = expected(library, dict(rows)[5])
    assert digests[5].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digests[5].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_documents(documents(spark, []), PATH).collect() == []


def test_given_table_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    results = []
    for row in docs:
        ids, decoded = expected(library, row.text)
        texts = " ".join(map(str, ids)), decoded
        results.append((row.doc_id, len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    assert sorted_rows(queries.op6_bpe(spark, sf).collect()) == sorted_rows(results)
