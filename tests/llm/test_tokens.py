"""BPE and token counts against the library itself."""

from __future__ import annotations

import hashlib
import random

import pytest

from lakemeta.llm import bpe, token_counts

from .conftest import awkward_texts

ODD = [(20, "It's we'll <|endoftext|>x<|startoftext|> y"), (21, "é ́a İ ſ ß Σας"), (22, "\x00 \x1c\x1d a\x1cb \x85"),
       (23, "a b 　x"), (24, "日本語 😀 👍🏽 ﬁ"), (25, "​ ﻿")]


@pytest.fixture
def rows():
    return awkward_texts() + ODD


@pytest.fixture
def texts(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id BIGINT, text STRING, chunk INT")


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 24])
def test_round_trip(texts, rows, chunk_bytes):
    library = bpe.tokenizer(bpe.WORD_BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append(repr((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))))
    found = bpe.coded(texts, digests=True, chunk_bytes=chunk_bytes).collect()
    assert sorted(repr((r.row.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in found) == sorted(want)


def test_ids_and_texts(texts):
    found = bpe.coded(texts)
    assert found.select("row.*").columns == texts.columns
    rows = [r for r in found.collect() if r.row.doc_id is not None]
    decoded = {r.doc_id: r.decoded for r in bpe.decode(found.select("row.doc_id", "ids")).collect()}
    assert all(decoded[r.row.doc_id] == r.decoded and len(r.ids) == r.n_tokens for r in rows)
    assert bpe.coded(texts.limit(0)).count() == 0


def expected_counts(rows):
    library = bpe.tokenizer(token_counts.BYTE_BPE)
    return sorted(repr((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)


@pytest.mark.parametrize("chunk, overlap", [(120, 40), (1 << 16, 1 << 11)])
def test_counts(texts, rows, monkeypatch, chunk, overlap):
    monkeypatch.setattr(token_counts, "_MARGIN", 16)
    found = token_counts.token_counts(texts, chunk=chunk, overlap=overlap).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in found) == expected_counts(rows)


def test_counts_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "_MARGIN", 16)
    rng = random.Random(5)
    pieces = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", "é", "日", "<|endoftext|>", "<|endof", "text|>", "1", "23", "!", "?!",
              "\x85", "　", "\x1c", "​", "\t", "😀", " the", "ing "]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 500)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = token_counts.token_counts(docs, chunk=100, overlap=32).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in found) == expected_counts(rows)
    assert token_counts.token_counts(docs.limit(0)).count() == 0
