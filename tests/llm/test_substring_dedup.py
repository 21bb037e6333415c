"""Both substring operators against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lakemeta.llm import suffix_dedup as suffix
from lakemeta.llm.repeats import laid_out
from lakemeta.llm.suffix_dedup import difference_cover, suffix_dedup
from lakemeta.llm.window_dedup import window_dedup

from .conftest import awkward_texts


def brute(sequences: list, window: int) -> list[list[bool]]:
    seen = Counter(tuple(s[i:i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def words_expected(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    for (i, _), words, gone in zip(rows, split, brute(split, window), strict=True):
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        yield repr((i, len(words), sum(gone), kept))


def bytes_expected(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), text, gone in zip(rows, raw, brute(raw, length), strict=True):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield repr((i, len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone, strict=True) if not g)))


@pytest.mark.parametrize("window, gram", [(35, 8), (12, 3), (5, 5)])
def test_windows(awkward, window, gram):
    found = [repr((r.row.doc_id, r.n_words, r.n_removed, r.kept)) for r in window_dedup(awkward, window=window, gram=gram).collect()]
    assert sorted(found) == sorted(words_expected(awkward_texts(), window))


@pytest.mark.parametrize("length, gram, part", [(200, 32, 4096), (200, 32, 2), (40, 8, 1), (9, 9, 3)])
def test_suffixes(awkward, monkeypatch, length, gram, part):
    monkeypatch.setattr(suffix, "_PART", part)
    found = [repr((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
             for r in suffix_dedup(awkward, length=length, gram=gram).collect()]
    assert sorted(found) == sorted(bytes_expected(awkward_texts(), length))


def test_many_texts_around_one_passage(spark, monkeypatch):
    """One bucket of many different texts, in parts and whole."""
    rng = random.Random(1)
    passage = bytes(rng.choices(b"abcdef ", k=300)).decode()
    rows = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 150))) + passage + "".join(rng.choices("abcdefgh ", k=80)))
            for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for part in (4096, 7):
        monkeypatch.setattr(suffix, "_PART", part)
        found = [repr((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffix_dedup(docs).collect()]
        assert sorted(found) == sorted(bytes_expected(rows, 200))


def test_a_saturated_sketch_changes_nothing(awkward, monkeypatch):
    from lakemeta.llm import repeats
    monkeypatch.setattr(repeats, "sketch_bits", lambda *_: 15)
    found = [repr((r.row.doc_id, r.n_words, r.n_removed, r.kept)) for r in window_dedup(awkward, window=12, gram=3).collect()]
    assert sorted(found) == sorted(words_expected(awkward_texts(), 12))


@pytest.mark.parametrize("length", [2, 9, 40, 200])
def test_difference_cover(length):
    v, held, shift = difference_cover(length)
    assert 2 * v <= length
    for a in range(v):
        for b in range(v):
            assert held[(a + shift[a, b]) % v] and held[(b + shift[a, b]) % v]


def test_rows_keep_their_columns(awkward, no_documents):
    assert window_dedup(awkward).select("row.*").columns == awkward.columns
    assert suffix_dedup(awkward).select("row.*").columns == awkward.columns
    assert window_dedup(no_documents).count() == suffix_dedup(no_documents).count() == 0


def test_sketch_cells_are_shuffled_once(spark):
    """One exchange, by chunk, whatever the number of shuffle partitions; each chunk's bits are laid out in one place."""
    hits = np.arange(200_000) * 7 % 150_000
    rows = [(int(c), part[part >> 15 == c].astype(np.uint16).__and__(32767).tobytes())
            for part in np.array_split(hits, 3) for c in np.unique(part >> 15)]
    out = laid_out(spark.createDataFrame(rows, "chunk INT, cells BINARY"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(chunk" in plan
    found = {r.chunk: r.bits for r in out.collect()}
    bits = np.unpackbits(np.frombuffer(b"".join(found[k] for k in sorted(found)), np.uint8), bitorder="little")
    assert np.array_equal(bits.astype(bool), np.bincount(hits, minlength=len(bits)) >= 2)
