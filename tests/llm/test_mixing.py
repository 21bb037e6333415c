from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from lakemeta.llm.common import WORD
from lakemeta.llm.mixing import mixed, mixture


def expected_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= above


@pytest.fixture
def sources(spark):
    rows = [(i, "word " * (1 + (i * 7919) % 90), s) for i in range(600) for s in [["b", "a", None, "é", "tiny"][min(i % 7, 3 if i != 13 else 4)]]]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "same text", "a"), (1002, "same text", "a"), (None, "x y", None), (1003, "z " * 4000, "b")]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")


def test_targets_and_taken(sources):
    rows, docs = sources
    size = lambda t: len(re.findall(WORD, t or ""))
    by_source = Counter()
    for _, t, s in rows:
        by_source[s] += size(t)
    want = expected_targets(by_source)
    found = mixed(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(mixed(docs).collect()) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = r.source if r.doc_id is not None else None
        assert r.source_size == by_source[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
        largest[s] = max(largest[s], r.size)
    assert sum(want.values()) == pytest.approx(sum(by_source.values()))
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(2, 0.02 * target), (s, taken[s], target, largest[s])


def test_reruns_agree_and_the_mix_has_the_copies(sources):
    _, docs = sources
    first, again = (Counter((r.key, r.copies) for r in mixed(docs).collect()) for _ in range(2))
    assert first == again
    assert mixture(docs).count() == sum(c * n for (_, c), n in first.items())
    assert mixture(docs).columns == docs.columns


def test_empty_and_single(spark, no_documents, awkward):
    assert mixed(no_documents).count() == mixture(no_documents).count() == 0
    assert {r.copies for r in mixed(spark.createDataFrame([(1, "a b", "s")], "doc_id BIGINT, text STRING, source STRING")).collect()} == {1}
    assert mixed(awkward).count() == awkward.count()
