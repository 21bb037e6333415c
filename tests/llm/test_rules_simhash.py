from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lakemeta.llm import simhash
from lakemeta.llm.components import components
from lakemeta.llm.quality_rules import POLICIES, RULES, ablation, apply_policy, bit, judged, ledger, mask

from .conftest import awkward_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MESSY = [(30, "a\na\n\nb\n a\na"), (31, "#x $y <z> |"), (32, "one two three four five six seven eight " * 2), (33, "r " * 50)]


def expected_rules(text):
    words = WORDS.findall(text or "")
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines))


def test_ledger(spark, awkward, no_documents):
    rows = awkward_texts() + MESSY
    found = ledger(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    assert sorted(repr((r.doc_id, *(r[n] for n in names))) for r in found) == sorted(repr((i, *expected_rules(t))) for i, t in rows)
    for r in found:
        assert bool(r.failures & bit("few_words")) == (r.n_words < 20)
        assert bool(r.failures & bit("repeats")) == (100 * r.n_repeat_words > 30 * r.n_words)
    assert ledger(awkward).count() == awkward.count() and ledger(no_documents).count() == 0


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(i, i % 32) for i in range(320)], "doc_id BIGINT, failures INT")
    assert apply_policy(rows, 1).filter("kept").count() == sum(i % 32 & 3 == 0 for i in range(320))
    found = {r.rule: r for r in ablation(rows, 2).collect()}
    for rule in RULES:
        b = bit(rule)
        assert found[rule].failed == sum(bool(i % 32 & b) for i in range(320))
        assert found[rule].failed_alone == 10 and found[rule].kept_without == 20


def test_judged_from_a_ledger_written_once(spark, awkward, no_documents, capsys):
    """Ablation and both policies over the bits of real texts, without reading these again."""
    rows = spark.createDataFrame(awkward_texts() + MESSY, "doc_id BIGINT, text STRING")
    bits = [r.failures for r in ledger(rows).collect()]
    found = judged(rows, 1, 2)
    for r in found.collect():
        assert r.base_failed == bool(r.failures & mask(1)) and r.kept == (r.failures == 0)
        sole = [rule for rule in POLICIES[2] if r.failures == bit(rule)]
        assert r.sole_rule == (sole[0] if sole else None)
        assert r.kept_without == (sum(b in (0, r.failures) for b in bits) if sole else None)
    assert found.filter("sole_rule IS NOT NULL").count() > 0 and found.filter("kept").count() > 0
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "ledger-" in plan and "text" not in plan and "Python" not in plan and "ExistingRDD" not in plan
    assert judged(awkward, 1, 2).count() == awkward.count() and judged(no_documents, 1, 2).count() == 0


def test_no_python_in_the_ledger(awkward, capsys):
    ledger(awkward).explain("extended")
    assert "Python" not in capsys.readouterr().out


def bits_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values: list[int]) -> set[frozenset]:
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    fps = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2):
            root[find(i + 1 + int(j))] = find(i)
    out = {}
    for i, v in enumerate(values):
        out.setdefault(find(i), set()).add(v)
    return set(map(frozenset, out.values()))


def test_near_duplicates(awkward, no_documents):
    rows = awkward_texts()
    found = simhash.near_duplicates(awkward).collect()
    assert sorted(repr((r.doc_id, r.fp % 2**64)) for r in found) == sorted(repr((i, bits_of(t))) for i, t in rows)
    by_component = {}
    for r in found:
        if r.component_id is not None:  # rows without an id can be several components
            by_component.setdefault(r.component_id, set()).add(r.fp % 2**64)
        assert r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id
    together = groups(sorted({bits_of(t) for _, t in rows}))
    for fps in by_component.values():
        assert any(fps <= g for g in together)
    left = simhash.deduplicated(awkward)
    assert left.columns == awkward.columns and left.count() == len(together)
    assert simhash.near_duplicates(no_documents).count() == simhash.deduplicated(no_documents).count() == 0


@pytest.mark.parametrize("lookup", [4, 1024])
def test_links_of_a_dense_group(spark, monkeypatch, lookup):
    monkeypatch.setattr(simhash, "_LOOKUP", lookup)
    rng = np.random.default_rng(1)
    base, fps = int(rng.integers(2**63)), set()
    for _ in range(400):
        value = base
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            value ^= 1 << int(b)
        fps.add(value)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp BIGINT")
    root = {r.node: r.root for r in components(simhash.links(table)).collect()}
    found = {}
    for x in fps:
        found.setdefault(root.get(signed(x), signed(x)), set()).add(x)
    assert set(map(frozenset, found.values())) == groups(sorted(fps))


def test_every_close_pair_shares_a_key_and_passes_its_budgets():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        starts = np.arange(8, dtype=np.uint64)
        assert simhash.within_budgets(np.full(8, a, np.uint64), np.full(8, b, np.uint64), starts).any()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    root = {r.node: r.root for r in components(spark.createDataFrame(links, "u BIGINT, v BIGINT")).collect()}
    assert {root[i] for i in range(301)} == {0} and {root[1000 + i] for i in range(200)} == {1000}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0
