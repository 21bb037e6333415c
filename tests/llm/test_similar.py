"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import uuid
from fractions import Fraction

import pytest

import corpus_pipeline
from lakemeta.llm import components as components_of
from lakemeta.llm import similar
from lakemeta.llm.common import documents

from .conftest import awkward_texts


def shingles_of(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def alike_groups(texts):
    """Distinct texts by component of the pairs with a similarity of 0.8 or more."""
    texts = sorted({t or "" for t in texts})
    sets, root = [shingles_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a | sets[j])
            if not both or Fraction(len(a & sets[j]), both) >= Fraction(4, 5):
                root[find(i)] = find(j)
    out = {}
    for i, t in enumerate(texts):
        out.setdefault(find(i), set()).add(t)
    return set(map(frozenset, out.values()))


def near_copies():
    """Texts with one to a twentieth of their words changed, a chain, a hot passage in unlike texts, short texts."""
    rng, texts = random.Random(5), []
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for size in (6, 30, 100, 300, 1000):
        for _ in range(8):
            base = words(size)
            texts.append(" ".join(base))
            for changes in (1, 1, max(1, size // 60), max(1, size // 45), max(1, size // 30), size // 20):
                copy = list(base)
                for at in rng.sample(range(size), changes):
                    copy[at] = words(1)[0]
                texts.append(" ".join(copy).title() if rng.random() < 0.2 else " ".join(copy))
    base = words(200)
    chain = base + words(300)
    texts += [" ".join(chain[i:i + 200]) for i in range(0, 300, 15)]
    hot = words(60)
    texts += [" ".join(hot + words(rng.randrange(5, 30))) for _ in range(60)]
    return texts + ["a b", "A  b", "a b c", "", " ", "x"] + ["a b c d e f"] * 5


@pytest.mark.parametrize("most_bits", [28, 10])
def test_stage_against_brute_force(spark, most_bits):
    texts = near_copies() + [t for _, t in awkward_texts()[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(5)
    want = alike_groups(texts)
    found = {}
    for r in similar.similar(docs, most_bits=most_bits).collect():
        found.setdefault(r.component_id, set()).add(texts[r.doc_id] or "")
        assert r.component_id <= r.doc_id
    assert set(map(frozenset, found.values())) == want
    if most_bits == 28:
        left = corpus_pipeline.without_near_duplicates(spark, docs, "")
        first = {g: min(i for i, t in enumerate(texts) if (t or "") in g) for g in want}
        assert sorted(r.doc_id for r in left.collect()) == sorted(first.values())


def test_a_dense_group_takes_few_candidates(spark, monkeypatch):
    rng, tried = random.Random(6), []
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(400)] = f"c{k}"
        texts.append(" ".join(copy))
    alike = similar.alike
    monkeypatch.setattr(similar, "alike", lambda pairs, *a: tried.append(pairs.distinct().count()) or alike(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    assert {r.component_id for r in similar.similar(docs).collect()} == {0}
    assert sum(tried) < 300 * 40


def test_stage_on_the_smallest_tables(spark, sf_dir):
    docs = documents(spark, sf_dir)
    left = corpus_pipeline.without_near_duplicates(spark, docs, sf_dir)
    assert left.columns == docs.columns and left.count() == len(alike_groups([r.text for r in docs.collect()]))


def test_rows_without_ids_and_no_rows(awkward, no_documents):
    left = similar.without_similar(awkward)
    assert left.columns == awkward.columns and left.count() == len(alike_groups([t for _, t in awkward_texts()]))
    assert similar.without_similar(no_documents).count() == similar.similar(no_documents).count() == 0


def test_a_large_group_that_is_not_all_alike(spark, monkeypatch):
    monkeypatch.setattr(similar, "_BLOCK", 20)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((2, 3, 4))):
            copy[at] = f"x{rng.randrange(3)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    assert similar.without_similar(docs).count() == len(alike_groups(texts))


def test_fingerprints_come_first(spark, monkeypatch):
    rng, texts = random.Random(9), []
    for k in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        texts.append(" ".join(base))
        for change in range(4):
            texts.append(" ".join([*base[:change * 9], f"x{k}", *base[change * 9 + 1:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    sets = similar.shingled(docs, "doc_id", "text", 5, similar.LEAST, 20).select("fp", "shingles").localCheckpoint()
    lists = {r.fp: set(r.shingles) for r in sets.collect()}
    linked = similar.fingerprint_links(sets, similar.LEAST).collect()
    assert linked and all(len(lists[r.u] & lists[r.v]) >= 0.8 * len(lists[r.u] | lists[r.v]) for r in linked)
    keys = similar.prefix_keys
    monkeypatch.setattr(similar, "prefix_keys", lambda *a: keys(*a).limit(0))
    left = corpus_pipeline.without_near_duplicates(spark, docs, "").count()
    assert 10 <= left < len(texts)
    monkeypatch.undo()
    assert corpus_pipeline.without_near_duplicates(spark, docs, "").count() == 10


def test_rounds_over_few_links_write_few_files(spark, monkeypatch):
    settings, files = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []
    saved = components_of.saved

    def counting(df, name):
        out = saved(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(components_of, "saved", counting)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = spark.range(600).selectExpr("id AS u", "id + 1 + 599 * CAST(id % 200 = 199 AS BIGINT) AS v")
        found = {r.node: r.root for r in components_of.components(links).collect()}
        few, _ = files[1:], files.clear()
        monkeypatch.setattr(components_of, "_ROWS", 100)
        again = {r.node: r.root for r in components_of.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: i // 200 * 200 for i in range(600)} | {i + 600: i // 200 * 200 for i in (199, 399, 599)}
    assert found == again == want
    assert len(few) > 4 and all(n == 1 for _, n in few) and max(n for _, n in files[1:]) > 1


def test_lists_of_hashes_go_when_they_are_read(spark, monkeypatch, tmp_path):
    """What lists shingles takes as much as the texts; of it, and of replaced keys, only empty folders are left."""
    monkeypatch.setattr("lakemeta.llm.common.run_dir", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    texts = [" ".join(f"w{(i // 3 * 1000 + j) if j else i}" for j in range(40)) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, texts[0])], "doc_id BIGINT, text STRING")
    found = similar.similar(docs)
    rows = {name: sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob(f"{name}-*")) for name in ("shingled", "sets", "keys")}
    assert rows == {"shingled": 0, "sets": 0, "keys": 0}
    assert found.select("component_id").distinct().count() == 20
    assert similar.without_similar(docs).count() == 20
