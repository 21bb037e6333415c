from __future__ import annotations

import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lakemeta.llm import suffix_tree_lm
from lakemeta.llm.suffix_tree_lm import held_out, op12_suffix_tree_lm, suffix_tree_scores

LONGEST, SHARE, PSEUDO = 2, 1e-3, 5.0


def spoken(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())] + [None]


class SlowTree:
    """The same tree from dictionaries, one token at a time."""

    def __init__(self, texts, longest, share, pseudo):
        runs = Counter()
        for words in texts:
            for k in range(1, longest + 2):
                runs.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        self.words = Counter({r[0]: n for r, n in runs.items() if len(r) == 1})
        self.total, self.distinct = sum(self.words.values()), len(self.words)
        least = max(2, share * self.total)
        self.kept = {r: n for r, n in runs.items() if n >= least}
        self.entries, self.rest = {}, {}
        for k in range(1, longest + 1):
            after = {}
            for r in self.kept:
                if len(r) == k + 1:
                    after.setdefault(r[:-1], []).append(r[-1])
            for context, nexts in after.items():
                n = self.kept[context]
                shorter = {w: self.chance(context[1:], w) for w in nexts}
                own = {w: (self.kept[(*context, w)] + pseudo * shorter[w]) / (n + pseudo) for w in nexts}
                left, left_shorter = 1 - sum(own.values()), 1 - sum(shorter.values())
                divergence = sum(p * math.log(p / shorter[w]) for w, p in own.items()) + left * math.log(left / left_shorter)
                if n * divergence > 0.5 * math.log(n) * (len(nexts) + 1):
                    self.entries[context], self.rest[context] = own, left / left_shorter

    def chance(self, context, word):
        if not context:
            return (self.words[word] + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        if context not in self.entries:
            return self.chance(context[1:], word)
        known = self.entries[context].get(word)
        return known if known is not None else self.rest[context] * self.chance(context[1:], word)

    def score(self, words, longest):
        return sum(math.log10(self.chance(tuple(words[max(0, i - longest):i]), w)) for i, w in enumerate(words))


def corpus(n=120):
    """Sentences with habits: words depend on one word before, some on two or three."""
    rng, out = random.Random(4), []
    for i in range(n):
        words = ["a", "b"]
        while len(words) < 60:
            after = {"a": "bc", "b": "ad", "c": "ab"}.get(words[-1], "abcd")
            habit = {("a", "c"): "e"}.get(tuple(words[-2:])) or {("b", "d", "d"): "f"}.get(tuple(words[-3:]))
            words.append(habit if habit else rng.choice(after) if rng.random() < 0.9 else f"rare{rng.randrange(40)}")
        out.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    return out


def check(found, rows, tree, longest):
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    want = sorted(((-1 if i is None else i), len(t), sum(tree.words[w] > 0 for w in t), tree.total,
                   sum(math.log10(tree.chance((), w)) for w in t), tree.score(t, longest)) for i, t in ((i, spoken(x)) for i, x in rows))
    assert len(found) == len(want)
    assert np.allclose(np.array(found, float), np.array(want, float), rtol=1e-9, atol=1e-6)


def test_equals_the_slow_tree(spark, awkward):
    rows = corpus() + [(r.doc_id, r.text) for r in awkward.collect()]
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id BIGINT, text STRING, n INT, value STRING")
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for longest, share in ((2, SHARE), (3, 2e-3), (1, SHARE)):
        tree = SlowTree([spoken(t) for i, t in rows if not out(i)], longest, share, PSEUDO)
        assert any(len(c) == longest for c in tree.entries)
        for parts in (1, 7):
            found = suffix_tree_scores(docs.repartition(parts), ~held_out(), longest=longest, share=share, pseudo=PSEUDO).collect()
            check(found, rows, tree, longest)


def test_a_state_is_a_distribution_and_pays(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_suffix_tree_lm(spark, str(tmp_path)).collect()
    unseen = [r for r in found if r.held_out]
    assert unseen and sum(r.score for r in unseen) > 0.8 * sum(r.base_score for r in unseen)
    assert {r.doc_id for r in unseen} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    tree = SlowTree([spoken(t) for _, t in rows], LONGEST, SHARE, PSEUDO)
    for context in [(), ("a",), ("a", "c"), ("zzz", "b")]:
        unknown = tree.chance(context, "never said")
        assert abs(sum(tree.chance(context, w) for w in tree.words) + unknown - 1) < 1e-9


def test_nothing_to_learn_from(spark, awkward, no_documents):
    assert suffix_tree_scores(no_documents, ~held_out()).count() == 0
    blind = suffix_tree_scores(awkward, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-6 for r in blind)


def test_rare_runs_count_in_a_large_corpus(spark):
    long = [(i, "a " * 70_000) for i in range(1000, 1040)]
    short = [(i, f"x{i // 2} y{i // 2} z{i // 2} a") for i in range(40)]
    docs = spark.createDataFrame(long + short, "doc_id BIGINT, text STRING")
    texts = [spoken(t) for i, t in long + short if zlib.crc32(str(i).encode()) % 10]
    tree = SlowTree(texts, LONGEST, 0, PSEUDO)
    assert 1e-6 * tree.total > 2 and ("x4",) in tree.entries
    check(suffix_tree_scores(docs, ~held_out()).filter("doc_id < 1000").collect(), short, tree, LONGEST)


def test_scores_do_not_depend_on_what_is_broadcast(spark, awkward, monkeypatch):
    rows = corpus() + [(r.doc_id, r.text) for r in awkward.collect()]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    tree = SlowTree([spoken(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10], LONGEST, 0, PSEUDO)
    for most in (0, 40, 1 << 20):
        monkeypatch.setattr(suffix_tree_lm, "_BROADCAST", most)
        check(suffix_tree_scores(docs, ~held_out()).collect(), rows, tree, LONGEST)


def test_only_the_weights_stay_on_disk(spark, monkeypatch, tmp_path):
    """What a step leaves behind, in folders or as shuffle files, adds up to several times the input."""
    monkeypatch.setattr("lakemeta.llm.common.run_dir", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    docs = spark.createDataFrame(corpus(), "doc_id BIGINT, text STRING")
    scores = suffix_tree_scores(docs, ~held_out())
    left = {p.name.split("-")[0]: spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()}
    assert left.pop("weights") > 40 and left and not any(left.values())
    assert scores.count() == 120
