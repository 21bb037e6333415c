from __future__ import annotations

import zlib

import numpy as np
import pytest

from lakemeta.llm import toxicity as tox


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    common = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(common, rng.integers(5, 150)))
        label = int(i % 4 == 0)
        if label:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), "zorrg" + str(rng.choice(["", "ish", "er", "ed", "le"])))
        texts.append(" ".join(words).encode())
        labels.append(label)
    return texts, labels


def test_learns_from_words_and_characters():
    texts, labels = corpus()
    network = tox.train(texts, labels, updates=120)
    held, truth = corpus(120, seed=9)
    scores = tox.Scorer(network)(held)
    assert ((scores >= 0.7) == np.array(truth)).mean() > 0.95
    assert tox.Scorer(network)([b"quite zorrgable words here"])[0] > tox.Scorer(network)([b"quite plain words here"])[0]


def test_gradients():
    network = tox.Network.fresh({"a": 1, "b": 2})
    numbers = tox.Numbers()
    index = np.concatenate([tox.windows_of(tox.numbered_words(t, numbers)) for t in (b"a b c a", b"d", b"")])
    words = tox.Words.of(list(numbers), network.word_ids)
    target, weight = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        score = 1 / (1 + np.exp(-network.run(network.projected(words)[0], index).astype(np.float64)))
        return -np.mean(target * np.log(score) + (1 - target) * np.log(1 - score))

    gradients = network.gradients(index, words, target, weight)
    for name in network.p:
        flat, slope = network.p[name].reshape(-1), gradients[name].reshape(-1)
        at = int(np.argmax(np.abs(slope)))
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert slope[at] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 64, 65, 119, 500):
        windows = tox.windows_of(np.arange(n))
        assert set(windows.ravel()) - {-1} == set(range(n)) and windows.shape[1] == tox.WINDOW


def test_scored(spark, awkward, no_documents):
    texts, labels = corpus(160)
    rows = [(i, t.decode(), 1) for i, t in enumerate(texts)] + [(500, None, 2), (501, "", 3), (None, "w1 w2", 4), (3, texts[3].decode(), 1)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score INT")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (7, None)], "doc_id BIGINT, toxic INT")
    found = tox.scored(docs, known).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        name = "" if r.row.doc_id is None else str(r.row.doc_id)
        assert r.held_out == (zlib.crc32(name.encode()) % 3 == 1)
    unseen = {i for i, _ in enumerate(labels) if zlib.crc32(str(i).encode()) % 3 == 1}
    flipped = known.withColumn("toxic", (known.toxic + known.doc_id.isin(*unseen).cast("int")) % 2)
    again = {r.row.doc_id: r.score for r in tox.scored(docs, flipped).collect()}
    assert all(again[r.row.doc_id] == r.score for r in found)
    dealt = tox.scored(docs.repartition(7).union(docs.limit(40)), known).collect()
    by_text = {}
    for r in found + dealt:
        by_text.setdefault(r.row.text or "", set()).add((r.score, r.predicted))
    assert all(len(scores) == 1 for scores in by_text.values())
    assert {r.score for r in tox.scored(awkward, known.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in tox.scored(awkward, known.limit(0)).collect()} == {0.0}
    assert tox.scored(no_documents, known).count() == 0


def test_the_driver_does_not_train(spark, monkeypatch):
    def here(*_):
        raise AssertionError("trained in the driver")
    monkeypatch.setattr(tox, "train", here)
    texts, labels = corpus(160)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, toxic INT")
    scores = {r.row.doc_id: r.score for r in tox.scored(docs, known).collect()}
    assert len(set(scores.values())) > 1
