from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemeta.llm import chat_tree as chat
from lakemeta.llm import topk_search as search


def conversations():
    text = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "oh"),
            (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", text), (4, 1, "assistant", text), (5, 0, None, None),
            (5, 1, "assistant", ""), (6, 1, "a:b\n#", "x\\h<"), (6, 1, "assistant", "tie"), (6, 1, "assistant", "tie"),
            (7, 0, "user", "hi"), (7, 1, "assistant", "yes"), (7, 2, "user", "long " * 5000), (None, 0, "user", "lost"), (8, None, "assistant", "é日")]
    return rows + [(100 + i, t, "user", "hi" if t == 0 else f"{i % 3} {t}") for i in range(30) for t in range(6)]


@pytest.fixture
def tree(spark):
    rows = [(*r, 1, "x") for r in conversations()]
    return chat.chat_tree(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, rank INT, leaf STRING"))


def expected_turns():
    out = {}
    for c, turn, role, text in sorted(conversations(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_read_back(tree):
    found = {r.conv_id: r for r in chat.read_back(tree).collect()}
    want = expected_turns()
    assert found.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in found[c].turns] == turns
        assert found[c].loss == "".join(t for r, t in turns if r == "assistant")


def test_shared_turns_are_written_once_depth_first(tree):
    nodes = sorted(tree.nodes.collect(), key=lambda n: n.start)
    prefixes = {tuple(turns[:k + 1]) for turns in expected_turns().values() for k in range(len(turns))}
    assert len(nodes) == len(prefixes)
    place = 0
    for n in nodes:
        assert n.start == place and n.tokens == len(n.ids)
        place += n.tokens
    depth = {bytes(n.node): n.depth for n in nodes}
    open_ = []
    for n in nodes:
        del open_[n.depth:]
        assert bytes(n.parent) == (open_[-1] if open_ else b"") and n.depth == (depth[bytes(n.parent)] + 1 if open_ else 0)
        open_.append(bytes(n.node))


def test_positions_and_attention(tree):
    nodes = {bytes(n.node): n for n in tree.nodes.collect()}
    for r in nodes.values():
        path, node = [], nodes[bytes(r.node)]
        while node is not None:
            path.append(node)
            node = nodes.get(bytes(node.parent))
        seen = {t for n in path for t in range(n.start, n.start + n.tokens)}
        assert {t for v in r.visible for t in range(v.begin, v.end)} == seen
        assert r.position == sum(n.tokens for n in path[1:])
        assert all(a.end < b.begin for a, b in zip(r.visible, r.visible[1:], strict=False))


def test_conversations_are_read_by_their_intervals(tree):
    """Without its intervals a conversation can't be read, whatever else the tree knows."""
    blind = chat.ChatTree(tree.nodes.withColumn("visible", F.slice("visible", 1, 1)), tree.members, tree.tokenizer)
    want = expected_turns()
    several = {bytes(n.node) for n in tree.nodes.filter("size(visible) > 1").collect()}
    leaves = {r.conv_id: bytes(r.leaf) for r in tree.members.collect()}
    cut = [c for c, leaf in leaves.items() if leaf in several]
    assert cut
    found = {r.conv_id: r for r in chat.read_back(blind).collect()}
    for c in leaves:
        assert ([(t.role, t.text) for t in found[c].turns] != want[c]) == (c in cut)


def test_each_turn_is_encoded_once(spark, monkeypatch):
    """The stream is ordered from what was encoded and written, so sorting it does not run the encoder again."""
    plans, keep = {}, chat.saved
    monkeypatch.setattr(chat, "saved", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or keep(df, name))
    chat.chat_tree(spark.createDataFrame(conversations(), "conv_id BIGINT, turn BIGINT, role STRING, text STRING"))
    assert "MapInArrow" in plans["encoded"] and "MapInArrow" not in plans["places"]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    assert chat.read_back(chat.chat_tree(empty)).count() == 0


def vectors():
    rng = np.random.default_rng(0)
    return ([(i, [float(x) for x in rng.integers(-3, 4, 6) / 256]) for i in range(300)]
            + [(i, [.5, .5, .5, .1, .1, .1]) for i in range(300, 520)]
            + [(601, None), (602, [1.0, float("nan")]), (603, [None, 1.0]), (650, [1.0]), (None, [9.0] * 6), (604, [float("inf")]),
               (3, [0.0] * 6), (605, []), (700, [2.0**20] * 6)])


def expected_top(rows, k=5):
    known = set()
    for i, e in rows:
        if i is not None and e is not None and not any(x is None or not math.isfinite(x) for x in e):
            known.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    out = []
    for q in known:
        if q[0] % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q[1], e, strict=False)), c) for c, e in known if (c, e) != q)
            out += [(q[0], n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("segments, rows, queries", [(2, 50, 3), (3, 8192, 2048)])
def test_top_k(spark, monkeypatch, segments, rows, queries):
    monkeypatch.setattr(search, "_ROWS", rows)
    monkeypatch.setattr(search, "_QUERIES", queries)
    table = spark.createDataFrame([(i, e, 1) for i, e in vectors()], "vec_id BIGINT, embedding ARRAY<FLOAT>, cid INT")
    assert sorted(tuple(r) for r in search.top_k(table, segments=segments).collect()) == expected_top(vectors())


def test_top_k_of_few(spark):
    for n in (0, 1, 3):
        rows = vectors()[:n]
        table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
        assert sorted(tuple(r) for r in search.top_k(table).collect()) == expected_top(rows)


def test_top_k_of_repeated_ids(spark):
    """Each vector of an id counts, an empty one too; query, SQL and brute force agree."""
    rows = [(1, [1.0, 1.0]), (1, [5.0, 5.0]), (2, []), (50, [1.0, 2.0]), (50, [-1.0, 0.5]), (50, [1.0, 2.0]), (0, []), (3, [0.0, 0.0]),
            (4, [5.0, 5.0]), (7, [5.0, 5.0]), (None, [9.0, 9.0]), (8, [None, 1.0]), (9, [float("nan")]), (1, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    found = sorted(tuple(r) for r in search.top_k(table).collect())
    assert found == expected_top(rows)
    with duckdb.connect() as con:
        con.register("embeddings", table.toArrow())
        assert sorted(con.execute(search.OP10_SQL).fetchall()) == found
