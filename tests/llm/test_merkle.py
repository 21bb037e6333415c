from __future__ import annotations

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from lakemeta.llm import merkle
from lakemeta.llm.merkle import audit, manifest, op13_merkle_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[c] if c != "n_chars" or row[c] is None else row[c] + more for c in FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    """Per level: what stands beside the node, and whether before it."""
    out = []
    for nodes in tree[:-1]:
        beside = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
        out.append((beside, at & 1))
        at >>= 1
    return out


def expected(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([leaf(r) for r in groups[k]]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    for place, k in enumerate(order):
        for at, row in enumerate(groups[k]):
            hit = row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            now, path = leaf(row, int(hit)), way(trees[k], at) + way(top, place)
            for beside, before in path:
                now = digest(beside, now) if before else digest(now, beside)
            yield (row["doc_id"], leaf(row), trees[k][-1][0], top[-1][0], digest(*[b for b, _ in path]), now, now == top[-1][0])


def written(spark, rows, folder):
    schema = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING, tree STRING, `a.b` INT, extra MAP<STRING, INT>"
    data = [tuple(r[c] for c in FIELDS) + ("x", 1, {"k": 1}) for r in rows]
    spark.createDataFrame(data, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def compared(spark, rows, folder):
    found = op13_merkle_manifest(spark, written(spark, rows, folder)).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_equals_trees_built_by_hand(spark, tmp_path):
    """More leaves than a record has, a lone leaf, null and empty groups, null and repeated ids, equal rows, nulls everywhere."""
    row = lambda i, lang="en", **more: dict(doc_id=i, source="s", lang=lang, n_chars=i, text=f"é{i}") | more
    rows = [row(i) for i in range(2600)] + [row(i, "日本") for i in range(7)] + [row(1, "de"), row(2, None), row(3, ""), row(4, "")]
    rows += [row(None, n_chars=5), row(None, n_chars=None), row(9, text=None, source=None), row(9, text=""), row(9, text=""),
             row(2**62, n_chars=2**63 - 1), row(-5, "de"), row(12, text="x" * 100_000), row(14, n_chars=None)]
    compared(spark, rows, tmp_path)


def test_one_leaf_and_none(spark, tmp_path):
    compared(spark, [dict(doc_id=1, source=None, lang=None, n_chars=3, text="abc")], tmp_path / "one")
    compared(spark, [], tmp_path / "none")


def test_only_what_is_asked_is_proved(spark):
    docs = spark.range(3000).select("id", (F.col("id") % 3).cast("string").alias("part"))
    made = manifest(docs, [F.col("id"), F.col("part")], F.col("part"), F.col("id"), id=F.col("id"), claimed=F.lit(None).cast("string"))
    whole = {r.id: r for r in audit(made, "claimed", with_proofs=True).collect()}
    some = audit(made, "claimed", F.col("carry_id") % 1000 == 7, with_proofs=True).collect()
    assert {r.id for r in some} == {7, 1007, 2007} and all(r == whole[r.id] and r.verified for r in some)
    assert all(len(r.proof) in (11, 12) for r in some)
    shared = made.records.groupBy("digest").count().filter("count > 1").count()
    assert shared == 0 and made.records.agg(F.max(F.size("children"))).first()[0] <= 1 << merkle.PAGE


def test_a_changed_record_is_noticed(spark):
    docs = spark.range(50).select("id")
    made = manifest(docs, [F.col("id")], F.lit("g"), F.col("id"), id=F.col("id"), claimed=F.sha2(F.lit("forged"), 256))
    assert audit(made, "claimed").filter("verified").isEmpty()
