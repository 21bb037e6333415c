"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

Rows are leaves, one binary tree a group, a tree over the groups' roots on top. What is stored are records
from a digest to its children ``PAGE`` levels below (fewer at a tree's top); the nodes in between follow from
the children. A request descends from the root by the digits of its leaf's rank, one record after another:
each yields the children that were not selected, a segment of the path. Requests below one node descend
together, so the root's record is read once. Segments are collected from the top; reversed, they are the proof.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import documents, null_safe, numbered, saved

#: Levels a record spans: its children are at most 2^PAGE.
PAGE = 10
_NODE = "tree BIGINT, rank BIGINT, size BIGINT, digest STRING"
_FRONT = "tree BIGINT, rank BIGINT, height INT, digest STRING, segments ARRAY<STRING>"


def joined_digest(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def climbed(children: list[str], levels: int) -> list[list[str]]:
    """The children and the ``levels`` levels above them; a last node without a neighbour is hashed alone."""
    rows = [children]
    for _ in range(levels):
        below = rows[-1]
        rows.append([joined_digest(below[i:i + 2]) for i in range(0, len(below), 2)])
    return rows


def unselected(rows: list[list[str]], child: int) -> list[str]:
    """The siblings beside the way from a child to the top of ``rows``, the lowest first."""
    found = []
    for level in rows[:-1]:
        if (child ^ 1) < len(level):
            found.append(level[child ^ 1])
        child >>= 1
    return found


def folded(digest: str, rank: int, size: int, siblings) -> str:
    """The root of a tree of ``size`` leaves that a leaf at ``rank`` leads to with these siblings."""
    while size > 1:
        if rank & 1:
            digest = joined_digest([next(siblings), digest])
        elif rank + 1 < size:
            digest = joined_digest([digest, next(siblings)])
        else:
            digest = joined_digest([digest])
        rank, size = rank >> 1, (size + 1) >> 1
    return digest


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


@dataclass
class Manifest:
    """``leaves`` (tree, rank, size, digest and what was carried), ``trees`` (tree, size, subroot, place: its rank in
    the tree on top), ``records`` (digest, children, levels), ``root`` (null: no rows) and ``places``, the number of trees."""
    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: str | None
    places: int


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, digest) of every tree's root and the records below it, from (tree, rank, size, digest) of its leaves."""
    def page(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        size = table["size"][0].as_py()
        levels = min(PAGE, (size - 1).bit_length())
        children = table["digest"].to_pylist()
        return pa.table({"tree": table["tree"][:1], "rank": pa.array([table["rank"][0].as_py() >> PAGE], pa.int64()),
                         "size": pa.array([((size - 1) >> PAGE) + 1], pa.int64()),
                         "digest": [climbed(children, levels)[-1][0]],
                         "children": pa.array([children], pa.list_(pa.string())), "levels": pa.array([levels], pa.int32())})

    spark = nodes.sparkSession
    roots = nodes.filter("size = 1").select("tree", "digest")
    records = spark.createDataFrame([], "digest STRING, children ARRAY<STRING>, levels INT")
    nodes = nodes.filter("size > 1")
    while not nodes.isEmpty():
        made = saved(nodes.groupBy("tree", F.shiftright("rank", PAGE).alias("page")).applyInArrow(
            page, f"{_NODE}, children ARRAY<STRING>, levels INT"), "pages")
        records = records.unionByName(made.select("digest", "children", "levels"))
        roots = roots.unionByName(made.filter("size = 1").select("tree", "digest"))
        nodes = made.filter("size > 1").select("tree", "rank", "size", "digest")
    return roots, records


def manifest(docs: DataFrame, fields: list[Column], group: Column, order: Column, **carry: Column) -> Manifest:
    """The manifest of ``docs``: ``fields`` make a leaf, groups and the leaves in them ascend, nulls first.

    Rows that ``order`` leaves equal are ordered by their digest; equal rows are leaves of their own. ``carry``
    names columns that ride along in ``leaves``. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = saved(docs.select(group.alias("group"), order.alias("order"), leaf_digest(fields).alias("digest"),
                             *[c.alias(f"carry_{name}") for name, c in carry.items()],
                             F.monotonically_increasing_id().alias("spread")), "leaves")
    placed = numbered(rows, [F.col(c) for c in ("group", "order", "digest", "spread")], "placed")
    groups = saved(placed.groupBy("group").agg(F.min("place").alias("tree"), F.count("*").alias("size")), "groups")
    leaves = null_safe(placed, groups, ["group"], "inner").select(
        "tree", (F.col("place") - F.col("tree")).alias("rank"), "size", "digest", *[f"carry_{c}" for c in carry])
    leaves = saved(leaves, "ranked")
    roots, below = grown(leaves.select("tree", "rank", "size", "digest"))
    trees = numbered(roots.join(groups.select("tree", "size"), "tree").withColumnRenamed("digest", "subroot"),
                     [F.col("tree")], "trees")
    places = trees.count()
    top, above = grown(trees.select(F.lit(-1).cast("bigint").alias("tree"), F.col("place").alias("rank"),
                                    F.lit(places).cast("bigint").alias("size"), F.col("subroot").alias("digest")))
    first = top.first()
    records = below.unionByName(above).groupBy("digest").agg(F.first("children").alias("children"), F.first("levels").alias("levels"))
    return Manifest(leaves, trees, saved(records, "records"), first.digest if first else None, places)


def descended(front: DataFrame, records: DataFrame, wanted: DataFrame, stop: int) -> DataFrame:
    """Nodes of (tree, rank, height, digest, segments) led down until their height is ``stop`` or less.

    ``wanted`` is (tree, rank) of nodes at the height ``stop``; only ways to them are followed.
    """
    def each(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = climbed(row["children"], row["levels"])
                for child, digest in enumerate(row["children"]):
                    out.append((row["tree"], (row["rank"] << row["levels"]) + child, row["height"] - row["levels"], digest,
                                [*row["segments"], "".join(unselected(rows, child))]))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["tree", "rank", "height", "digest", "segments"])

    ways = wanted.select("tree", "rank", F.explode(F.sequence(F.lit(0), F.lit(60 // PAGE))).alias("turn")).select(
        "tree", F.expr(f"shiftright(rank, turn * {PAGE})").alias("rank"), (F.col("turn") * PAGE + stop).alias("height")).distinct()
    done = front.filter(F.col("height") <= stop)
    front = front.filter(F.col("height") > stop)
    while not front.isEmpty():
        met = front.join(records, "digest").select("tree", "rank", "height", "segments", "children", "levels")
        front = saved(met.mapInArrow(each, _FRONT).join(ways, ["tree", "rank", "height"], "left_semi"), "front")
        done = done.unionByName(front.filter(F.col("height") <= stop))
        front = front.filter(F.col("height") > stop)
    return done


def audit(made: Manifest, claimed: str, asked: Column | None = None, with_proofs: bool = False) -> DataFrame:
    """Proves the leaves for which ``asked`` holds (all, if none) and checks a claimed digest for each.

    Returns the carried columns with ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (the digest of all siblings, the
    lowest first), ``folded_root`` (what the digest in the carried column ``claimed`` leads to; null: the leaf's own)
    and ``verified``; with ``with_proofs`` also the siblings. An empty table has no root and no rows.
    """
    leaves = made.leaves if asked is None else made.leaves.filter(asked)
    carried = [c for c in leaves.columns if c.startswith("carry_")]
    requests = leaves.select("tree", "rank", F.shiftright("rank", PAGE).alias("page"), *carried)
    wanted = saved(requests.select("tree", F.col("page").alias("rank")).distinct(), "wanted")
    tops = saved(wanted.select("tree").distinct().join(made.trees, "tree"), "tops")
    spark = leaves.sparkSession
    height = max(0, made.places - 1).bit_length()
    start = spark.createDataFrame([(-1, 0, height, made.root, [])] if made.root else [], _FRONT)
    asked_trees = tops.select(F.lit(-1).cast("bigint").alias("tree"), F.col("place").alias("rank"))
    to_trees = descended(start, made.records, asked_trees, 0)
    trees = saved(to_trees.select(F.col("rank").alias("place"), "segments").join(tops, "place"), "subroots")
    bits = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0).cast("int")
    front = trees.select("tree", F.lit(0).cast("bigint").alias("rank"), bits.alias("height"), F.col("subroot").alias("digest"), "segments")
    found = descended(front, made.records, wanted, PAGE).join(made.records, "digest", "left").select(
        "tree", F.col("rank").alias("page"), F.array_join(F.reverse("segments"), "").alias("above"),
        F.coalesce("children", F.array("digest")).alias("children"), F.coalesce("levels", F.lit(0)).alias("levels"))
    pages = found.join(trees.select("tree", "size", "subroot", "place"), "tree")
    root, places = made.root, made.places
    extra = "leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN"
    extra += ", proof ARRAY<STRING>" if with_proofs else ""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.select(*carried).schema)

    def prove(asked: pa.Table, page: pa.Table) -> pa.Table:
        at = page.to_pylist()[0]
        rows = climbed(at["children"], at["levels"])
        above = [at["above"][i:i + 64] for i in range(0, len(at["above"]), 64)]
        ranks, claims = asked["rank"].to_pylist(), asked[f"carry_{claimed}"].to_pylist()
        own = [rows[0][rank & ((1 << PAGE) - 1)] for rank in ranks]
        proofs = [unselected(rows, rank & ((1 << PAGE) - 1)) + above for rank in ranks]
        ends = []
        for rank, leaf, claim, proof in zip(ranks, own, claims, proofs, strict=True):
            siblings = iter(proof)
            subroot = folded(claim or leaf, rank, at["size"], siblings)
            ends.append(folded(subroot, at["place"], places, siblings))
        columns = {c: asked[c] for c in carried} | {
            "leaf": own, "subroot": [at["subroot"]] * len(own), "root": [root] * len(own),
            "proof_sha256": [joined_digest(p) for p in proofs], "folded_root": ends, "verified": [e == root for e in ends]}
        return pa.table(columns | ({"proof": pa.array(proofs, pa.list_(pa.string()))} if with_proofs else {}))

    out = requests.groupBy("tree", "page").cogroup(pages.groupBy("tree", "page")).applyInArrow(prove, f"{kinds}, {extra}")
    return out.withColumnsRenamed({c: c.removeprefix("carry_") for c in carried})


def op13_merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = ("doc_id", "source", "lang", "n_chars", "text")
    fields = {c: F.col(c) for c in names}
    changed = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    made = manifest(docs, list(fields.values()), F.col("lang"), F.col("doc_id"), doc_id=F.col("doc_id"),
                    claimed=F.when(hit, leaf_digest(list(changed.values()))))
    return audit(made, "claimed").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"""


def _field(sql: str) -> str:
    return f"coalesce(strlen(({sql})::VARCHAR)::VARCHAR || ':' || ({sql})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _steps(tree: str) -> str:
    """Of (id, rank, size) beside the nodes of their tree: what is done level by level, as L, R or - and the sibling."""
    return f"""SELECT s.id, list(CASE WHEN s.number & 1 = 1 THEN 'L' || n.digest WHEN n.digest IS NOT NULL THEN 'R' || n.digest ELSE '-' END
    ORDER BY s.level) AS steps FROM (SELECT id, lang, level, rank >> level AS number FROM {tree}_rows, LATERAL (
    SELECT unnest(range(CASE WHEN size < 2 THEN 0 ELSE length(bin(size - 1)) END)) AS level)) s
  LEFT JOIN {tree}_nodes n ON n.lang IS NOT DISTINCT FROM s.lang AND n.level = s.level AND n.number = xor(s.number, 1) GROUP BY s.id"""


OP13_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS id, *, {_leaf("n_chars")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_leaf("n_chars + 1")} END AS claimed FROM documents),
low_rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY lang) AS size FROM d),
low_nodes AS (SELECT lang, 0 AS level, rank AS number, leaf AS digest, size AS nodes FROM low_rows
  UNION ALL SELECT lang, level + 1, number >> 1, sha256(string_agg(digest, '' ORDER BY number)), (nodes + 1) >> 1
  FROM low_nodes WHERE nodes > 1 GROUP BY lang, level, number >> 1, nodes),
top_rows AS MATERIALIZED (SELECT lang AS id, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank,
    count(*) OVER () AS size, NULL::VARCHAR AS lang FROM low_nodes WHERE nodes = 1),
top_nodes AS (SELECT lang, 0 AS level, rank AS number, subroot AS digest, size AS nodes FROM top_rows
  UNION ALL SELECT lang, level + 1, number >> 1, sha256(string_agg(digest, '' ORDER BY number)), (nodes + 1) >> 1
  FROM top_nodes WHERE nodes > 1 GROUP BY lang, level, number >> 1, nodes),
low_steps AS ({_steps("low")}), top_steps AS ({_steps("top")}),
p AS (SELECT r.doc_id, r.leaf, r.claimed, t.subroot, (SELECT digest FROM top_nodes WHERE nodes = 1) AS root,
    coalesce(a.steps, []) || coalesce(b.steps, []) AS steps
  FROM low_rows r JOIN top_rows t ON t.id IS NOT DISTINCT FROM r.lang LEFT JOIN low_steps a ON a.id = r.id
  LEFT JOIN top_steps b ON b.id IS NOT DISTINCT FROM r.lang),
f AS (SELECT *, sha256(list_reduce(list_prepend('', steps), lambda a, s: a || substr(s, 2))) AS proof_sha256,
  list_reduce(list_prepend(coalesce(claimed, leaf), steps), lambda a, s: sha256(
    CASE WHEN s[1] = 'L' THEN substr(s, 2) || a ELSE a || substr(s, 2) END)) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""
