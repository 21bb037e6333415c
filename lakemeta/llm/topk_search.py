"""Exact top-k inner products by a uniform threshold in three phases.

Vectors are cut into segments; a score is the sum of its segments' local scores. (1) Every cell (a
block of rows, a block of queries, one segment) returns its best local scores; the exact
scores of these rows give each query a cutoff t, its k-th best so far. (2) The cutoff goes to all cells: a row
that reaches t has a local score of at least t / segments somewhere, so entries below that, or that
cannot reach t with the largest rest their norms allow, are not sent. (3) What was sent is scored exactly.

Equal vectors are one class throughout: only its k + 1 smallest ids can ever be answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemeta.llm.common import numbered, saved

_ROWS, _QUERIES = 8192, 2048
_CHUNK = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component, one row per id and vector.

    Rows with no id, no vector, or a component that is null or not finite take no part. A vector
    without components does; so does each of several vectors under one id.
    """
    x = F.col("x")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda c: c.cast("double")).alias("x"))
    valid = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(F.col("vec_id").isNotNull() & F.coalesce(valid, F.lit(False)))
            .select("vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v")).distinct())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), place] = np.asarray(column.flatten())
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _cells(classes: DataFrame, queries: DataFrame, segments: int, width: int, count: int, asked: int):
    """Both sides dealt to cells: rows to every block of queries, queries to every block of rows, by segment."""
    part = math.ceil(width / segments)
    row_groups, query_groups = math.ceil(count / _ROWS), math.ceil(asked / _QUERIES)

    def norm(values):
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x))

    def dealt(side, own, own_groups, other, other_groups, more):
        cut = side.select("cid", "v", *more, F.pmod(F.xxhash64("cid"), F.lit(own_groups)).alias(own),
                          F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
        cut = cut.withColumn("piece", F.slice("v", F.col("segment") * part + 1, F.lit(part)))
        rest = F.sqrt(F.greatest(norm("v") * norm("v") - norm("piece") * norm("piece"), F.lit(0.0)))
        return cut.select("cid", *more, own, "segment", "piece", rest.alias("rest"),
                          F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)).cast("array<bigint>")).alias(other))

    left = dealt(classes, "rg", row_groups, "qg", query_groups, [])
    right = dealt(queries, "qg", query_groups, "rg", row_groups, ["cutoff"])
    keys = ["rg", "qg", "segment"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)), part


def _local_best(rows: pa.Table, queries: pa.Table, part: int, k: int):
    a, b = _matrix(rows.column("piece"), part), _matrix(queries.column("piece"), part)
    ids, asked = np.asarray(rows.column("cid")), np.asarray(queries.column("cid"))
    query, found = [], []
    for at in range(0, len(b), _CHUNK):
        scores = _products(b[at:at + _CHUNK], a)
        best = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k] if len(ids) else np.zeros((len(scores), 0), np.int64)
        query.append(np.repeat(asked[at:at + _CHUNK], best.shape[1]))
        found.append(ids[best.ravel()])
    return query, found


def _sufficient(rows: pa.Table, queries: pa.Table, part: int, segments: int):
    a, b = _matrix(rows.column("piece"), part), _matrix(queries.column("piece"), part)
    ids, asked = np.asarray(rows.column("cid")), np.asarray(queries.column("cid"))
    row_rest, query_rest = np.asarray(rows.column("rest")), np.asarray(queries.column("rest"))
    cutoffs = queries.column("cutoff").to_pylist()
    query, found = [], []
    for at in range(0, len(b), _CHUNK):
        scores = _products(b[at:at + _CHUNK], a)
        cut = np.array([-np.inf if c is None else c for c in cutoffs[at:at + _CHUNK]])[:, None]
        most = scores + query_rest[at:at + _CHUNK, None] * row_rest * (1 + 1e-9) + 1
        q, r = np.nonzero((scores * float(segments) >= cut) & (most >= cut))
        query.append(asked[at:at + _CHUNK][q])
        found.append(ids[r])
    return query, found


def _pairs(cells, part: int, work) -> DataFrame:
    def each(rows: pa.Table, queries: pa.Table) -> pa.Table:
        query, found = work(rows, queries, part) if rows.num_rows and queries.num_rows else ([], [])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query": pa.array(join(query).astype(np.int64)), "cid": pa.array(join(found).astype(np.int64))})
    return cells.applyInArrow(each, "query BIGINT, cid BIGINT")


def _resolved(pairs: DataFrame, classes: DataFrame, k: int, name: str) -> DataFrame:
    """(query, cid, score, place): the ``k`` best of the distinct pairs by exact score, then id."""
    query_vectors = classes.select(F.col("cid").alias("query"), F.col("v").alias("qv"))
    score = F.aggregate(F.zip_with("v", "qv", lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    scored = (pairs.distinct().join(classes.select("cid", "v"), "cid").join(query_vectors, "query")
              .select("query", "cid", score.alias("score")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))
    return saved(scored.withColumn("place", place).filter(F.col("place") <= k), name)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, segments: int = 2, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``k`` highest inner products with
    other rows (all, if there are fewer), equal scores in id order.

    Shorter vectors count as filled with zeros. Rows equal in id and vector are one row, several vectors under
    one id are queries and candidates each; other columns are not read. Scores
    must fit in 64 bits. An empty table, or one vector, has no answers.
    """
    rows = saved(quantised(vectors, id_col, vector_col), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    # Classes are numbered in the order of their smallest ids, which equal scores are ranked by.
    classes = rows.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("v").agg(
        F.min("vec_id").alias("lead"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = saved(numbered(classes, [F.col("lead"), F.col("v")], "classes").select(F.col("place").alias("cid"), "v", "ids"), "classes")
    asked = saved(rows.filter(F.col("vec_id") % every == 0).join(classes.select("v", "cid"), "v").select("vec_id", "cid"), "asked")
    query_classes = saved(classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v"), "queries")
    width, count = classes.agg(F.greatest(F.max(F.size("v")), F.lit(1)), F.count("*")).first()
    queries = query_classes.count()
    if not count or not queries:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    base = query_classes.withColumn("cutoff", F.lit(None).cast("bigint"))
    cells, part = _cells(classes, base, segments, width, count, queries)
    lists = _pairs(cells, part, lambda a, b, n: _local_best(a, b, n, k + 1))
    floor = _resolved(lists, classes, k + 1, "lists").filter(F.col("place") == k + 1).select(
        F.col("query").alias("cid"), F.col("score").alias("cutoff"))
    cells, part = _cells(classes, saved(query_classes.join(floor, "cid", "left"), "cutoffs"), segments, width, count, queries)
    best = _resolved(_pairs(cells, part, lambda a, b, n: _sufficient(a, b, n, segments)), classes, k + 1, "best")
    entries = best.join(classes.select("cid", "ids"), "cid").select("query", "cid", "score", F.explode("ids").alias("found"))
    nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))
    answers = saved(entries.withColumn("n", nearest).filter(F.col("n") <= k + 1).drop("n"), "answers")
    each = asked.withColumnRenamed("cid", "query").join(answers, "query").filter("found <> vec_id OR cid <> query")
    rank = F.row_number().over(Window.partitionBy("vec_id", "query").orderBy(F.desc("score"), "found"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def op10_topk_search(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, q.e, c.vec_id,
                  CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND (q.vec_id <> c.vec_id OR q.e <> c.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                  vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5
"""
