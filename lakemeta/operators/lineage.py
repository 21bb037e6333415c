"""Column-level lineage as an edge list.

An edge is (source_element_pid, target_element_pid, source_type) with optional
``source_app_pid`` / ``target_app_pid`` overrides and a ``seq`` that totally orders arrival.
``source_type`` is one of the five provider kinds of ``fixed_values.SOURCE_WEIGHTS``.

Every reduction is a grouped aggregate, so a pair that holds a large share of all rows collapses
map-side before the shuffle; no window ever sorts a whole pair in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemeta.functions import fixed_values as fx
from lakemeta.functions import pids
from lakemeta.model import EDGE_KEY, EDGE_PAIR

SOURCE, TARGET, KIND = EDGE_KEY
SUMMARY_KINDS = ["FK", "OPERATIONAL", "ETL", "SQL_PARSER", "MANUAL"]


# --- producing edges -------------------------------------------------------------------------

def _column_pairs(fks: DataFrame) -> DataFrame:
    matched = fks.filter(F.size("columns") == F.size("referenced_columns"))
    zipped = F.arrays_zip(F.col("columns").alias("from_column"),
                          F.col("referenced_columns").alias("to_column"))
    return matched.withColumn("_pair", F.explode(zipped))


def fk_edges(fks: DataFrame) -> DataFrame:
    """One FK edge per column pair; names keep their case, the last segment is the connector."""
    pid = lambda column, table, schema: F.concat_ws(
        "@", F.col(column), F.col(table), F.col(schema), F.col("connector_id"))
    return _column_pairs(fks).select(
        pid("_pair.from_column", "table_name", "schema_name").alias(SOURCE),
        pid("_pair.to_column", "referenced_table", "referenced_schema").alias(TARGET),
        F.lit("FK").alias(KIND))


def fk_lineage_payload(fks: DataFrame, connectors: DataFrame) -> DataFrame:
    """FK edges in ingest form: upper-cased PIDs under the connector's application."""
    app = pids.app_pid("connector_id", "database_type")
    pairs = (_column_pairs(fks)
             .filter((F.col("_pair.from_column") != "") & (F.col("_pair.to_column") != ""))
             .join(connectors.select("connector_id", "database_type"), "connector_id", "left")
             .withColumn("application_pid", app))
    pid = lambda column, table, schema: pids.element_pid(column, pids.entity_pid(
        table, pids.container_pid(schema, "application_pid")))
    return pairs.select(
        "application_pid",
        F.lit("FK").alias("lineage_source"),
        pid("_pair.from_column", "table_name", "schema_name").alias(SOURCE),
        pid("_pair.to_column", "referenced_table", "referenced_schema").alias(TARGET))


def union_edges(*edges: DataFrame) -> DataFrame:
    """Merges providers; raw rows accumulate, nothing is deduplicated yet."""
    merged = edges[0]
    for other in edges[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


# --- dedup and winner ------------------------------------------------------------------------

def _payload_columns(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in EDGE_KEY]


def dedup_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (source, target, source_type): the first seen by ``order``."""
    payload = _payload_columns(edges)
    if not payload:
        return edges.select(*EDGE_KEY).distinct()
    if order not in payload:
        raise ValueError(f"edges carry {payload}; '{order}' must order them")
    if payload == [order]:
        return edges.groupBy(*EDGE_KEY).agg(F.min(order).alias(order))
    first = edges.groupBy(*EDGE_KEY).agg(
        F.min_by(F.struct(*payload), F.col(order)).alias("_first"))
    return first.select(*EDGE_KEY, "_first.*")


def source_ranks(weights: dict[str, int] | None = None) -> list[str]:
    """Provider kinds from most to least trusted; equal weights go alphabetically."""
    merged = {**fx.SOURCE_WEIGHTS, **(weights or {})}
    return sorted(merged, key=lambda kind: (-merged[kind], kind))


def _rank_of(kind: Column, ranking: list[str]) -> Column:
    rank = F
    for position, name in enumerate(ranking):
        rank = rank.when(kind == name, F.lit(position))
    return rank.otherwise(_unknown(kind))


def _unknown(kind: Column) -> Column:
    """Fails the query: an edge of a kind that nothing ranks or counts would silently distort the result."""
    return F.raise_error(F.concat(F.lit("unknown edge kind: "), F.coalesce(kind, F.lit("null")))).cast("int")


def winner_edges(edges: DataFrame, weights: dict[str, int] | None = None,
                 order: str = "seq") -> DataFrame:
    """One edge per (source, target): the most trusted provider's first-seen edge.

    Weights are static, so trust becomes a small integer and the winner a plain ``min`` — a hash
    aggregate over fixed-width buffers with map-side combine. A kind without a weight is an error;
    ``weights`` can name further kinds.
    """
    ranking = source_ranks(weights)
    ranked = edges.withColumn("_rank", _rank_of(F.col(KIND), ranking))
    kinds = F.array(*[F.lit(kind) for kind in ranking])
    kind_of = F.get(kinds, F.col("_rank")).alias(KIND)
    payload = _payload_columns(edges)
    if not payload:
        best = ranked.groupBy(*EDGE_PAIR).agg(F.min("_rank").alias("_rank"))
        return best.select(*EDGE_PAIR, kind_of)
    if order not in payload:
        raise ValueError(f"edges carry {payload}; '{order}' must order them")
    best = ranked.groupBy(*EDGE_PAIR).agg(
        F.min_by(F.struct("_rank", *payload), F.struct("_rank", order)).alias("_best"))
    return best.select(*EDGE_PAIR, "_best.*").select(*EDGE_PAIR, kind_of, *payload)


# --- applications and summary ----------------------------------------------------------------

def _apps(edges: DataFrame) -> tuple[Column, Column]:
    override = lambda name: F.col(name) if name in edges.columns else None
    return (pids.effective_app(override("source_app_pid"), SOURCE),
            pids.effective_app(override("target_app_pid"), TARGET))


def with_app_bucket(edges: DataFrame) -> DataFrame:
    """Adds ``app_bucket``: the application an edge belongs to, or the cross-application bucket."""
    source_app, target_app = _apps(edges)
    return edges.withColumn("app_bucket", pids.app_bucket(source_app, target_app))


def edges_by_app(edges: DataFrame, order: str = "seq") -> DataFrame:
    """Deduplicated edges tagged with their application bucket; write ``partitionBy`` it to split.

    The bucket stays a column: a bucket may hold most edges, so it is never a grouped list.
    """
    return with_app_bucket(dedup_edges(edges, order))


def app_edge_counts(edges: DataFrame, order: str = "seq") -> DataFrame:
    return edges_by_app(edges, order).groupBy("app_bucket").agg(F.count("*").alias("edge_count"))


def lineage_summary(edges: DataFrame, order: str = "seq") -> DataFrame:
    """Totals over raw, deduplicated and distinct edges, in one shuffle of pair-level partials.

    A pair has at most five kinds, so all of a pair's kinds are folded into one row: without
    overrides a bitmask (cross-application then depends on the pair alone), with overrides one
    ``min(seq, cross)`` per kind packed in a long, which is the first-seen edge's flag. An edge of a
    sixth kind is an error.
    """
    bits = {kind: 1 << i for i, kind in enumerate(SUMMARY_KINDS)}
    has_override = {"source_app_pid", "target_app_pid"} & set(edges.columns)
    if not has_override:
        mask = F
        for kind, bit in bits.items():
            mask = mask.when(F.col(KIND) == kind, F.lit(bit))
        pairs = (edges.select(*EDGE_PAIR, mask.otherwise(_unknown(F.col(KIND))).alias("_bit"))
                 .groupBy(*EDGE_PAIR)
                 .agg(F.count("*").alias("_raw"), F.bit_or("_bit").alias("_kinds")))
        cross = pids.is_cross_app(*_apps(pairs))
        present = {kind: (F.col("_kinds").bitwiseAND(bit) != 0) for kind, bit in bits.items()}
        crossing = {kind: present[kind] & F.col("_cross") for kind in bits}
        pairs = pairs.withColumn("_cross", cross)
    else:
        if order not in edges.columns:
            raise ValueError(f"application overrides need '{order}' to tell the first edge")
        packed = F.col(order) * 2 + pids.is_cross_app(*_apps(edges)).cast("int")
        known = F.when(F.col(KIND).isin(SUMMARY_KINDS), packed).otherwise(_unknown(F.col(KIND)))
        firsts = [F.min(F.when(F.col(KIND) == kind, F.col("_packed"))).alias(f"_{kind}") for kind in bits]
        pairs = edges.withColumn("_packed", known).groupBy(*EDGE_PAIR).agg(F.count("*").alias("_raw"), *firsts)
        present = {kind: F.col(f"_{kind}").isNotNull() for kind in bits}
        crossing = {kind: F.coalesce(F.pmod(f"_{kind}", F.lit(2)) == 1, F.lit(False))
                    for kind in bits}
    total = lambda flags: sum((f.cast("bigint") for f in flags), F.lit(0).cast("bigint"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return pairs.agg(
        zero(F.sum("_raw")).alias("total_raw"),
        F.count("*").alias("unique_edges"),
        zero(F.sum(F.col("_raw") - total(present.values()))).alias("duplicates_removed"),
        *[zero(F.sum(present[kind].cast("bigint"))).alias(f"{kind.lower()}_edges")
          for kind in SUMMARY_KINDS],
        zero(F.sum(total(crossing.values()))).alias("cross_app_edges"))


# --- queries ---------------------------------------------------------------------------------

def filter_lineage(edges: DataFrame, connector: str | None = None,
                   table: str | None = None) -> DataFrame:
    """Connector matches case-sensitively, table case-insensitively, anywhere in either PID."""
    if connector:
        edges = edges.filter(F.col(SOURCE).contains(connector) | F.col(TARGET).contains(connector))
    if table:
        upper = table.upper()
        edges = edges.filter(F.upper(SOURCE).contains(upper) | F.upper(TARGET).contains(upper))
    return edges


def readable_edges(edges: DataFrame) -> DataFrame:
    """Edges with both PIDs split into column, table, schema and connector."""
    parts = [part.alias(f"{side}_{name}")
             for side, pid in (("source", SOURCE), ("target", TARGET))
             for name, part in pids.parse_pid(pid).items()]
    return edges.select(*parts, KIND)
