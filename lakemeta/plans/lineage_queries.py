"""Queries over lineage edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemeta.operators import discovery, lineage
from lakemeta.operators.paging import page
from lakemeta.plans.registry import query
from lakemeta.plans.workloads import ctes, load

_WEIGHT = ("CASE source_type WHEN 'FK' THEN 100 WHEN 'OPERATIONAL' THEN 80 WHEN 'ETL' THEN 60 "
           "WHEN 'MANUAL' THEN 50 ELSE 40 END")
_EXTRACT = "nullif(regexp_extract({0}, '^(?s:.*@)?(APP-[^@]*)', 1), '')"


def _winner(weight: str) -> str:
    return f"""{ctes("edges")}, d AS (SELECT DISTINCT * FROM edges)
SELECT source_element_pid, target_element_pid, source_type FROM (
  SELECT *, row_number() OVER (PARTITION BY source_element_pid, target_element_pid
                               ORDER BY {weight} DESC, source_type) AS rn FROM d) WHERE rn = 1"""


@query(f"{ctes('edges')} SELECT DISTINCT source_element_pid, target_element_pid, source_type FROM edges")
def dedup_edges(spark, sf_dir):
    return lineage.dedup_edges(load(spark, sf_dir, "edges"))


_FIRST = f"""{ctes("edges_override")}, d AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY source_element_pid, target_element_pid, source_type ORDER BY seq) AS rn
  FROM edges_override) WHERE rn = 1), a AS (SELECT *,
  coalesce(source_app_pid, {_EXTRACT.format("source_element_pid")}) AS sa,
  coalesce(target_app_pid, {_EXTRACT.format("target_element_pid")}) AS ta FROM d),
b AS (SELECT *, CASE WHEN sa <> '' AND ta <> '' AND sa <> ta THEN '__CROSS_APP__'
  ELSE coalesce(sa, ta, '__UNKNOWN__') END AS app_bucket FROM a)"""


@query(f"""{_FIRST} SELECT source_element_pid, target_element_pid, source_type, source_app_pid,
  target_app_pid, seq FROM d""")
def dedup_edges_first_seen(spark, sf_dir):
    return lineage.dedup_edges(load(spark, sf_dir, "edges_override"))


@query(_winner(_WEIGHT))
def winner_edges(spark, sf_dir):
    return lineage.winner_edges(load(spark, sf_dir, "edges"))


@query(_winner("CASE source_type WHEN 'FK' THEN 100 WHEN 'OPERATIONAL' THEN 60 WHEN 'ETL' THEN 60 "
               "WHEN 'MANUAL' THEN 200 ELSE 40 END"))
def winner_edges_custom(spark, sf_dir):
    return lineage.winner_edges(load(spark, sf_dir, "edges"), {"MANUAL": 200, "OPERATIONAL": 60})


@query(f"""{_FIRST} SELECT source_element_pid, target_element_pid, source_type, source_app_pid,
  target_app_pid, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_element_pid,
  target_element_pid ORDER BY {_WEIGHT} DESC, source_type) AS w
  FROM (SELECT * EXCLUDE (rn) FROM d)) WHERE w = 1""")
def winner_edges_first_seen(spark, sf_dir):
    return lineage.winner_edges(load(spark, sf_dir, "edges_override"))


@query(f"""{ctes("edges")}, d AS (SELECT DISTINCT * FROM edges), a AS (SELECT *,
  {_EXTRACT.format("source_element_pid")} AS sa, {_EXTRACT.format("target_element_pid")} AS ta FROM d)
SELECT CASE WHEN sa <> ta THEN '__CROSS_APP__' ELSE coalesce(sa, ta, '__UNKNOWN__') END AS app_bucket,
  count(*) AS edge_count FROM a GROUP BY 1""")
def edges_by_app(spark, sf_dir):
    return lineage.app_edge_counts(load(spark, sf_dir, "edges"))


@query(f"""{_FIRST} SELECT app_bucket, source_element_pid, target_element_pid, source_type,
  source_app_pid, target_app_pid, seq FROM b""")
def edges_by_app_override(spark, sf_dir):
    return lineage.edges_by_app(load(spark, sf_dir, "edges_override"))


def _summary(prefix: str, raw: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (source_type = '{k}') AS {k.lower()}_edges"
                      for k in lineage.SUMMARY_KINDS)
    return f"""{prefix}
SELECT (SELECT count(*) FROM {raw}) AS total_raw,
  count(DISTINCT source_element_pid || '|' || target_element_pid) AS unique_edges,
  (SELECT count(*) FROM {raw}) - count(*) AS duplicates_removed, {kinds},
  count(*) FILTER (sa <> '' AND ta <> '' AND sa <> ta) AS cross_app_edges FROM a"""


@query(_summary(f"""{ctes("edges")}, d AS (SELECT DISTINCT * FROM edges), a AS (SELECT *,
  {_EXTRACT.format("source_element_pid")} AS sa, {_EXTRACT.format("target_element_pid")} AS ta FROM d)""",
                "edges"))
def lineage_summary(spark, sf_dir):
    return lineage.lineage_summary(load(spark, sf_dir, "edges"))


@query(_summary(_FIRST, "edges_override"))
def lineage_summary_override(spark, sf_dir):
    return lineage.lineage_summary(load(spark, sf_dir, "edges_override"))


# Two providers merged: the override edges twice (a re-discovery) plus the plain edges.
@query(_summary(f"""{ctes("edges", "edges_override")}, u AS (
  SELECT *, NULL AS source_app_pid, NULL AS target_app_pid, 0 AS seq FROM edges
  UNION ALL SELECT * FROM edges_override UNION ALL SELECT * FROM edges_override),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_element_pid,
  target_element_pid, source_type ORDER BY seq) AS rn FROM u) WHERE rn = 1),
a AS (SELECT *, coalesce(source_app_pid, {_EXTRACT.format("source_element_pid")}) AS sa,
  coalesce(target_app_pid, {_EXTRACT.format("target_element_pid")}) AS ta FROM d)""", "u"))
def union_providers_summary(spark, sf_dir):
    plain = load(spark, sf_dir, "edges").withColumn("seq", F.lit(0).cast("bigint"))
    override = load(spark, sf_dir, "edges_override")
    return lineage.lineage_summary(lineage.union_edges(plain, override, override))


@query(f"""{ctes("edges")} SELECT * FROM (SELECT DISTINCT * FROM edges)
WHERE (source_element_pid LIKE '%APP-DISC-R%' OR target_element_pid LIKE '%APP-DISC-R%')
  AND (upper(source_element_pid) LIKE '%PART3%' OR upper(target_element_pid) LIKE '%PART3%')""")
def lineage_for_table(spark, sf_dir):
    edges = lineage.filter_lineage(load(spark, sf_dir, "edges"), connector="APP-DISC-R", table="part3")
    return lineage.dedup_edges(edges)


@query(f"""{ctes("edges")}, d AS (SELECT DISTINCT * FROM edges)
SELECT *, (SELECT count(*) FROM d) AS total_count FROM d
ORDER BY source_element_pid, target_element_pid, source_type LIMIT 1000 OFFSET 2000""")
def lineage_page(spark, sf_dir):
    edges = lineage.dedup_edges(load(spark, sf_dir, "edges"))
    return page(edges, ["source_element_pid", "target_element_pid", "source_type"],
                limit=1000, offset=2000)


def _readable(pid: str, side: str) -> str:
    parts = f"string_split({pid}, '@')"
    full = f"len({parts}) >= 4"
    return f"""CASE WHEN {full} THEN {parts}[1] ELSE coalesce(nullif({pid}, ''), '?') END AS {side}_column,
  CASE WHEN {full} THEN {parts}[2] ELSE '?' END AS {side}_table,
  CASE WHEN {full} THEN {parts}[3] ELSE '?' END AS {side}_schema,
  CASE WHEN {full} THEN array_to_string({parts}[4:], '@') ELSE '?' END AS {side}_connector"""


@query(f"""{ctes("edges_override")}, d AS (SELECT DISTINCT source_element_pid, target_element_pid,
  source_type FROM edges_override)
SELECT {_readable("source_element_pid", "source")}, {_readable("target_element_pid", "target")},
  source_type FROM d""")
def lineage_readable(spark, sf_dir):
    edges = load(spark, sf_dir, "edges_override").select(*lineage.EDGE_KEY)
    return lineage.readable_edges(lineage.dedup_edges(edges))


_FK_PAIRS = f"""{ctes("raw_imported_keys_all")}, k AS (SELECT *,
  coalesce(fk_name, 'FK_' || table_name || '_' || pktable_name) AS cname,
  coalesce(nullif(pktable_schem, ''), nullif(pktable_cat, ''), schema_name) AS rs
  FROM raw_imported_keys_all), f AS (SELECT *, first_value(rs) OVER w AS ref_schema,
  first_value(pktable_name) OVER w AS ref_table FROM k
  WINDOW w AS (PARTITION BY connector_id, schema_name, table_name, cname ORDER BY seq))"""


@query(f"""{_FK_PAIRS}
SELECT fkcolumn_name || '@' || table_name || '@' || schema_name || '@' || connector_id AS source_element_pid,
  pkcolumn_name || '@' || ref_table || '@' || ref_schema || '@' || connector_id AS target_element_pid,
  'FK' AS source_type FROM f""")
def fk_edges(spark, sf_dir):
    fks = discovery.assemble_foreign_keys(load(spark, sf_dir, "raw_imported_keys_all"))
    return lineage.fk_edges(fks)


@query(f"""{_FK_PAIRS}, {ctes("connectors")[5:]}, j AS (SELECT f.*, 'APP-DISC-' ||
  regexp_replace(upper(f.connector_id), '[^A-Z0-9]', '-', 'g') || '-' || c.database_type || '-01' AS app
  FROM f JOIN connectors c ON f.connector_id = c.connector_id)
SELECT app AS application_pid, 'FK' AS lineage_source,
  upper(fkcolumn_name) || '@' || upper(table_name) || '@' || upper(schema_name) || '@' || app AS source_element_pid,
  upper(pkcolumn_name) || '@' || upper(ref_table) || '@' || upper(ref_schema) || '@' || app AS target_element_pid
FROM j""")
def fk_lineage_payload(spark, sf_dir):
    fks = discovery.assemble_foreign_keys(load(spark, sf_dir, "raw_imported_keys_all"))
    return lineage.fk_lineage_payload(fks, load(spark, sf_dir, "connectors"))
