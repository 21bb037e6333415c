"""Ingest rows, deltas and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemeta.functions import fixed_values as fx
from lakemeta.functions.describe import entity_description
from lakemeta.model import TABLE_KEY
from lakemeta.operators import diff, merge, payload
from lakemeta.plans import oracle_parts as parts
from lakemeta.plans.catalog_queries import dtype_sql, pii_sql
from lakemeta.plans.diff_queries import CATALOG, both
from lakemeta.plans.inputs import versions, workload_catalog
from lakemeta.plans.registry import query
from lakemeta.plans.workloads import ctes, load, sql
from lakemeta.session import materialize

_STORE = {"pid": "NULL", "kind": "NULL", "parent_pid": "NULL", "application_pid": "NULL", "name": "NULL",
          "description": "NULL", "type_pid": "NULL", "server": "NULL", "position": "NULL",
          "length": "NULL", "precision": "NULL", "scale": "NULL", "pii_indicator": "NULL",
          "is_active": "'Y'"}


def _row(**cells: str) -> str:
    return ", ".join(f'{value} AS "{name}"' for name, value in {**_STORE, **cells}.items())


def _with_app(relation: str) -> str:
    """The relation with ``app`` and ``database_type``; needs the ``connectors`` CTE."""
    return f"""(SELECT r.*, k.database_type, 'APP-DISC-' || regexp_replace(upper(r.connector_id), '[^A-Z0-9]',
  '-', 'g') || '-' || coalesce(k.database_type, 'UNKNOWN') || '-01' AS app
  FROM {relation} r LEFT JOIN connectors k ON r.connector_id = k.connector_id)"""


_CONTAINER = "upper(schema_name) || '@' || app"
_ENTITY = f"upper(table_name) || '@' || {_CONTAINER}"
_ELEMENT = f"upper(column_name) || '@' || {_ENTITY}"
_ENTITY_TYPE = "CASE WHEN table_type = 'VIEW' THEN 'ENT-TYP-VW' ELSE 'ENT-TYP-TBL' END"
_VERSION = "'Server release with a rather long product name, build ' || connector_id"


def _scaled(unit: int, label: str) -> str:
    """One decimal, ties away from zero (DuckDB's printf rounds ties to even)."""
    return f"printf('%.1f {label}', floor(size_bytes / {unit}.0 * 10 + 0.5) / 10)"


_BYTES = f"""CASE WHEN size_bytes < 1024 THEN size_bytes || ' B'
  WHEN size_bytes < 1048576 THEN {_scaled(1024, "KB")}
  WHEN size_bytes < 1073741824 THEN {_scaled(1048576, "MB")}
  WHEN size_bytes IS NOT NULL THEN {_scaled(1073741824, "GB")} END"""
_ENTITY_TEXT = f"""concat_ws(' ', table_type, '~' || format('{{:,}}', estimated_row_count) || ' rows',
  {_BYTES}, nullif(table_comment, ''))"""


def _containers(relation: str) -> str:
    return "SELECT {} FROM {}".format(_row(
        pid=_CONTAINER, kind="'container'", parent_pid="app", application_pid="app", name="schema_name",
        description=f"coalesce(database_type, 'UNKNOWN') || ' ' || {_VERSION} || ' — ' "
                    "|| schema_name || ' schema'",
        type_pid="'TYP-RDBMS'", server=f"'{fx.CONTAINER_SERVER}'"), _with_app(relation))


def _entities(relation: str) -> str:
    return "SELECT {} FROM {}".format(_row(
        pid=_ENTITY, kind="'entity'", parent_pid=_CONTAINER, application_pid="app", name="table_name",
        description=_ENTITY_TEXT, type_pid=_ENTITY_TYPE), _with_app(relation))


def _elements(columns: str, fks: str) -> str:
    using = " AND ".join(f"c.{k} = m.{k}" for k in [*TABLE_KEY, "column_name"])
    flagged = f"""(SELECT c.*, m.column_name IS NOT NULL AS is_fk FROM {columns} c LEFT JOIN
  (SELECT DISTINCT {parts.T}, unnest(members) AS column_name FROM {fks}) m ON {using})"""
    return "SELECT {} FROM {}".format(_row(
        pid=_ELEMENT, kind="'element'", parent_pid=_ENTITY, application_pid="app", name="column_name",
        description="""concat_ws(' ', full_data_type, CASE WHEN NOT is_nullable THEN 'NOT NULL' END,
  CASE WHEN is_primary_key THEN 'PK' END, CASE WHEN is_auto_increment THEN 'AUTO_INCREMENT' END,
  nullif(column_comment, ''), CASE WHEN is_fk THEN 'FK' END)""",
        type_pid=dtype_sql("data_type"), position="ordinal_position", length="character_max_length",
        precision="numeric_precision", scale="numeric_scale", pii_indicator=pii_sql("column_name")),
        _with_app(flagged))


_WHOLE = f"""WITH connectors AS ({sql("connectors")}), t AS ({sql("catalog_tables_all")}),
s AS (SELECT DISTINCT connector_id, schema_name FROM t), c AS ({sql("catalog_columns_all")}),
{parts.foreign_keys("all")}"""


def _connectors(spark, sf_dir):
    return load(spark, sf_dir, "connectors")


@query(f"{_WHOLE} {_containers('s')}")
def container_rows(spark, sf_dir):
    connectors = _connectors(spark, sf_dir)
    return payload.container_rows(workload_catalog(spark, sf_dir).schemas, connectors, versions(connectors))


@query(f"{_WHOLE} {_entities('t')}")
def entity_rows(spark, sf_dir):
    return payload.entity_rows(workload_catalog(spark, sf_dir).tables, _connectors(spark, sf_dir))


@query(f"{_WHOLE} SELECT {parts.T}, {_ENTITY_TEXT} AS description FROM t")
def entity_descriptions(spark, sf_dir):
    return load(spark, sf_dir, "catalog_tables_all").select(*TABLE_KEY, entity_description(
        "table_type", "estimated_row_count", "size_bytes", "table_comment").alias("description"))


@query(f"{_WHOLE} {_elements('c', 'fk')}")
def element_payloads(spark, sf_dir):
    cat = workload_catalog(spark, sf_dir)
    return payload.element_rows(cat.columns, cat.foreign_keys, _connectors(spark, sf_dir))


# --- delta -----------------------------------------------------------------------------------

_OP = "CASE st WHEN 'added' THEN 'create' WHEN 'dropped' THEN 'delete' ELSE 'update' END"


def _ops(relation: str, kind: str, name: str, pid: str, where: str) -> str:
    return f"""SELECT connector_id, schema_name, {_OP} AS operation, '{kind}' AS entity_type,
  {name} AS name, {pid} AS pid, TRUE AS success, NULL AS error FROM {_with_app(relation)} WHERE {where}"""


_DELTA = f"""{CATALOG}, connectors AS ({sql("connectors")}), ops AS (
{_ops("sd", "schema", "schema_name", _CONTAINER, "st IN ('added', 'dropped')")} UNION ALL
{_ops("td", "table", "table_name", _ENTITY,
      "st IN ('added', 'dropped') OR (st = 'modified' AND NOT column_changes)")} UNION ALL
{_ops("cd", "column", "table_name || '.' || column_name", _ELEMENT, "st <> 'unchanged'")})"""


@query(f"{_DELTA} SELECT * FROM ops")
def delta_ops(spark, sf_dir):
    return payload.delta_ops(diff.catalog_diff(*both(spark, sf_dir)), _connectors(spark, sf_dir))


@query(f"""{_DELTA} SELECT count(*) FILTER (operation = 'create') AS created,
  count(*) FILTER (operation = 'update') AS updated, count(*) FILTER (operation = 'delete') AS deleted,
  CAST(0 AS BIGINT) AS skipped FROM ops""")
def delta_result(spark, sf_dir):
    return payload.delta_result(delta_ops(spark, sf_dir))


# The store refuses entities and elements of containers it lacks, here those whose schema ends in an odd digit.
_TRIED = f"""{_DELTA}, tried AS (SELECT * REPLACE (entity_type = 'schema' OR NOT odd AS success,
  CASE WHEN entity_type <> 'schema' AND odd THEN 'Container not found: ' || container END AS error)
  FROM (SELECT *, regexp_extract(pid, '[^@]*@[^@]*$') AS container,
    regexp_matches(upper(schema_name), '[13579]$') AS odd FROM ops))"""


def _tried(spark, sf_dir):
    old, new = both(spark, sf_dir)
    connectors = _connectors(spark, sf_dir)
    changes = diff.catalog_diff(old, new)
    container = F.substring_index("pid", "@", -2)
    rows = payload.delta_rows(changes, old, new, connectors, versions(load(spark, sf_dir, "connectors")))
    # Written once: what the store holds, what it accepts and what it refuses are all read from the rows.
    batch = materialize(rows.filter("kind <> 'container'").select("pid", F.col("parent_pid").alias("payload_id")), "batch", stay=True)
    batch = batch.withColumn("container_pid", container)
    store = batch.filter(~F.col("container_pid").rlike("[13579]@")).select(F.col("container_pid").alias("pid")).distinct()
    accepted, rejected = merge.split_entity_batch(store, batch)
    results = accepted.select("pid", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("pid", "error"))
    return payload.with_outcomes(payload.delta_ops(changes, connectors), results)


@query(f"{_TRIED} SELECT * EXCLUDE (container, odd) FROM tried")
def delta_outcomes(spark, sf_dir):
    return _tried(spark, sf_dir)


@query(f"""{_TRIED} SELECT count(*) FILTER (success AND operation = 'create') AS created,
  count(*) FILTER (success AND operation = 'update') AS updated,
  count(*) FILTER (success AND operation = 'delete') AS deleted, count(*) FILTER (NOT success) AS skipped FROM tried""")
def delta_result_with_failures(spark, sf_dir):
    return payload.delta_result(_tried(spark, sf_dir))


_SOFT = f"""{CATALOG}, connectors AS ({sql("connectors")}),
gone_tables AS MATERIALIZED (SELECT {parts.T}, TRUE AS gone FROM td WHERE st = 'dropped'), dead AS MATERIALIZED (
SELECT {_row(pid=_CONTAINER, kind="'container'", parent_pid="app", application_pid="app", name="schema_name",
             description="''", type_pid="'TYP-RDBMS'", server=f"'{fx.CONTAINER_SERVER}'", is_active="'N'")}
  FROM {_with_app("sd")} WHERE st = 'dropped'
UNION ALL SELECT {_row(pid=_ENTITY, kind="'entity'", parent_pid=_CONTAINER, application_pid="app",
                       name="table_name", description="''", type_pid=_ENTITY_TYPE, is_active="'N'")}
  FROM {_with_app("td")} WHERE st = 'dropped'
UNION ALL SELECT {_row(pid=_ELEMENT, kind="'element'", parent_pid=_ENTITY, application_pid="app",
                       name="column_name", description="CASE WHEN gone THEN '' ELSE 'DROPPED' END",
                       type_pid="'DTYPE-VARCHAR'",
                       position="CASE WHEN gone THEN CAST(o_ordinal_position AS INT) ELSE 0 END",
                       pii_indicator="'N'", is_active="'N'")}
  FROM (SELECT x.*, coalesce(g.gone, FALSE) AS gone FROM {_with_app("cd")} x LEFT JOIN gone_tables g
    ON g.connector_id = x.connector_id AND g.schema_name = x.schema_name AND g.table_name = x.table_name)
  WHERE st = 'dropped'),
alive AS MATERIALIZED (SELECT {_CONTAINER} AS pid FROM {_with_app("s_n")} UNION SELECT {_ENTITY} FROM {_with_app("t_n")}
  UNION SELECT {_ELEMENT} FROM {_with_app("c_n")})"""


@query(f"{_SOFT} SELECT dead.* FROM dead ANTI JOIN alive ON alive.pid = dead.pid")
def soft_deletes(spark, sf_dir):
    old, new = both(spark, sf_dir)
    return payload.soft_delete_rows(diff.catalog_diff(old, new), old, new, _connectors(spark, sf_dir))


# --- upserts ---------------------------------------------------------------------------------

def _keyed(spark, sf_dir):
    batch = load(spark, sf_dir, "batch_rows").withColumn("seq", F.col("position"))
    return load(spark, sf_dir, "store_rows"), batch


@query(f"""{ctes("store_rows", "batch_rows")} SELECT pid, position AS seq,
  CASE WHEN EXISTS (SELECT 1 FROM store_rows s WHERE s.pid = b.pid) THEN 'updated' ELSE 'created' END AS action,
  NULL AS error FROM batch_rows b""")
def upsert_results(spark, sf_dir):
    return merge.upsert_results(*_keyed(spark, sf_dir))


@query(f"""{ctes("store_rows", "batch_rows")} SELECT * FROM batch_rows UNION ALL SELECT * FROM store_rows s
WHERE NOT EXISTS (SELECT 1 FROM batch_rows b WHERE b.pid = s.pid)""")
def upsert_store(spark, sf_dir):
    return merge.upsert_store(*_keyed(spark, sf_dir))


_REPEATED = f"""{ctes("upsert_base", "upsert_batch")}, r AS (SELECT *,
  row_number() OVER (PARTITION BY pid ORDER BY seq) AS rn,
  row_number() OVER (PARTITION BY pid ORDER BY seq DESC) AS back,
  pid IN (SELECT pid FROM upsert_base) AS known FROM upsert_batch)"""


def _repeated(spark, sf_dir):
    return load(spark, sf_dir, "upsert_base"), load(spark, sf_dir, "upsert_batch")


@query(f"""{_REPEATED} SELECT pid, seq, CASE WHEN rn = 1 AND NOT known THEN 'created' ELSE 'updated' END AS action,
  NULL AS error FROM r""")
def repeated_upsert_results(spark, sf_dir):
    return merge.upsert_results(*_repeated(spark, sf_dir))


@query(f"""{_REPEATED} SELECT pid, name, description FROM r WHERE back = 1 UNION ALL
SELECT * FROM upsert_base WHERE pid NOT IN (SELECT pid FROM upsert_batch)""")
def repeated_upsert_store(spark, sf_dir):
    return merge.upsert_store(*_repeated(spark, sf_dir))


@query(f"""{_REPEATED}, a AS (SELECT CASE WHEN rn = 1 AND NOT known THEN 'created' ELSE 'updated' END AS action FROM r)
SELECT count(*) AS total, count(*) FILTER (action = 'created') AS created,
  count(*) FILTER (action = 'updated') AS updated, CAST(0 AS BIGINT) AS unchanged, CAST(0 AS BIGINT) AS failed,
  'completed' AS status FROM a""")
def ingestion_summary(spark, sf_dir):
    return merge.ingestion_summary(merge.upsert_results(*_repeated(spark, sf_dir)))


_PAYLOADS = f"""{ctes("store_rows", "batch_rows")}, known AS (
  SELECT DISTINCT regexp_replace(parent_pid, '^[^@]*@', '') AS pid FROM store_rows
  WHERE regexp_matches(parent_pid, '@S[0-9]*[02468]@')),
b AS (SELECT pid, parent_pid AS payload_id, regexp_replace(parent_pid, '^[^@]*@', '') AS container_pid
  FROM batch_rows)"""


def _payloads(spark, sf_dir):
    container = F.substring_index("parent_pid", "@", -2)
    store = (load(spark, sf_dir, "store_rows").filter(F.col("parent_pid").rlike("@S[0-9]*[02468]@"))
             .select(container.alias("pid")).distinct())
    batch = load(spark, sf_dir, "batch_rows").select(
        "pid", F.col("parent_pid").alias("payload_id"), container.alias("container_pid"))
    return merge.split_entity_batch(store, batch)


@query(f"""{_PAYLOADS} SELECT payload_id, container_pid, 'Container not found: ' || container_pid AS error,
  count(*) AS rejected_rows FROM b WHERE container_pid NOT IN (SELECT pid FROM known) GROUP BY ALL""")
def rejected_entities(spark, sf_dir):
    return merge.rejected_payloads(_payloads(spark, sf_dir)[1])


@query(f"""{_PAYLOADS} SELECT * FROM b WHERE container_pid IN (SELECT pid FROM known)""")
def accepted_entities(spark, sf_dir):
    return _payloads(spark, sf_dir)[0]


_EDGES = f"""{ctes("lineage_store", "lineage_batch")}, b AS (SELECT *, coalesce(lineage_source, 'FK') AS kind,
  source_element_pid || '|' || target_element_pid AS edge_key FROM lineage_batch),
v AS (SELECT *, row_number() OVER (PARTITION BY application_pid, edge_key ORDER BY seq) AS rn,
  row_number() OVER (PARTITION BY application_pid, edge_key ORDER BY seq DESC) AS back,
  EXISTS (SELECT 1 FROM lineage_store s WHERE s.application_pid = b.application_pid
    AND s.edge_key = b.edge_key) AS known
  FROM b WHERE kind <> 'GUESS' AND source_element_pid <> target_element_pid)"""


def _edge_upsert(spark, sf_dir):
    return merge.upsert_lineage(load(spark, sf_dir, "lineage_store"), load(spark, sf_dir, "lineage_batch"))


@query(f"""{_EDGES} SELECT application_pid, edge_key, seq,
  CASE WHEN rn = 1 AND NOT known THEN 'created' ELSE 'updated' END AS action, NULL AS error FROM v
UNION ALL SELECT application_pid, CASE WHEN kind <> 'GUESS' THEN source_element_pid || '→self' ELSE edge_key END,
  seq, 'failed', CASE WHEN kind = 'GUESS' THEN 'Invalid lineage_source: GUESS' ELSE 'Self-referencing edge' END
  FROM b WHERE kind = 'GUESS' OR source_element_pid = target_element_pid""")
def upsert_lineage(spark, sf_dir):
    return _edge_upsert(spark, sf_dir)[1]


@query(f"""{_EDGES} SELECT application_pid, edge_key, source_element_pid, target_element_pid,
  kind AS lineage_source FROM v WHERE back = 1
UNION ALL SELECT s.application_pid, s.edge_key, s.source_element_pid, s.target_element_pid, s.lineage_source
  FROM lineage_store s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.application_pid = s.application_pid
  AND v.edge_key = s.edge_key)""")
def upsert_lineage_store(spark, sf_dir):
    return _edge_upsert(spark, sf_dir)[0]


@query(f"""{_EDGES}, e AS (SELECT count(*) FILTER (rn = 1 AND NOT known) AS c,
  count(*) FILTER (rn > 1 OR known) AS u FROM v), {_REPEATED[5:]},
p AS (SELECT count(*) FILTER (rn = 1 AND NOT known) AS c, count(*) FILTER (rn > 1 OR known) AS u FROM r)
SELECT (SELECT c FROM e) + (SELECT c FROM p) AS total_created,
  (SELECT u FROM e) + (SELECT u FROM p) AS total_updated,
  (SELECT count(*) FROM b) - (SELECT count(*) FROM v) AS total_failed""")
def push_totals(spark, sf_dir):
    catalog_results = merge.upsert_results(*_repeated(spark, sf_dir))
    responses = merge.ingestion_summary(catalog_results, ["pid"]).drop("pid").unionByName(
        merge.ingestion_summary(_edge_upsert(spark, sf_dir)[1], ["application_pid"]).drop("application_pid"))
    return payload.push_totals(responses)
