"""Catalog-shaped workloads derived from the driver tables.

Each is one SELECT in the SQL subset Spark and DuckDB share, so a query and its oracle start from
the same rows: ``load`` runs it on Spark over the parquet tables, ``sql`` renders it for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemeta.session import dealt
from lakemeta.sources.files import read_table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def pick(index: str, items: list[str | None]) -> str:
    """CASE that turns a 0-based integer expression into one of ``items``."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(items))
    return f"CASE ({index}) {arms} END"


COLUMN_NAMES = ["email", "user_id", "created_at", "phone_number", "ssn", "order_total",
                "password_hash", "first_name", "address_line", "status", "dob", "api_key",
                "quantity", "passport_no", "notes", "updated_at"]
NATIVE_TYPES = ["varchar(255)", "INT UNSIGNED", "numeric(10,2)", "timestamp(6) with time zone",
                "text", "bigint", "bpchar", "boolean", "date", "double precision", "jsonb",
                "tinyint identity"]
DATABASE_TYPES = ["POSTGRESQL", "MYSQL", "MSSQL", "ORACLE", "SNOWFLAKE", "REDSHIFT", "TERADATA",
                  "DREMIO"]

_TABLE_KEY = """'conn-' || CAST(l_suppkey % 10 AS STRING) AS connector_id,
    's' || CAST(l_suppkey AS STRING) AS schema_name,
    't' || CAST(l_partkey AS STRING) AS table_name"""
_KEY_CELLS = [cell.rpartition(" AS ")[0] for cell in _TABLE_KEY.split(",\n    ")]
_COLUMN_NAME = pick("(l_partkey + l_linenumber) % 16", COLUMN_NAMES)

# Sides of a catalog: all of it, and an old and a new one that drop other schemas, tables and columns.
_KEEP = {
    "all": "1 = 1",
    "old": "l_suppkey % 19 <> 3 AND (l_suppkey + l_partkey) % 23 <> 5 "
           "AND (l_partkey + l_linenumber) % 11 <> 0",
    "new": "l_suppkey % 17 <> 2 AND (l_suppkey + l_partkey) % 29 <> 7 "
           "AND (l_partkey + l_linenumber) % 11 <> 1",
}
_CHANGED = {"all": "1 = 0", "old": "1 = 0", "new": "l_partkey % 13 = 0"}


def _catalog_columns(side: str) -> str:
    native = pick(f"(l_suppkey + l_linenumber + CASE WHEN {_CHANGED[side]} THEN 1 ELSE 0 END) % 12",
                  NATIVE_TYPES)
    return f"""SELECT DISTINCT {_TABLE_KEY},
    {_COLUMN_NAME} AS column_name,
    l_linenumber AS ordinal_position,
    {native} AS data_type,
    {native} AS full_data_type,
    l_linenumber % 2 = 0 AS is_nullable,
    CASE WHEN {_CHANGED[side]} AND l_linenumber = 4 THEN '0' END AS column_default,
    CASE WHEN l_linenumber % 3 = 0 THEN 255 END AS character_max_length,
    CASE WHEN l_linenumber % 3 = 1 THEN 10 END AS numeric_precision,
    CASE WHEN l_linenumber % 3 = 1 THEN 2 END AS numeric_scale,
    CASE WHEN l_linenumber = 5 THEN {"NULL" if side == "new" else "''"}
         WHEN l_linenumber = 6 THEN 'note, "' || CAST(l_partkey % 5 AS STRING) || '"'
    END AS column_comment,
    l_linenumber <= 2 AS is_primary_key,
    l_linenumber = 1 AS is_auto_increment
  FROM {{lineitem}} WHERE {_KEEP[side]}"""


def _catalog_tables(side: str) -> str:
    return f"""SELECT DISTINCT {_TABLE_KEY},
    CASE WHEN l_partkey % 6 = 0 THEN 'VIEW' ELSE 'TABLE' END AS table_type,
    CASE WHEN l_partkey % 4 = 0 THEN 'comment ' || CAST(l_partkey % 9 AS STRING)
         WHEN l_partkey % 4 = 1 THEN '' END AS table_comment,
    CASE WHEN l_partkey % 3 > 0 THEN l_partkey * 7919 END AS estimated_row_count,
    CASE WHEN l_partkey % 5 = 0 THEN l_partkey
         WHEN l_partkey % 5 = 1 THEN l_partkey * 1024 + 300
         WHEN l_partkey % 5 = 2 THEN l_partkey * 1048576 + 5000
         WHEN l_partkey % 5 = 3 THEN l_partkey * 1073741824 END AS size_bytes
  FROM {{lineitem}} WHERE {_KEEP[side]}"""


def _raw_keys(side: str) -> str:
    return f"""SELECT DISTINCT {_TABLE_KEY},
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'pk_t' || CAST(l_partkey AS STRING) END AS pk_name,
    l_linenumber % 3 AS key_seq,
    {_COLUMN_NAME} AS column_name,
    l_linenumber AS seq
  FROM {{lineitem}} WHERE {_KEEP[side]}"""


def _raw_imported_keys(side: str) -> str:
    referenced = f"(l_partkey + CASE WHEN {_CHANGED[side]} THEN 3 ELSE 1 END) % 50"
    return f"""SELECT DISTINCT {_TABLE_KEY},
    CASE WHEN l_linenumber % 4 = 0 THEN NULL
         ELSE 'fk_' || CAST(l_linenumber % 2 AS STRING) END AS fk_name,
    CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN ''
         ELSE 'ref' || CAST(l_suppkey % 7 AS STRING) END AS pktable_schem,
    CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 5 = 1 THEN NULL
         ELSE 'cat' || CAST(l_suppkey % 4 AS STRING) END AS pktable_cat,
    'p' || CAST({referenced} AS STRING) AS pktable_name,
    {_COLUMN_NAME} AS fkcolumn_name,
    'k' || CAST(l_linenumber % 5 AS STRING) AS pkcolumn_name,
    l_linenumber AS seq
  FROM {{lineitem}} WHERE {_KEEP[side]}"""


def _raw_index_info(side: str) -> str:
    return f"""SELECT DISTINCT {_TABLE_KEY},
    CASE WHEN l_linenumber = 7 THEN NULL
         ELSE 'ix_' || CAST(l_linenumber % 3 AS STRING) END AS index_name,
    CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN 0 ELSE 3 END AS type,
    (l_partkey + l_linenumber + CASE WHEN {_CHANGED[side]} THEN 1 ELSE 0 END) % 2 = 0 AS non_unique,
    CASE WHEN l_linenumber = 6 THEN NULL ELSE {_COLUMN_NAME} END AS column_name,
    l_linenumber AS seq
  FROM {{lineitem}} WHERE {_KEEP[side]}"""


def _orders_snapshot(side: str) -> str:
    status = "o_orderstatus" if side == "old" else \
        "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END"
    keep = "o_orderkey % 10 <> 0" if side == "old" else "o_orderkey % 10 <> 1"
    return f"""SELECT o_orderkey, o_custkey, {status} AS o_orderstatus, o_totalprice, o_orderpriority
  FROM {{orders}} WHERE {keep}"""


def _upsert_rows(keep: str) -> str:
    return f"""SELECT DISTINCT
    upper({_COLUMN_NAME}) || '@T' || CAST(l_partkey AS STRING) || '@S' || CAST(l_suppkey AS STRING)
      || '@APP-DISC-CONN-' || CAST(l_suppkey % 10 AS STRING) || '-01' AS pid,
    'element' AS kind,
    'T' || CAST(l_partkey AS STRING) || '@S' || CAST(l_suppkey AS STRING)
      || '@APP-DISC-CONN-' || CAST(l_suppkey % 10 AS STRING) || '-01' AS parent_pid,
    {_COLUMN_NAME} AS name,
    {pick("(l_suppkey + l_linenumber) % 12", NATIVE_TYPES)} AS description,
    l_linenumber AS position
  FROM {{lineitem}} WHERE {keep}"""


WORKLOADS = {
    # Lineage edges: heavy repetition, five providers, two applications.
    "edges": """SELECT
    'C' || CAST(l_partkey % 50 AS STRING) || '@PART' || CAST(l_partkey % 7 AS STRING)
      || '@SRC@APP-DISC-' || l_returnflag || '-01' AS source_element_pid,
    'C' || CAST(l_suppkey % 20 AS STRING) || '@SUPP' || CAST(l_suppkey % 3 AS STRING)
      || '@TGT@APP-DISC-' || CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END || '-01'
      AS target_element_pid,
    CASE l_linenumber % 5 WHEN 0 THEN 'FK' WHEN 1 THEN 'OPERATIONAL' WHEN 2 THEN 'ETL'
      WHEN 3 THEN 'MANUAL' ELSE 'SQL_PARSER' END AS source_type
  FROM {lineitem}""",
    # Edges with an arrival order and application overrides; one pair holds a third of all rows.
    "edges_override": """SELECT
    CASE WHEN o_orderkey % 3 = 0 THEN 'HOT@T@S@APP-A'
         ELSE 'C' || CAST(o_custkey % 90 AS STRING) || '@T@S@APP-A' END AS source_element_pid,
    CASE WHEN o_orderkey % 3 = 0 THEN 'HOT@U@S@APP-B'
         WHEN o_custkey % 4 = 0 THEN 'plain'
         ELSE 'D' || CAST(o_custkey % 70 AS STRING) || '@U@S@APP-B' END AS target_element_pid,
    CASE o_orderkey % 5 WHEN 0 THEN 'FK' WHEN 1 THEN 'OPERATIONAL' WHEN 2 THEN 'ETL'
      WHEN 3 THEN 'MANUAL' ELSE 'SQL_PARSER' END AS source_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'APP-B'
         WHEN o_orderpriority = '2-HIGH' THEN '' END AS source_app_pid,
    CASE WHEN o_orderstatus = 'P' THEN 'APP-A' END AS target_app_pid,
    o_orderkey AS seq
  FROM {orders}""",
    "columns_plain": f"""SELECT DISTINCT {_TABLE_KEY},
    l_linenumber AS ordinal_position,
    {_COLUMN_NAME} AS column_name,
    {pick("(l_suppkey + l_linenumber) % 12", NATIVE_TYPES)} AS data_type
  FROM {{lineitem}}""",
    "connectors": f"""SELECT 'conn-' || CAST(s_suppkey AS STRING) AS connector_id,
    {pick("s_suppkey % 8", DATABASE_TYPES)} AS database_type,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN ''
         ELSE 'Db' || CAST(s_suppkey % 3 AS STRING) END AS database_name
  FROM {{supplier}}""",
    "raw_schemas": f"""SELECT DISTINCT 'conn-' || CAST(l_suppkey AS STRING) AS connector_id,
    CASE WHEN l_suppkey % 5 = 0 THEN {pick("l_partkey % 4", ["information_schema", "INFORMATION_SCHEMA", "sys", "SYS"])}
         ELSE {pick("l_partkey % 9", ["pg_catalog", "information_schema", "INFORMATION_SCHEMA", "sys", "SYS", "DBC", "sales", "Hr", None])} END
      AS table_schem,
    CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'DB0' ELSE 'db1' END AS table_catalog
  FROM {{lineitem}}""",
    "raw_catalogs": f"""SELECT DISTINCT 'conn-' || CAST(l_suppkey AS STRING) AS connector_id,
    CASE WHEN l_suppkey % 10 = 0 THEN 'sys' ELSE
      {pick("l_partkey % 5", ["DBC", "main", "SYS", "sys", None])} END AS table_cat
  FROM {{lineitem}}""",
    "raw_tables": f"""SELECT DISTINCT {_TABLE_KEY},
    {pick("l_partkey % 5", ["TABLE", "VIEW", "SYSTEM TABLE", "MATERIALIZED VIEW", None])} AS table_type,
    {pick("l_partkey % 3", ["", None, "remark"])} AS remarks
  FROM {{lineitem}}""",
    "raw_columns": f"""SELECT DISTINCT {_TABLE_KEY},
    {_COLUMN_NAME} AS column_name,
    l_linenumber AS ordinal_position,
    {pick("(l_suppkey + l_linenumber) % 12", ["VARCHAR", "int4", "NUMERIC", "NVarChar2", "text", "NUMBER", "CLOB", "BOOLEAN", None, "Decimal", "String", "bigint"])} AS type_name,
    CAST((l_partkey % 5) * 10 AS INT) AS column_size,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 - 1 END AS decimal_digits,
    CAST(l_partkey % 3 AS INT) AS nullable,
    {pick("l_partkey % 4", [None, "", "0", "now()"])} AS column_def,
    {pick("l_partkey % 3", ["", None, "remark"])} AS remarks,
    {pick("l_linenumber % 4", ["YES", "yes", "NO", None])} AS is_autoincrement
  FROM {{lineitem}}""",
    **{f"raw_primary_keys_{side}": _raw_keys(side) for side in _KEEP},
    **{f"raw_imported_keys_{side}": _raw_imported_keys(side) for side in _KEEP},
    **{f"raw_index_info_{side}": _raw_index_info(side) for side in _KEEP},
    **{f"catalog_columns_{side}": _catalog_columns(side) for side in _KEEP},
    **{f"catalog_tables_{side}": _catalog_tables(side) for side in _KEEP},
    **{f"orders_{side}": _orders_snapshot(side) for side in ("old", "new")},
    "snapshots": """SELECT 'conn-' || CAST(o_custkey AS STRING) AS connector_id,
    CAST(o_orderkey AS STRING) AS snapshot_id,
    'db' || CAST(o_custkey % 5 AS STRING) AS database_name,
    o_orderdate AS discovered_at,
    o_orderkey % 5000 AS duration_ms
  FROM {orders}""",
    "runs": """SELECT event_id AS run_id, user_id AS job_id, ts AS started_at,
    CASE WHEN event_type = 'click' THEN NULL
         ELSE CAST(round(value * 1000) AS BIGINT) END AS duration_ms,
    CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'view' THEN 'NO_CHANGES'
      WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'TIMED_OUT' END AS status,
    CASE WHEN event_type = 'error' THEN 'boom' WHEN event_type = 'signup'
      THEN 'Job timed out after 600s' END AS error
  FROM {events}""",
    "log_text": """SELECT event_id,
    'connect user' || CAST(user_id AS STRING) || ':pw' || CAST(event_id AS STRING)
      || '@db:5432 password=s' || CAST(event_id AS STRING) || ' token: t'
      || CAST(user_id AS STRING) || ' Bearer abc' || CAST(event_id AS STRING) AS message
  FROM {events}""",
    "http_text": """SELECT event_id,
    'HTTP 401 {{"authorization": "Basic x' || CAST(event_id AS STRING) || '", "api_key": "k'
      || CAST(user_id AS STRING) || '", cookie=c' || CAST(event_id AS STRING)
      || '; X-Api-Key: z' || CAST(user_id AS STRING) || ' Bearer q'
      || CAST(event_id AS STRING) || ' ' || event_type AS message
  FROM {events}""",
    "service_text": """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE
    'jdbc:db://u:pw' || CAST(event_id AS STRING) || '@host/db Password=' || CAST(user_id AS STRING)
      || ' pwd: ' || CAST(event_id AS STRING) || ' APIKEY=' || CAST(user_id AS STRING)
      || ' end' END AS message
  FROM {events}""",
    # One metadata document per order: every optional part is missing, empty or filled somewhere.
    "iceberg_documents": """SELECT 'ns' || CAST(o_custkey % 20 AS STRING) AS namespace,
    't' || CAST(o_orderkey AS STRING) AS table_name,
    '{{"metadata":{{' || CASE WHEN o_orderkey % 4 = 3 THEN ''
        ELSE '"current-schema-id":' || CAST(o_orderkey % 4 AS STRING) || ',' END
      || '"schemas":[{{"schema-id":0,"fields":['
      || '{{"id":1,"name":"ID","required":true,"type":"Long"}},'
      || '{{"id":2,"name":"amount","required":false,"type":"decimal(' || CAST(o_custkey % 30 + 3 AS STRING)
      || ', 2)","doc":"total ' || o_orderpriority || '"}}]}},'
      || '{{"schema-id":1,"fields":[{{"id":1,"name":"hash","type":"fixed[' || CAST(o_custkey % 64 AS STRING)
      || ']"}},{{"id":2,"name":"tags","required":false,"type":{{"type":"list","element":"string"}}}},'
      || '{{"id":3,"name":"s","required":true,"type":{{"fields":[]}},"doc":""}}]}}]'
      || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',"partition-specs":[{{"spec-id":0,"fields":[]}}]'
         ELSE ',"partition-specs":[{{"spec-id":0,"fields":[]}},{{"spec-id":1,"fields":['
           || '{{"name":"day","transform":"day"}},{{"name":"b","transform":"bucket['
           || CAST(o_custkey % 16 AS STRING) || ']"}}]}}]' END
      || CASE WHEN o_custkey % 2 = 0
         THEN ',"sort-orders":[{{"order-id":1,"fields":[{{"source-id":1}},{{"source-id":2}}]}}]' ELSE '' END
      || CASE o_custkey % 4 WHEN 0 THEN ',"properties":{{}}' WHEN 1 THEN ',"properties":{{"a":"1"}}'
         WHEN 2 THEN ',"properties":{{"a":"1","b":"2"}}' ELSE '' END
      || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"snapshots":[]'
         WHEN 2 THEN ',"snapshots":[{{"snapshot-id":1}}]'
         ELSE ',"snapshots":[{{"summary":{{"total-records":"5"}}}},{{"summary":{{"total-records":"'
           || CAST(o_orderkey * 11 AS STRING) || '"}}}}]' END
      || '}}}}' AS document
  FROM {orders}""",
    # Repeated keys: one key holds a third of the batch.
    "upsert_base": """SELECT 'P' || CAST(c_custkey AS STRING) AS pid, c_name AS name,
    c_mktsegment AS description FROM {customer} WHERE c_custkey % 2 = 0""",
    "upsert_batch": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'HOT'
      ELSE 'P' || CAST(o_custkey AS STRING) END AS pid, o_orderpriority AS name,
    o_orderstatus AS description, o_orderkey AS seq FROM {orders}""",
    "lineage_store": """SELECT DISTINCT 'APP-' || CAST(c_custkey % 3 AS STRING) AS application_pid,
    'C' || CAST(c_custkey % 300 AS STRING) || '|C' || CAST((c_custkey * 7) % 300 AS STRING) AS edge_key,
    'C' || CAST(c_custkey % 300 AS STRING) AS source_element_pid,
    'C' || CAST((c_custkey * 7) % 300 AS STRING) AS target_element_pid,
    'FK' AS lineage_source
  FROM {customer} WHERE c_custkey % 300 <> (c_custkey * 7) % 300""",
    "lineage_batch": """SELECT 'APP-' || CAST(o_custkey % 3 AS STRING) AS application_pid,
    'C' || CAST(o_custkey % 300 AS STRING) AS source_element_pid,
    'C' || CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 7 ELSE o_orderkey END % 300 AS STRING)
      AS target_element_pid,
    CASE o_orderkey % 7 WHEN 0 THEN 'FK' WHEN 1 THEN 'OPERATIONAL' WHEN 2 THEN 'ETL'
      WHEN 3 THEN 'MANUAL' WHEN 4 THEN 'SQL_PARSER' WHEN 5 THEN NULL ELSE 'GUESS' END AS lineage_source,
    o_orderkey AS seq FROM {orders}""",
    "finished_runs": """SELECT event_id AS run_id,
    CASE WHEN event_type = 'signup' THEN 'Job timed out after 600s'
      WHEN event_type = 'error' THEN 'connection refused' END AS error,
    CASE WHEN event_type IN ('purchase', 'click') THEN user_id % 2 = 0 END AS has_changes
  FROM {events}""",
    "store_rows": _upsert_rows("l_linenumber < 5"),
    "batch_rows": _upsert_rows("l_linenumber > 3"),
}
# A literal brace in a workload is doubled for both renderers.
_PLACEHOLDER = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a workload. Distinct rows of a catalog are dealt by their table while they are still the narrow rows they
    are made of: that DISTINCT, and keys and joins of a table's rows above it, then find a table's rows together."""
    text = WORKLOADS[name]
    by_table = re.match(rf"SELECT DISTINCT {re.escape(_TABLE_KEY)},", text)
    inputs = {t: dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet"), *map(F.expr, _KEY_CELLS)) if by_table
              else table(spark, sf_dir, t) for t in set(_PLACEHOLDER.findall(text))}
    return spark.sql(text, **inputs)


def sql(name: str) -> str:
    text = _PLACEHOLDER.sub(r"\1", WORKLOADS[name])
    return text.replace("{{", "{").replace("}}", "}")


def ctes(*names: str) -> str:
    """``WITH`` clause naming the given workloads."""
    return "WITH " + ", ".join(f"{name} AS ({sql(name)})" for name in names)
