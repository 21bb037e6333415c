"""Queries over catalog tables: scalar functions, searches, pages, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemeta.functions import datatypes, pids
from lakemeta.functions import fixed_values as fx
from lakemeta.functions import redact
from lakemeta.model import COLUMN_KEY
from lakemeta.operators import catalog
from lakemeta.plans import oracle_parts as parts
from lakemeta.plans.inputs import workload_catalog
from lakemeta.plans.registry import query
from lakemeta.plans.workloads import ctes, load, sql, table
from lakemeta.session import materialize

# --- scalar functions over the wide catalog --------------------------------------------------

_APP = ("'APP-DISC-' || regexp_replace(upper(c.connector_id), '[^A-Z0-9]', '-', 'g') || '-' "
        "|| coalesce(k.database_type, 'UNKNOWN') || '-01'")


@query(f"""{ctes("columns_plain", "connectors")}
SELECT {_APP} AS app_pid, upper(schema_name) || '@' || {_APP} AS container_pid,
  upper(table_name) || '@' || upper(schema_name) || '@' || {_APP} AS entity_pid,
  upper(column_name) || '@' || upper(table_name) || '@' || upper(schema_name) || '@' || {_APP} AS element_pid
FROM columns_plain c LEFT JOIN connectors k ON c.connector_id = k.connector_id""")
def element_pids(spark, sf_dir):
    columns = load(spark, sf_dir, "columns_plain")
    types = load(spark, sf_dir, "connectors").select("connector_id", "database_type")
    app = F.col("app_pid")
    return (columns.join(types, "connector_id", "left")
            .withColumn("app_pid", pids.app_pid("connector_id", "database_type"))
            .select("app_pid", pids.container_pid("schema_name", app).alias("container_pid"),
                    pids.table_pid(app).alias("entity_pid"),
                    pids.column_pid(app).alias("element_pid")))


def dtype_sql(native: str) -> str:
    name = f"regexp_replace(lower({native}), '\\(.*\\)', '')"
    name = f"regexp_replace({name}, '\\b(unsigned|signed|zerofill|identity)\\b', '', 'g')"
    name = f"trim(regexp_replace({name}, '\\s+', ' ', 'g'))"
    arms = " ".join("WHEN {} IN ({}) THEN '{}'".format(name, ", ".join(f"'{n}'" for n in names), family)
                    for family, names in fx.TYPE_FAMILIES.items())
    return f"CASE {arms} ELSE '{fx.DEFAULT_TYPE}' END"


def pii_sql(name: str) -> str:
    return f"CASE WHEN regexp_matches({name}, '{fx.PII_PATTERN}', 'i') THEN 'Y' ELSE 'N' END"


@query(f"""{ctes("columns_plain")} SELECT connector_id, schema_name, table_name, column_name, data_type,
  {dtype_sql("data_type")} AS data_type_pid FROM columns_plain""")
def dtype_mapping(spark, sf_dir):
    columns = load(spark, sf_dir, "columns_plain").select(*COLUMN_KEY, "data_type")
    return datatypes.with_data_type_pid(columns, "data_type")


@query(f"""{ctes("columns_plain")} SELECT connector_id, schema_name, table_name, column_name,
  {pii_sql("column_name")} AS pii_indicator FROM columns_plain""")
def pii_columns(spark, sf_dir):
    return load(spark, sf_dir, "columns_plain").select(
        *COLUMN_KEY, datatypes.pii_indicator("column_name").alias("pii_indicator"))


# --- redaction -------------------------------------------------------------------------------

def _redact_sql(text: str) -> str:
    text = f"regexp_replace({text}, 'bearer\\s+[A-Za-z0-9._~+/=-]*', 'Bearer *****', 'gi')"
    for key in fx.SECRET_KEYS:
        for pattern, mask in ((f"{key}[=:]\\s*[^\\s@]*@\\S*", ":*****@"),
                              (f"({key})(=\\s*\\S+|:\\s*[^\\s=]*=\\S*)", "\\1=*****"),
                              (f"({key}):\\s*\\S+", "\\1:*****")):
            text = f"regexp_replace({text}, '{pattern}', '{mask}', 'gi')"
    return f"regexp_replace({text}, ':[^@\\s]+@', ':*****@', 'g')"


@query(f"{ctes('log_text')} SELECT event_id, {_redact_sql('message')} AS message FROM log_text")
def redacted_logs(spark, sf_dir):
    return redact.redact_credentials(load(spark, sf_dir, "log_text"), "message")


@query(f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def redacted_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redact.redact_credentials(documents, "text")


def _chain_sql(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, mask in rules:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        pattern = pattern.removeprefix("(?i)").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{mask.replace('$1', chr(92) + '1')}', '{flags}')"
    return text


@query(f"""{ctes("http_text")} SELECT event_id, {_chain_sql("message", fx.HTTP_BODY_MASKS)} AS message
FROM http_text""")
def redacted_http(spark, sf_dir):
    return redact.redact_http_body(load(spark, sf_dir, "http_text"), "message")


@query(f"""{ctes("service_text")} SELECT event_id,
  coalesce({_chain_sql("message", fx.SERVICE_ERROR_MASKS)}, '{fx.MISSING_ERROR}') AS message
FROM service_text""")
def redacted_service(spark, sf_dir):
    return redact.redact_service_error(load(spark, sf_dir, "service_text"), "message")


# --- searches --------------------------------------------------------------------------------

@query(f"""WITH c AS ({sql("catalog_columns_all")}) SELECT connector_id, schema_name, table_name,
  column_name, data_type, full_data_type FROM c
WHERE connector_id = 'conn-3' AND regexp_matches(column_name, '.*_(id|AT)$', 'i')""")
def search_columns(spark, sf_dir):
    return catalog.search_columns(load(spark, sf_dir, "catalog_columns_all"), ".*_(id|AT)$", "conn-3")


@query(f"""WITH c AS ({sql("catalog_columns_all")}) SELECT connector_id, schema_name, table_name,
  column_name, data_type FROM c WHERE lower(schema_name) = 's42'""")
def schema_filter(spark, sf_dir):
    found = catalog.get_schema(load(spark, sf_dir, "catalog_columns_all"), "S42")
    return found.select(*COLUMN_KEY, "data_type")


@query(f"""WITH c AS ({sql("catalog_columns_all")}) SELECT connector_id AS connector,
  schema_name AS "schema", table_name AS "table", column_name AS "column", data_type AS "dataType",
  full_data_type AS "fullDataType", is_nullable AS nullable, is_primary_key AS "isPrimaryKey" FROM c""")
def column_inventory(spark, sf_dir):
    return catalog.column_inventory(load(spark, sf_dir, "catalog_columns_all"))


_USING = " AND ".join(f"c.{k} = {{0}}.{k}" for k in ("connector_id", "schema_name", "table_name"))


@query(f"""WITH c AS ({sql("catalog_columns_all")}), {parts.primary_keys("all")}, {parts.foreign_keys("all")},
fm AS (SELECT {parts.T}, flatten(list(members)) AS members FROM fk GROUP BY {parts.T})
SELECT c.connector_id, c.schema_name, c.table_name, c.ordinal_position, c.column_name, c.full_data_type,
  CASE WHEN is_nullable THEN 'YES' ELSE 'NO' END AS nullable,
  coalesce(column_default, '') AS column_default, coalesce(column_comment, '') AS column_comment,
  coalesce(list_contains(pk.members, column_name), FALSE) AS pk_badge,
  coalesce(list_contains(fm.members, column_name), FALSE) AS fk_badge
FROM c LEFT JOIN pk ON {_USING.format("pk")} LEFT JOIN fm ON {_USING.format("fm")}""")
def column_sheet(spark, sf_dir):
    return materialize(catalog.column_sheet(workload_catalog(spark, sf_dir)), "column-sheet", stay=True)


# --- snapshots -------------------------------------------------------------------------------

_AS_OF = "1998-06-01 00:00:00"
_RANKED = """SELECT *, row_number() OVER (PARTITION BY connector_id
  ORDER BY discovered_at DESC, snapshot_id DESC) AS rn FROM {0}"""
_SNAP = "connector_id, snapshot_id, database_name, discovered_at, duration_ms"


@query(f"{ctes('snapshots')} SELECT {_SNAP} FROM ({_RANKED.format('snapshots')}) WHERE rn = 1")
def latest_snapshot(spark, sf_dir):
    return catalog.latest_snapshots(load(spark, sf_dir, "snapshots"))


@query(f"""{ctes("snapshots")}, w AS (SELECT * FROM snapshots WHERE discovered_at <= TIMESTAMP '{_AS_OF}'
  AND discovered_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 720 HOUR)
SELECT {_SNAP} FROM ({_RANKED.format("w")}) WHERE rn = 1""")
def fresh_snapshots(spark, sf_dir):
    return catalog.fresh_snapshots(load(spark, sf_dir, "snapshots"), _AS_OF, ttl_hours=720)


@query(f"""{ctes("snapshots")} SELECT {_SNAP} FROM snapshots
ORDER BY discovered_at DESC, snapshot_id DESC LIMIT 100""")
def retained_snapshots(spark, sf_dir):
    return catalog.retain_newest(load(spark, sf_dir, "snapshots"), 100)


@query(f"""{ctes("snapshots")}, conn AS (SELECT 'conn-' || CAST(c_custkey AS STRING) AS connector_id,
  c_mktsegment AS database_type, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL
  ELSE c_name END AS password FROM customer),
last AS (SELECT connector_id, max(discovered_at) AS last_discovered_at FROM snapshots GROUP BY 1)
SELECT conn.connector_id, database_type,
  CASE WHEN password <> '' THEN '********' ELSE '' END AS password, last_discovered_at,
  last_discovered_at IS NOT NULL AS has_cached_discovery
FROM conn LEFT JOIN last ON conn.connector_id = last.connector_id""")
def connector_status(spark, sf_dir):
    connectors = table(spark, sf_dir, "customer").selectExpr(
        "'conn-' || CAST(c_custkey AS STRING) AS connector_id", "c_mktsegment AS database_type",
        "CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END AS password")
    return catalog.connector_status(connectors, load(spark, sf_dir, "snapshots"))
