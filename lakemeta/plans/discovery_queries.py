"""Queries over raw driver metadata and declared keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemeta.functions import fixed_values as fx
from lakemeta.model import COLUMN_KEY, TABLE_KEY
from lakemeta.operators import discovery, keys
from lakemeta.operators.limits import cap_per_group
from lakemeta.plans import oracle_parts as parts
from lakemeta.plans.inputs import workload_catalog
from lakemeta.plans.registry import query
from lakemeta.plans.workloads import ctes, load, sql, table

_SYSTEM = ", ".join(f"('{kind}', '{name}')" for kind, names in fx.SYSTEM_SCHEMAS.items() for name in names)


def _not_system(name: str) -> str:
    return f"""{name} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sys
      WHERE sys.kind = c.database_type AND sys.name = {name})"""


@query(f"""{ctes("connectors", "raw_schemas", "raw_catalogs")}, sys(kind, name) AS (VALUES {_SYSTEM}),
c AS (SELECT *, connector_id LIKE '%7' AS ex FROM connectors), cand AS (
  SELECT connector_id, unnest(['sales', 'information_schema']) AS schema_name, 0 AS tier FROM c WHERE ex
  UNION ALL SELECT connector_id, database_name, CASE WHEN database_type = 'MYSQL' THEN 1 ELSE 4 END
    FROM c WHERE NOT ex AND database_name IS NOT NULL
  UNION ALL SELECT c.connector_id, table_schem, 2 FROM raw_schemas r JOIN c ON r.connector_id = c.connector_id
    WHERE NOT ex AND database_type <> 'MYSQL' AND (table_catalog IS NULL
      OR coalesce(database_name, '') = '' OR lower(table_catalog) = lower(database_name))
      AND {_not_system("table_schem")}
  UNION ALL SELECT c.connector_id, table_cat, 3 FROM raw_catalogs r JOIN c ON r.connector_id = c.connector_id
    WHERE NOT ex AND database_type <> 'MYSQL' AND {_not_system("table_cat")})
SELECT connector_id, schema_name FROM (SELECT *, min(tier) OVER (PARTITION BY connector_id) AS best
  FROM cand) WHERE tier = best""")
def resolved_schemas(spark, sf_dir):
    explicit = F.split(F.lit("sales,information_schema"), ",")
    connectors = load(spark, sf_dir, "connectors").withColumn(
        "schemas", F.when(F.col("connector_id").endswith("7"), explicit))
    return discovery.resolve_schemas(
        load(spark, sf_dir, "raw_schemas"), load(spark, sf_dir, "raw_catalogs"), connectors)


@query(f"""{ctes("raw_tables")} SELECT connector_id, schema_name, table_name, table_type,
  nullif(remarks, '') AS table_comment FROM raw_tables WHERE table_type IN ('TABLE', 'VIEW')""")
def classified_tables(spark, sf_dir):
    return discovery.classify_tables(load(spark, sf_dir, "raw_tables"))


_TYPE_FLAGS = """SELECT *, coalesce(upper(type_name) SIMILAR TO '.*(CHAR|TEXT|CLOB|STRING).*', FALSE) AS is_str,
  coalesce(upper(type_name) SIMILAR TO '.*(NUMERIC|DECIMAL|NUMBER).*', FALSE) AS is_num FROM raw_columns"""


@query(f"""{ctes("raw_columns")}, t AS ({_TYPE_FLAGS})
SELECT connector_id, schema_name, table_name, column_name, ordinal_position,
  coalesce(lower(type_name), 'unknown') AS data_type,
  CASE WHEN type_name IS NULL THEN 'unknown'
    WHEN is_str AND column_size > 0 THEN lower(type_name) || '(' || column_size || ')'
    WHEN is_num AND column_size > 0 AND decimal_digits > 0
      THEN lower(type_name) || '(' || column_size || ',' || decimal_digits || ')'
    WHEN is_num AND column_size > 0 THEN lower(type_name) || '(' || column_size || ')'
    ELSE lower(type_name) END AS full_data_type,
  nullable = 1 AS is_nullable, column_def AS column_default,
  CASE WHEN is_str AND column_size > 0 THEN column_size END AS character_max_length,
  CASE WHEN is_num AND column_size > 0 THEN column_size END AS numeric_precision,
  CASE WHEN is_num THEN decimal_digits END AS numeric_scale,
  nullif(remarks, '') AS column_comment, FALSE AS is_primary_key,
  coalesce(upper(is_autoincrement) = 'YES', FALSE) AS is_auto_increment FROM t""")
def normalized_columns(spark, sf_dir):
    return discovery.normalize_columns(load(spark, sf_dir, "raw_columns"))


@query(f"""WITH {parts.primary_keys("all")}
SELECT {parts.T}, constraint_name, cols AS columns FROM pk""")
def primary_keys(spark, sf_dir):
    assembled = discovery.assemble_primary_keys(load(spark, sf_dir, "raw_primary_keys_all"))
    return assembled.withColumn("columns", F.array_join("columns", ","))


@query(f"""WITH {parts.primary_keys("all")}, c AS ({sql("columns_plain")})
SELECT c.connector_id, c.schema_name, c.table_name, c.column_name, c.ordinal_position,
  coalesce(list_contains(pk.members, c.column_name), FALSE) AS is_primary_key
FROM c LEFT JOIN pk ON c.connector_id = pk.connector_id AND c.schema_name = pk.schema_name
  AND c.table_name = pk.table_name""")
def pk_flagged_columns(spark, sf_dir):
    columns = load(spark, sf_dir, "columns_plain").select(
        *COLUMN_KEY, "ordinal_position", F.lit(False).alias("is_primary_key"))
    assembled = discovery.assemble_primary_keys(load(spark, sf_dir, "raw_primary_keys_all"))
    return discovery.flag_pk_columns(columns, assembled)


@query(f"""WITH {parts.foreign_keys("all")}
SELECT {parts.T}, constraint_name, cols AS columns, referenced_schema, referenced_table,
  ref_cols AS referenced_columns FROM fk""")
def foreign_keys(spark, sf_dir):
    assembled = discovery.assemble_foreign_keys(load(spark, sf_dir, "raw_imported_keys_all"))
    return (assembled.withColumn("columns", F.array_join("columns", ","))
            .withColumn("referenced_columns", F.array_join("referenced_columns", ",")))


@query(f"""WITH {parts.indexes("all")}
SELECT {parts.T}, index_name, cols AS columns, is_unique FROM ix""")
def indexes(spark, sf_dir):
    assembled = discovery.assemble_indexes(load(spark, sf_dir, "raw_index_info_all"))
    return assembled.withColumn("columns", F.array_join("columns", ","))


@query(f"""{ctes("columns_plain")} SELECT connector_id, schema_name, table_name, column_name,
  ordinal_position FROM (SELECT *, row_number() OVER (PARTITION BY {parts.T}
    ORDER BY ordinal_position, column_name) AS rn FROM columns_plain) WHERE rn <= 2""")
def capped_columns(spark, sf_dir):
    columns = load(spark, sf_dir, "columns_plain").select(*COLUMN_KEY, "ordinal_position")
    return cap_per_group(columns, TABLE_KEY, ["ordinal_position", "column_name"], 2)


# A cap too large for Catalyst to trim before the shuffle, over groups that exceed it.
@query(f"""{ctes("raw_tables")} SELECT {parts.T} FROM (SELECT *, row_number() OVER (
  PARTITION BY connector_id ORDER BY schema_name, table_name) AS rn FROM raw_tables) WHERE rn <= 1500""")
def capped_tables(spark, sf_dir):
    tables = load(spark, sf_dir, "raw_tables").select(*TABLE_KEY)
    return cap_per_group(tables, ["connector_id"], ["schema_name", "table_name"], 1500)


_USING = " AND ".join(f"t.{c} = {{0}}.{c}" for c in TABLE_KEY)


@query(f"""WITH {parts.primary_keys("all")}, {parts.foreign_keys("all")}, {parts.indexes("all")},
t AS ({sql("catalog_tables_all")}), c AS (SELECT {parts.T}, count(*) AS n,
  string_agg(column_name, ',' ORDER BY ordinal_position) AS names
  FROM ({sql("catalog_columns_all")}) GROUP BY {parts.T}),
f AS (SELECT {parts.T}, count(*) AS n FROM fk GROUP BY {parts.T}),
i AS (SELECT {parts.T}, count(*) AS n FROM ix GROUP BY {parts.T})
SELECT t.connector_id, t.schema_name, t.table_name, t.table_type, coalesce(c.n, 0) AS n_columns,
  coalesce(c.names, '') AS column_names, pk.constraint_name AS primary_key,
  coalesce(f.n, 0) AS n_foreign_keys, coalesce(i.n, 0) AS n_indexes
FROM t LEFT JOIN c ON {_USING.format("c")} LEFT JOIN pk ON {_USING.format("pk")}
  LEFT JOIN f ON {_USING.format("f")} LEFT JOIN i ON {_USING.format("i")}""")
def nested_tables(spark, sf_dir):
    nested = discovery.nest_tables(workload_catalog(spark, sf_dir))
    size = lambda c: F.size(c).cast("bigint")
    return nested.select(
        *TABLE_KEY, "table_type", size("columns").alias("n_columns"),
        F.array_join("columns.column_name", ",").alias("column_names"),
        F.col("primary_key.constraint_name").alias("primary_key"),
        size("foreign_keys").alias("n_foreign_keys"), size("indexes").alias("n_indexes"))


@query(f"""WITH t AS ({sql("catalog_tables_all")}), c AS ({sql("catalog_columns_all")})
SELECT t.connector_id, t.schema_name, t.table_name, t.table_type, c.column_name, c.ordinal_position,
  c.full_data_type FROM t JOIN c ON {_USING.format("c")}""")
def flattened_columns(spark, sf_dir):
    nested = discovery.nest_tables(workload_catalog(spark, sf_dir))
    return discovery.flatten_columns(nested).select(
        *TABLE_KEY, "table_type", "column_name", "ordinal_position", "full_data_type")


def _counted(source: str, column: str, condition: str = "TRUE") -> str:
    names = ["schemas_found", "tables_found", "views_found", "columns_found", "foreign_keys_found",
             "indexes_found"]
    cells = ", ".join(f"{f'count(*) FILTER ({condition})' if n == column else '0'} AS {n}" for n in names)
    return f"SELECT connector_id, {cells} FROM {source} GROUP BY connector_id"


@query(f"""WITH {parts.foreign_keys("all")}, {parts.indexes("all")}, t AS ({sql("catalog_tables_all")}),
s AS (SELECT DISTINCT connector_id, schema_name FROM t), c AS ({sql("catalog_columns_all")}),
u AS ({_counted("s", "schemas_found")} UNION ALL {_counted("t", "tables_found", "table_type = 'TABLE'")}
  UNION ALL {_counted("t", "views_found", "table_type = 'VIEW'")}
  UNION ALL {_counted("c", "columns_found")} UNION ALL {_counted("fk", "foreign_keys_found")}
  UNION ALL {_counted("ix", "indexes_found")})
SELECT connector_id, CAST(sum(schemas_found) AS BIGINT) AS schemas_found,
  CAST(sum(tables_found) AS BIGINT) AS tables_found, CAST(sum(views_found) AS BIGINT) AS views_found,
  CAST(sum(columns_found) AS BIGINT) AS columns_found,
  CAST(sum(foreign_keys_found) AS BIGINT) AS foreign_keys_found,
  CAST(sum(indexes_found) AS BIGINT) AS indexes_found, CAST(0 AS BIGINT) AS duration_ms
FROM u GROUP BY connector_id""")
def discovery_summary(spark, sf_dir):
    return discovery.discovery_summary(workload_catalog(spark, sf_dir))


_STAR_KEYS = [
    keys.PrimaryKey("region", "region_pk", ["r_regionkey"]),
    keys.PrimaryKey("nation", "nation_pk", ["n_nationkey"]),
    keys.PrimaryKey("customer", "customer_pk", ["c_custkey"]),
    keys.PrimaryKey("supplier", "supplier_pk", ["s_suppkey"]),
    keys.PrimaryKey("part", "part_pk", ["p_partkey"]),
    keys.PrimaryKey("orders", "orders_pk", ["o_orderkey"]),
    keys.PrimaryKey("lineitem", "lineitem_pk", ["l_orderkey", "l_linenumber"]),
    keys.PrimaryKey("events", "events_user", ["user_id"]),
]
_STAR_REFERENCES = [
    keys.ForeignKey("nation", "nation_region", ["n_regionkey"], "region", ["r_regionkey"]),
    keys.ForeignKey("customer", "customer_nation", ["c_nationkey"], "nation", ["n_nationkey"]),
    keys.ForeignKey("orders", "orders_customer", ["o_custkey"], "customer", ["c_custkey"]),
    keys.ForeignKey("lineitem", "lineitem_orders", ["l_orderkey"], "orders", ["o_orderkey"]),
    keys.ForeignKey("lineitem", "lineitem_part", ["l_partkey"], "part", ["p_partkey"]),
    keys.ForeignKey("lineitem", "lineitem_supplier", ["l_suppkey"], "supplier", ["s_suppkey"]),
    keys.ForeignKey("events", "events_supplier", ["user_id"], "supplier", ["s_suppkey"]),
    keys.ForeignKey("labels", "labels_documents", ["doc_id"], "documents", ["doc_id"]),
]


def _pk_check(key: keys.PrimaryKey) -> str:
    cols = ", ".join(key.columns)
    null = " OR ".join(f"{c} IS NULL" for c in key.columns)
    return f"""SELECT '{key.table}' AS table_name, '{key.name}' AS constraint_name,
  count(*) FILTER (NOT bad AND n > 1) AS duplicate_keys,
  CAST(coalesce(sum(n - 1) FILTER (NOT bad AND n > 1), 0) AS BIGINT) AS duplicate_rows,
  CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS null_rows
  FROM (SELECT {null} AS bad, count(*) AS n FROM {key.table} GROUP BY {cols})"""


def _fk_check(key: keys.ForeignKey) -> str:
    on = " AND ".join(f"p.{p} = c.{c}" for c, p in zip(key.columns, key.referenced_columns))
    return f"""SELECT '{key.table}' AS table_name, '{key.name}' AS constraint_name,
  count(DISTINCT {key.columns[0]}) AS orphan_keys, count(*) AS orphan_rows FROM {key.table} c
  WHERE {key.columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {key.referenced_table} p WHERE {on})"""


@query(" UNION ALL ".join(_pk_check(k) for k in _STAR_KEYS))
def pk_violations(spark, sf_dir):
    tables = {k.table: table(spark, sf_dir, k.table) for k in _STAR_KEYS}
    return keys.check_primary_keys(tables, _STAR_KEYS)


@query(" UNION ALL ".join(_fk_check(k) for k in _STAR_REFERENCES))
def fk_orphans(spark, sf_dir):
    names = {k.table for k in _STAR_REFERENCES} | {k.referenced_table for k in _STAR_REFERENCES}
    return keys.check_foreign_keys({n: table(spark, sf_dir, n) for n in names}, _STAR_REFERENCES)
