"""SQL fragments several oracles share: assembled keys and the fields of two catalog sides."""

from __future__ import annotations

from lakemeta.plans.workloads import sql

T = "connector_id, schema_name, table_name"


def primary_keys(side: str, name: str = "pk") -> str:
    return f"""{name} AS (SELECT {T}, coalesce(max(pk_name), 'PK_' || table_name) AS constraint_name,
  string_agg(column_name, ',' ORDER BY key_seq) AS cols, list(column_name) AS members
  FROM (SELECT *, row_number() OVER (PARTITION BY {T}, key_seq ORDER BY seq DESC) AS rn
        FROM ({sql(f"raw_primary_keys_{side}")})) WHERE rn = 1 GROUP BY {T})"""


def foreign_keys(side: str, name: str = "fk") -> str:
    return f"""{name} AS (SELECT {T}, cname AS constraint_name,
  string_agg(fkcolumn_name, ',' ORDER BY seq) AS cols, list(fkcolumn_name) AS members,
  string_agg(pkcolumn_name, ',' ORDER BY seq) AS ref_cols, list(pkcolumn_name) AS ref_members,
  first(rs ORDER BY seq) AS referenced_schema, first(pktable_name ORDER BY seq) AS referenced_table
  FROM (SELECT *, coalesce(fk_name, 'FK_' || table_name || '_' || pktable_name) AS cname,
    coalesce(nullif(pktable_schem, ''), nullif(pktable_cat, ''), schema_name) AS rs
    FROM ({sql(f"raw_imported_keys_{side}")})) GROUP BY {T}, cname)"""


def indexes(side: str, name: str = "ix") -> str:
    return f"""{name} AS (SELECT {T}, index_name,
  coalesce(string_agg(column_name, ',' ORDER BY seq), '') AS cols,
  list(column_name) FILTER (column_name IS NOT NULL) AS members,
  NOT first(non_unique ORDER BY seq) AS is_unique
  FROM ({sql(f"raw_index_info_{side}")}) WHERE index_name IS NOT NULL AND type <> 0
  GROUP BY {T}, index_name)"""
