"""Snapshot diffs of catalogs and of keyed tables."""

from __future__ import annotations

from lakemeta.functions import fixed_values as fx
from lakemeta.model import Catalog
from lakemeta.operators import diff
from lakemeta.plans import oracle_parts as parts
from lakemeta.plans.inputs import workload_catalog
from lakemeta.plans.registry import query
from lakemeta.plans.workloads import ctes, load, sql

# --- keyed tables ----------------------------------------------------------------------------

_FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_TEXT_FIELDS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def _joined(old: str, new: str, keys: list[str], fields: list[str]) -> str:
    """Full outer join of two relations with a status column ``st`` and per-field texts."""
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    key_cells = ", ".join(f"coalesce(n.{k}, o.{k}) AS {k}" for k in keys)
    cells = ", ".join(f"CAST(o.{f} AS VARCHAR) AS o_{f}, CAST(n.{f} AS VARCHAR) AS n_{f}" for f in fields)
    differ = " OR ".join(f"coalesce(CAST(o.{f} AS VARCHAR), '') <> coalesce(CAST(n.{f} AS VARCHAR), '')"
                         for f in fields) or "FALSE"
    return f"""SELECT {key_cells}{', ' + cells if cells else ''},
  CASE WHEN o.{keys[0]} IS NULL THEN 'added' WHEN n.{keys[0]} IS NULL THEN 'dropped'
    WHEN {differ} THEN 'modified' ELSE 'unchanged' END AS st
  FROM {old} o FULL JOIN {new} n ON {on}"""


def _changes(relation: str, keys: list[str], fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {", ".join(keys)}, '{f}' AS field, o_{f} AS old_value, n_{f} AS new_value
  FROM {relation} WHERE st = 'modified' AND coalesce(o_{f}, '') <> coalesce(n_{f}, '')""" for f in fields)


_ORDERS = f"""{ctes("orders_old", "orders_new")},
j AS ({_joined("orders_old", "orders_new", ["o_orderkey"], _FIELDS)})"""


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "orders_old"), load(spark, sf_dir, "orders_new")


@query(f"{_ORDERS} SELECT o_orderkey, st AS status FROM j")
def orders_diff_status(spark, sf_dir):
    return diff.diff_status(*_orders(spark, sf_dir), ["o_orderkey"], _FIELDS)


@query(f"{_ORDERS} {_changes('j', ['o_orderkey'], _TEXT_FIELDS)}")
def orders_field_changes(spark, sf_dir):
    return diff.field_changes(diff.snapshot_diff(*_orders(spark, sf_dir), ["o_orderkey"], _FIELDS))


@query(f"""{_ORDERS} SELECT count(*) FILTER (st = 'added') AS added, count(*) FILTER (st = 'dropped') AS dropped,
  count(*) FILTER (st = 'modified') AS modified, count(*) FILTER (st = 'unchanged') AS unchanged FROM j""")
def orders_diff_summary(spark, sf_dir):
    return diff.status_counts(diff.diff_status(*_orders(spark, sf_dir), ["o_orderkey"], _FIELDS))


@query(f"{_ORDERS} SELECT o_orderkey, st AS status FROM j")
def orders_digest_status(spark, sf_dir):
    return diff.digest_diff(*_orders(spark, sf_dir), ["o_orderkey"], _FIELDS).drop("changes")


@query(f"{_ORDERS} {_changes('j', ['o_orderkey'], _TEXT_FIELDS)}")
def orders_digest_changes(spark, sf_dir):
    return diff.field_changes(diff.digest_diff(*_orders(spark, sf_dir), ["o_orderkey"], _FIELDS, unchanged=False))


# Keys that repeat: one customer key holds a third of each side; the last order wins.
_HOT = ("SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS k, o_orderkey AS pos, "
        "o_orderstatus, o_orderpriority FROM {0}")
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM {0}) WHERE rn = 1"


@query(f"""{ctes("orders_old", "orders_new")}, a AS ({_HOT.format("orders_old")}), b AS ({_HOT.format("orders_new")}),
la AS ({_LAST.format("a")}), lb AS ({_LAST.format("b")}),
j AS ({_joined("la", "lb", ["k"], ["o_orderstatus", "o_orderpriority"])}) SELECT k, st AS status FROM j""")
def repeated_key_diff(spark, sf_dir):
    old, new = (spark.sql(_HOT.format("{rows}"), rows=df) for df in _orders(spark, sf_dir))
    return diff.diff_status(old, new, ["k"], ["o_orderstatus", "o_orderpriority"], order="pos")


# --- catalogs --------------------------------------------------------------------------------

_K = ["connector_id", "schema_name", "table_name"]
_CK = [*_K, "column_name"]


def _listed(relation: str, *columns: str) -> str:
    """Comma lists of a relation re-sorted alphabetically."""
    cells = ", ".join(f"list_aggregate(list_sort({c}), 'string_agg', ',') AS {c}_sorted" for c in columns)
    return f"SELECT *, {cells} FROM {relation}"


def _sides(side: str, tag: str) -> str:
    return f"""t{tag} AS ({sql(f"catalog_tables_{side}")}),
s{tag} AS (SELECT DISTINCT connector_id, schema_name FROM t{tag}),
c{tag} AS ({sql(f"catalog_columns_{side}")}),
{parts.primary_keys(side, f"p0{tag}")}, p{tag} AS ({_listed(f"p0{tag}", "members")}),
{parts.foreign_keys(side, f"f0{tag}")}, f{tag} AS ({_listed(f"f0{tag}", "members", "ref_members")}),
{parts.indexes(side, f"i0{tag}")}, i{tag} AS ({_listed(f"i0{tag}", "members")})"""


def catalog_ctes(first_run: bool = False) -> str:
    """Both sides and every diff level: cd (columns), kd (constraints), td (tables), sd (schemas)."""
    sides = f"WITH {_sides('old', '_o0')}, {_sides('new', '_n')}"
    old = ", ".join(f"{x}_o AS (SELECT * FROM {x}_o0{' WHERE FALSE' if first_run else ''})"
                    for x in "tscpfi")
    fk_fields = ["members_sorted", "referenced_table", "referenced_schema", "ref_members_sorted"]
    constraints = " UNION ALL ".join(
        f"""SELECT {", ".join(_K)}, '{kind}' AS kind, {name or 'NULL'} AS name, st AS change_type
  FROM ({_joined(f"{x}_o", f"{x}_n", [*_K, *([name] if name else [])], fields)}) WHERE st <> 'unchanged'"""
        for kind, x, name, fields in (("PK", "p", None, ["members_sorted"]),
                                      ("FK", "f", "constraint_name", fk_fields),
                                      ("INDEX", "i", "index_name", ["members_sorted", "is_unique"])))
    using = " AND ".join(f"j.{k} = x.{k}" for k in _K)
    return f"""{sides}, {old},
cd AS ({_joined("c_o", "c_n", _CK, fx.COMPARED_COLUMN_FIELDS)}),
kd AS ({constraints}),
touched AS (SELECT {", ".join(_K)}, max(is_col) AS is_col FROM (
  SELECT {", ".join(_K)}, 1 AS is_col FROM cd WHERE st <> 'unchanged'
  UNION ALL SELECT {", ".join(_K)}, 0 FROM kd) GROUP BY ALL),
td AS (SELECT j.connector_id, j.schema_name, j.table_name, coalesce(n_table_type, o_table_type) AS table_type,
  CASE WHEN st = 'unchanged' AND is_col IS NOT NULL THEN 'modified' ELSE st END AS st,
  coalesce(is_col = 1, FALSE) AS column_changes
  FROM (SELECT * REPLACE (CASE WHEN st = 'modified' THEN 'unchanged' ELSE st END AS st)
        FROM ({_joined("t_o", "t_n", _K, ["table_type"])})) j LEFT JOIN touched x ON {using}),
sd AS (SELECT j.connector_id, j.schema_name, CASE WHEN st = 'unchanged' AND EXISTS (SELECT 1 FROM td x
    WHERE x.connector_id = j.connector_id AND x.schema_name = j.schema_name AND x.st <> 'unchanged')
    THEN 'modified' ELSE st END AS st
  FROM ({_joined("s_o", "s_n", ["connector_id", "schema_name"], [])}) j)"""


CATALOG = catalog_ctes()
FIRST_RUN = catalog_ctes(first_run=True)


def both(spark, sf_dir) -> tuple[Catalog, Catalog]:
    return workload_catalog(spark, sf_dir, "old"), workload_catalog(spark, sf_dir, "new")


@query(f"{CATALOG} SELECT connector_id, schema_name, st AS status FROM sd")
def diff_schemas(spark, sf_dir):
    return diff.diff_schemas(*both(spark, sf_dir))


@query(f"{CATALOG} SELECT {', '.join(_K)}, table_type, st AS status, column_changes FROM td")
def diff_tables(spark, sf_dir):
    return diff.diff_tables(*both(spark, sf_dir))


@query(f"{CATALOG} SELECT {', '.join(_CK)}, st AS status FROM cd")
def diff_columns(spark, sf_dir):
    old, new = (load(spark, sf_dir, f"catalog_columns_{side}") for side in ("old", "new"))
    return diff.diff_columns(old, new).drop("changes")


@query(f"{CATALOG} {_changes('cd', _CK, fx.COMPARED_COLUMN_FIELDS)}")
def field_changes(spark, sf_dir):
    old, new = (load(spark, sf_dir, f"catalog_columns_{side}") for side in ("old", "new"))
    return diff.field_changes(diff.diff_columns(old, new))


@query(f"{CATALOG} SELECT * FROM kd")
def diff_constraints(spark, sf_dir):
    return diff.diff_constraints(*both(spark, sf_dir))


def _summary_sql(prefix: str) -> str:
    count = lambda rel, col, value, name: (
        f"count(*) FILTER (rel = '{rel}' AND {col} = '{value}') AS {name}")
    cells = [count(rel, "st", s, f"{level}_{s}") for rel, level in (("t", "tables"), ("c", "columns"))
             for s in ("added", "dropped", "modified")]
    cells += [count("k", "st", kind, f"{kind.lower() if kind != 'INDEX' else 'index'}_changes")
              for kind in ("PK", "FK", "INDEX")]
    return f"""{prefix}, u AS (SELECT connector_id, 't' AS rel, st FROM td
  UNION ALL SELECT connector_id, 'c', st FROM cd UNION ALL SELECT connector_id, 'k', kind FROM kd)
SELECT connector_id, {", ".join(cells)},
  count(*) FILTER (st <> 'unchanged') > 0 AS has_changes FROM u GROUP BY connector_id"""


@query(_summary_sql(CATALOG))
def diff_summary(spark, sf_dir):
    return diff.catalog_diff(*both(spark, sf_dir)).summary


@query(_summary_sql(FIRST_RUN))
def diff_first_run(spark, sf_dir):
    return diff.all_added(workload_catalog(spark, sf_dir, "new")).summary


_MARK = "CASE st WHEN 'added' THEN '+' WHEN 'dropped' THEN '-' ELSE '~' END"
_DETAILS = " || ".join(
    f"CASE WHEN st = 'modified' AND coalesce(o_{f}, '') <> coalesce(n_{f}, '') THEN ' ({f}: ' || "
    f"coalesce(o_{f}, 'undefined') || ' → ' || coalesce(n_{f}, 'undefined') || ')' ELSE '' END"
    for f in fx.COMPARED_COLUMN_FIELDS)


@query(f"""{CATALOG}
SELECT connector_id, schema_name, NULL AS table_name, NULL AS column_name,
  {_MARK} || ' SCHEMA ' || schema_name AS line FROM sd WHERE st <> 'unchanged'
UNION ALL SELECT {", ".join(_K)}, NULL, {_MARK} || ' TABLE ' || table_name FROM td WHERE st <> 'unchanged'
UNION ALL SELECT {", ".join(_CK)}, {_MARK} || ' ' || column_name || {_DETAILS} FROM cd
  WHERE st <> 'unchanged' AND EXISTS (SELECT 1 FROM td WHERE td.st = 'modified'
    AND td.connector_id = cd.connector_id AND td.schema_name = cd.schema_name
    AND td.table_name = cd.table_name)""")
def change_report(spark, sf_dir):
    return diff.change_report(diff.catalog_diff(*both(spark, sf_dir)))
