"""Snapshot diffs: catalogs level by level, and any keyed table field by field.

Sides meet in full outer joins on complete keys, which are unique per side, so no join key repeats
and no task holds more than its hash share. Roll-ups to table and schema are partial aggregates.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemeta.functions import fixed_values as fx
from lakemeta.model import COLUMN_KEY, SCHEMA_KEY, TABLE_KEY, Catalog
from lakemeta.operators.catalog import latest_per_key
from lakemeta.session import materialize

ADDED, DROPPED, MODIFIED, UNCHANGED = "added", "dropped", "modified", "unchanged"
COUNTERS = ["tables_added", "tables_dropped", "tables_modified", "columns_added",
            "columns_dropped", "columns_modified", "pk_changes", "fk_changes", "index_changes"]


# --- pairing two sides -----------------------------------------------------------------------

def _pair(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
          order: str | None = None) -> DataFrame:
    """Full outer join with ``old_*`` / ``new_*`` fields and a presence flag per side."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        if order is not None:
            df = latest_per_key(df.select(*dict.fromkeys([*keys, *fields, order])), keys, order)
        return df.select(*keys, *[F.col(f).alias(f"{prefix}_{f}") for f in fields],
                         F.lit(True).alias(f"_in_{prefix}"))
    return side(old, "old").join(side(new, "new"), keys, "full_outer")


def _differs(pairs: DataFrame, field: str) -> Column:
    """Field inequality where null, missing and the empty string are the same value."""
    old, new = F.col(f"old_{field}"), F.col(f"new_{field}")
    types = {pairs.schema[f"old_{field}"].dataType, pairs.schema[f"new_{field}"].dataType}
    if len(types) == 1 and not isinstance(next(iter(types)), T.StringType):
        return ~old.eqNullSafe(new)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return text(old) != text(new)


def _status(changed: Column) -> Column:
    return (F.when(F.col("_in_old").isNull(), F.lit(ADDED))
             .when(F.col("_in_new").isNull(), F.lit(DROPPED))
             .when(changed, F.lit(MODIFIED))
             .otherwise(F.lit(UNCHANGED)))


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


# --- any keyed table -------------------------------------------------------------------------

def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
                  order: str | None = None) -> DataFrame:
    """Per key: ``status`` and the ``changes`` between two snapshots.

    ``changes`` is an array of (field, old_value, new_value), filled for modified rows only. Keys
    are unique per side, or ``order`` tells which of a key's rows is last and wins.
    """
    pairs = _pair(old, new, keys, fields, order)
    both = F.col("_in_old") & F.col("_in_new")
    text = lambda c: F.col(c).cast("string")
    changes = [F.when(both & _differs(pairs, f), F.struct(
        F.lit(f).alias("field"), text(f"old_{f}").alias("old_value"),
        text(f"new_{f}").alias("new_value"))) for f in fields]
    changed = _any([_differs(pairs, f) for f in fields])
    status = _status(changed)
    return pairs.select(
        *keys, status.alias("status"),
        F.when(status == MODIFIED, F.array_compact(F.array(*changes))).alias("changes"))


def diff_status(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
                order: str | None = None) -> DataFrame:
    """The row statuses of ``snapshot_diff`` without building the change lists."""
    pairs = _pair(old, new, keys, fields, order)
    return pairs.select(*keys, _status(_any([_differs(pairs, f) for f in fields])).alias("status"))


def _digests(side: DataFrame, keys: list[str], fields: list[str], width: int) -> DataFrame:
    """Per hash bucket of the keys: rows, and the XOR of two digests of each row, whose fields count as ``_differs``
    compares them."""
    def cell(field: str) -> Column:
        if isinstance(side.schema[field].dataType, T.StringType):
            return F.nullif(F.col(field), F.lit(""))
        return F.col(field)
    cells = [F.coalesce(F.xxhash64(F.lit(i), cell(c)), F.lit(0)) for i, c in enumerate(fields)]
    missing = [cell(c).isNull() for c in fields]
    row = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *keys, *cells, *missing))
    return side.groupBy(_bucket(keys, width)).agg(
        F.count("*").alias("rows"), row(1).alias("first"), row(2).alias("second"))


def _bucket(keys: list[str], width: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(width)).alias("bucket")


def _in_buckets(side: DataFrame, keys: list[str], changed: DataFrame, width: int, how: str) -> DataFrame:
    """The rows of a side inside or outside buckets, at most ``width`` numbers."""
    return side.withColumn("_bucket", _bucket(keys, width)).join(
        F.broadcast(changed.select(F.col("bucket").alias("_bucket"))), "_bucket", how).drop("_bucket")


def changed_buckets(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
                    levels: tuple[int, ...] = (1024, 64)) -> DataFrame:
    """(bucket) of the last level whose rows differ between two sides.

    A tree of digests: both sides are reduced to one row per bucket, map-side; buckets that differ are divided by the
    next level's number and only their rows are digested again. Key and field types are those of ``new``.
    """
    width, changed = 1, None
    old = old.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in (*keys, *fields)])
    new = new.select(*keys, *fields)
    for parts in levels:
        if changed is not None:
            old, new = (_in_buckets(side, keys, changed, width, "left_semi") for side in (old, new))
        width *= parts
        a, b = (_digests(side, keys, fields, width) for side in (old, new))
        values = [F.struct(f"{side}.rows", f"{side}.first", f"{side}.second") for side in ("a", "b")]
        pairs = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer")
        differing = pairs.filter(~values[0].eqNullSafe(values[1]))
        changed = materialize(differing.select(F.coalesce("a.bucket", "b.bucket").alias("bucket")), "changed-buckets")
    return changed


def digest_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], unchanged: bool = True,
                levels: tuple[int, ...] = (1024, 64)) -> DataFrame:
    """``snapshot_diff`` of unique keys for sides that are mostly equal: only buckets whose digests differ are shuffled
    and joined, all other rows of ``new`` pass by as unchanged, or are left out if ``unchanged`` is false.

    Two equal 64-bit digests and equal counts make buckets equal. Types that differ are compared as those of ``new``.
    """
    width = reduce(lambda a, b: a * b, levels)
    changed = changed_buckets(old, new, keys, fields, levels)
    old = old.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in (*keys, *fields)])
    inside = [_in_buckets(side, keys, changed, width, "left_semi") for side in (old, new)]
    found = snapshot_diff(*inside, keys, fields)
    if not unchanged:
        return found.filter(F.col("status") != UNCHANGED)
    rest = _in_buckets(new.select(*keys), keys, changed, width, "left_anti")
    kind = found.schema["changes"].dataType
    return found.unionByName(rest.withColumn("status", F.lit(UNCHANGED)).withColumn("changes", F.lit(None).cast(kind)))


def field_changes(diff: DataFrame) -> DataFrame:
    """One row per changed field of a modified row."""
    keys = [c for c in diff.columns if c not in ("status", "changes")]
    return diff.filter(F.col("status") == MODIFIED).select(*keys, F.inline("changes"))


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s)
                      for s in (ADDED, DROPPED, MODIFIED, UNCHANGED)])


# --- catalogs --------------------------------------------------------------------------------

def diff_columns(old: DataFrame, new: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Column statuses with field changes, matched by name within the table; of a repeated name the row of
    the highest ordinal counts."""
    fields = fields or fx.COMPARED_COLUMN_FIELDS
    ordered = all("ordinal_position" in side.columns for side in (old, new))
    return snapshot_diff(old, new, COLUMN_KEY, fields, "ordinal_position" if ordered else None)


def _changed_columns(old: Catalog, new: Catalog, fields: list[str] | None, changes: bool = True) -> DataFrame:
    """The changed rows of ``diff_columns``, written; without ``changes`` their tables and statuses only."""
    changed = diff_columns(old.columns, new.columns, fields).filter(F.col("status") != UNCHANGED)
    return materialize(changed if changes else changed.select(*TABLE_KEY, "status"), "column-diff", stay=True)


def _sorted_list(name: str) -> Column:
    return F.array_join(F.array_sort(F.col(name)), ",")


def diff_constraints(old: Catalog, new: Catalog) -> DataFrame:
    """Added, dropped and modified keys and indexes (``kind`` PK, FK or INDEX).

    Column order never counts, nor does a primary key's name or a re-pairing of FK columns. Of a repeated
    name the largest definition counts.

    Each kind is written on its own, its changed rows only, so that disk holds the shuffles of one at a time.
    """
    def compare(kind: str, old_df: DataFrame, new_df: DataFrame, name: str | None,
                fields: dict[str, Column]) -> DataFrame:
        keys = [*TABLE_KEY, *([name] if name else [])]
        shape = lambda df: df.select(*keys, *[c.alias(f) for f, c in fields.items()]).withColumn(
            "_order", F.struct(*fields))
        statuses = diff_status(shape(old_df), shape(new_df), keys, list(fields), "_order")
        changed = statuses.filter(F.col("status") != UNCHANGED).select(
            *TABLE_KEY, F.lit(kind).alias("kind"),
            (F.col(name) if name else F.lit(None).cast("string")).alias("name"),
            F.col("status").alias("change_type"))
        return materialize(changed, f"{kind.lower()}-diff", stay=True)

    columns = {"member_columns": _sorted_list("columns")}
    return (compare("PK", old.primary_keys, new.primary_keys, None, columns)
            .unionByName(compare("FK", old.foreign_keys, new.foreign_keys, "constraint_name", {
                **columns, "table_ref": F.col("referenced_table"),
                "schema_ref": F.col("referenced_schema"),
                "column_refs": _sorted_list("referenced_columns")}))
            .unionByName(compare("INDEX", old.indexes, new.indexes, "index_name", {
                **columns, "unique_flag": F.col("is_unique")})))


def diff_tables(old: Catalog, new: Catalog, columns: DataFrame | None = None,
                constraints: DataFrame | None = None) -> DataFrame:
    """Table statuses; ``column_changes`` tells whether any column differs.

    A table is modified by its columns, key, foreign keys or indexes — not by its type, comment,
    row count or size. Tables and views of a schema share one namespace. The statuses are written, and
    so are those of columns and constraints that are not given, each before the next begins.
    """
    columns = _changed_columns(old, new, None, changes=False) if columns is None else columns
    constraints = diff_constraints(old, new) if constraints is None else constraints
    touched = (columns.filter(F.col("status") != UNCHANGED)
               .select(*TABLE_KEY, F.lit(1).alias("_column"))
               .unionByName(constraints.select(*TABLE_KEY, F.lit(0).alias("_column")))
               .groupBy(*TABLE_KEY).agg(F.max("_column").alias("_column")))
    pairs = _pair(old.tables, new.tables, TABLE_KEY, ["table_type"]).join(touched, TABLE_KEY, "left")
    statuses = pairs.select(
        *TABLE_KEY, F.coalesce("new_table_type", "old_table_type").alias("table_type"),
        _status(F.col("_column").isNotNull()).alias("status"),
        F.coalesce(F.col("_column") == 1, F.lit(False)).alias("column_changes"))
    return materialize(statuses, "table-diff", stay=True)


def diff_schemas(old: Catalog, new: Catalog, tables: DataFrame | None = None) -> DataFrame:
    tables = diff_tables(old, new) if tables is None else tables
    touched = (tables.filter(F.col("status") != UNCHANGED).select(*SCHEMA_KEY).distinct()
               .withColumn("_touched", F.lit(True)))
    pairs = _pair(old.schemas, new.schemas, SCHEMA_KEY, []).join(touched, SCHEMA_KEY, "left")
    return pairs.select(*SCHEMA_KEY, _status(F.col("_touched").isNotNull()).alias("status"))


def diff_summary(tables: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per connector: nine counters and whether anything changed at all.

    Three per-connector partial aggregates are padded to one shape, unioned and summed; nothing is
    joined.
    """
    def counted(df: DataFrame, column: str, counters: dict[str, str]) -> DataFrame:
        return df.groupBy("connector_id").agg(*[
            (F.count_if(F.col(column) == counters[c]) if c in counters else F.lit(0).cast("bigint"))
            .alias(c) for c in COUNTERS])

    levels = lambda level: {f"{level}_{s}": s for s in (ADDED, DROPPED, MODIFIED)}
    parts = (counted(tables, "status", levels("tables"))
             .unionByName(counted(columns, "status", levels("columns")))
             .unionByName(counted(constraints, "kind", {
                 "pk_changes": "PK", "fk_changes": "FK", "index_changes": "INDEX"})))
    summary = parts.groupBy("connector_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return summary.withColumn("has_changes", reduce(lambda a, b: a + b, map(F.col, COUNTERS)) > 0)


class CatalogDiff(NamedTuple):
    """Every level of a diff. ``columns`` and ``constraints`` hold changed rows only."""

    schemas: DataFrame
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    summary: DataFrame


def catalog_diff(old: Catalog, new: Catalog, fields: list[str] | None = None) -> CatalogDiff:
    """All levels at once; ``fields`` replaces the list of compared column attributes.

    Every level above needs the changed columns and constraints, so those — and only the changed
    rows, a sliver of the catalogs — are written once and shared; so are the table statuses, which
    schemas, summary, report and delta all read, and those of schemas. Where the catalogs' rows are dealt by table, columns
    and constraints are compared where they lie.
    """
    columns = _changed_columns(old, new, fields)
    constraints = diff_constraints(old, new)
    tables = diff_tables(old, new, columns, constraints)
    schemas = materialize(diff_schemas(old, new, tables), "schema-diff")
    return CatalogDiff(schemas, tables, columns, constraints,
                       diff_summary(tables, columns, constraints))


def empty_like(catalog: Catalog) -> Catalog:
    """The catalog before a first run: same tables, no rows."""
    return Catalog(*[df.limit(0) for df in catalog])


def all_added(new: Catalog) -> CatalogDiff:
    """First run: everything is added; the same joins against nothing."""
    return catalog_diff(empty_like(new), new)


def change_report(diff: CatalogDiff) -> DataFrame:
    """Changed schemas and tables, and the changed columns of modified tables, one line each."""
    mark = F.when(F.col("status") == ADDED, F.lit("+")).when(
        F.col("status") == DROPPED, F.lit("-")).otherwise(F.lit("~"))
    none = F.lit(None).cast("string")
    changed = lambda df: df.filter(F.col("status") != UNCHANGED)

    schemas = changed(diff.schemas).select(
        *SCHEMA_KEY, none.alias("table_name"), none.alias("column_name"),
        F.concat_ws(" ", mark, F.lit("SCHEMA"), "schema_name").alias("line"))
    tables = changed(diff.tables).select(
        *TABLE_KEY, none.alias("column_name"),
        F.concat_ws(" ", mark, F.lit("TABLE"), "table_name").alias("line"))
    shown = lambda c: F.coalesce(c, F.lit("undefined"))
    details = F.transform("changes", lambda c: F.concat(
        F.lit("("), c["field"], F.lit(": "), shown(c["old_value"]), F.lit(" → "),
        shown(c["new_value"]), F.lit(")")))
    modified = diff.tables.filter(F.col("status") == MODIFIED).select(*TABLE_KEY)
    columns = changed(diff.columns).join(modified, TABLE_KEY, "left_semi").select(
        *COLUMN_KEY, F.concat_ws(" ", mark, F.col("column_name"), details).alias("line"))
    return schemas.unionByName(tables).unionByName(columns)
