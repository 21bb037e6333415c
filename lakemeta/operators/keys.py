"""Declared keys checked against the data itself.

Each table is scanned once, whatever number of keys it holds or is referenced by: a row becomes one
(key, value) row per key, these are counted map-side, and all tables meet in one shuffle by key and value.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PrimaryKey(NamedTuple):
    table: str
    name: str
    columns: list[str]


class ForeignKey(NamedTuple):
    table: str
    name: str
    columns: list[str]
    referenced_table: str
    referenced_columns: list[str]


_KINDS = {"number": "bigint", "texts": "array<string>"}


class _Use(NamedTuple):
    """A key's columns in one table, the types in which they are compared, and whether values are referenced here."""

    key: int
    columns: list[str]
    types: list[T.DataType]
    referenced: bool = False


def _cell(column: str, kind: T.DataType) -> Column:
    """A text that equal values of a type share and different ones don't."""
    value = F.col(column).cast(kind)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        value = value + F.lit(0.0)  # -0.0 equals 0.0
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(F.struct(value))
    return value.cast("string")


def _whole(use: _Use) -> bool:
    return len(use.columns) == 1 and isinstance(use.types[0], T.IntegralType)


def _unpivoted(df: DataFrame, uses: list[_Use], values: list[str]) -> DataFrame:
    """(key, referenced, values), one row per row and use. A single whole number stays one, other keys are lists of
    texts; with a null in it a key has no value."""
    def item(use: _Use) -> Column:
        if _whole(use):
            value = {"number": F.col(use.columns[0])}
        else:
            complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in use.columns])
            value = {"texts": F.when(complete, F.array(*map(_cell, use.columns, use.types)))}
        return F.struct(F.lit(use.key).alias("key"), F.lit(use.referenced).alias("referenced"),
                        *[value.get(v, F.lit(None)).cast(_KINDS[v]).alias(v) for v in values])
    if len(uses) == 1:
        return df.select(item(uses[0]).alias("use")).select("use.*")
    return df.select(F.inline(F.array(*map(item, uses))))


def _counted(tables: dict[str, DataFrame], uses: dict[str, list[_Use]]) -> DataFrame:
    """Per key and value: rows that hold it and whether it is referenced; all rows with a null are one value."""
    values = sorted({"number" if _whole(use) else "texts" for of in uses.values() for use in of})
    rows = reduce(DataFrame.unionByName, [_unpivoted(tables[name], of, values) for name, of in uses.items()])
    found = rows.groupBy("key", *values).agg(
        F.count_if(~F.col("referenced")).alias("rows"), F.max("referenced").alias("referenced"))
    return found.withColumn("has_null", reduce(lambda a, b: a & b, [F.col(v).isNull() for v in values]))


def _totals(found: DataFrame, keys: list[PrimaryKey] | list[ForeignKey], totals: dict[str, Column]) -> DataFrame:
    """Sums per declared key, zero where no row counts."""
    declared = found.sparkSession.range(len(keys)).select(
        F.col("id").cast("int").alias("key"), *[F.lit(0).cast("bigint").alias(c) for c in totals])
    summed = (found.select("key", *[c.cast("bigint").alias(n) for n, c in totals.items()]).unionByName(declared)
              .groupBy("key").agg(*[F.sum(c).alias(c) for c in totals]))
    named = lambda texts: F.get(F.array(*map(F.lit, texts)), F.col("key"))
    return summed.select(named([k.table for k in keys]).alias("table_name"),
                         named([k.name for k in keys]).alias("constraint_name"), *totals)


def check_primary_keys(tables: dict[str, DataFrame], keys: list[PrimaryKey]) -> DataFrame:
    """Per declared key: distinct values that repeat, rows beyond the first, rows with a null."""
    uses: dict[str, list[_Use]] = {}
    for number, key in enumerate(keys):
        kinds = [tables[key.table].schema[c].dataType for c in key.columns]
        uses.setdefault(key.table, []).append(_Use(number, key.columns, kinds))
    repeats = ~F.col("has_null") & (F.col("rows") > 1)
    return _totals(_counted(tables, uses), keys, {
        "duplicate_keys": F.when(repeats, 1).otherwise(0),
        "duplicate_rows": F.when(repeats, F.col("rows") - 1).otherwise(0),
        "null_rows": F.when(F.col("has_null"), F.col("rows")).otherwise(0)})


def check_foreign_keys(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """Per declared foreign key: distinct values without a parent, and the rows that hold them.

    Values and parents are compared in the type that a union of both columns has. A value on a third of all
    rows is one row per task of the shuffle.
    """
    uses: dict[str, list[_Use]] = {}
    for number, key in enumerate(keys):
        child = tables[key.table].select(*key.columns)
        parent = tables[key.referenced_table].select(*key.referenced_columns)
        kinds = [field.dataType for field in child.union(parent).schema]
        uses.setdefault(key.table, []).append(_Use(number, key.columns, kinds))
        uses.setdefault(key.referenced_table, []).append(_Use(number, key.referenced_columns, kinds, True))
    orphan = ~F.col("has_null") & ~F.col("referenced")
    return _totals(_counted(tables, uses), keys, {
        "orphan_keys": F.when(orphan, 1).otherwise(0), "orphan_rows": F.when(orphan, F.col("rows")).otherwise(0)})
