"""Discovery of a lake folder: names and types from the files, the rest measured."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemeta.session import materialize
from lakemeta.sources.files import file_path, list_files


_NAME = "__table_name"
_COLUMNS = ("ARRAY<STRUCT<column_name: STRING, ordinal_position: INT, data_type: STRING, full_data_type: STRING, "
            "null_count: BIGINT, character_max_length: INT>>")


def _entry(position: int, field: T.StructField, nulls: Column, length: Column) -> Column:
    kind = field.dataType
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(position).alias("ordinal_position"),
        F.lit(kind.simpleString() if isinstance(kind, T.IntegralType) else kind.typeName()).alias("data_type"),
        F.lit(kind.simpleString()).alias("full_data_type"),
        nulls.cast("bigint").alias("null_count"),
        length.cast("int").alias("character_max_length"))


def profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Per value of ``by``: the row count and an entry for every other column, measured in a single scan."""
    def measured(position: int, field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        length = F.max(F.length(column)) if isinstance(field.dataType, T.StringType) else F.max(F.lit(None).cast("int"))
        return _entry(position, field, F.count("*") - F.count(column), length)

    fields = [f for f in df.schema.fields if f.name not in by]
    return df.groupBy(*by).agg(
        F.count("*").alias("estimated_row_count"),
        F.array(*[measured(i, f) for i, f in enumerate(fields, start=1)]).alias("columns"))


def list_tables(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """(table_name): what lies in the folder as ``<table><suffix>``, one file or a folder of files."""
    first = F.col("inside")[0]
    return (list_files(spark, folder, f"*{suffix}").filter(F.endswith(first, F.lit(suffix)))
            .select(F.substring(first, F.lit(1), F.length(first) - len(suffix)).alias("table_name")).distinct())


def profile_lake(spark: SparkSession, folder: str, tables: list[str] | None = None, fmt: str = "parquet",
                 suffix: str = ".parquet") -> DataFrame:
    """(table_name, estimated_row_count, columns) of all tables, by default those that lie in the folder.

    Tables with the same columns are one scan, told apart by the files their rows come from, so there are as many
    plans as there are schemas. Schemas come from the files' footers, a few tables at a time.
    """
    if tables is None:
        tables = sorted(r.table_name for r in list_tables(spark, folder, suffix).toLocalIterator())
    path = lambda table: f"{folder}/{table}{suffix}"
    with ThreadPool(8) as pool:
        schemas = pool.map(lambda t: spark.read.format(fmt).load(path(t)).schema, tables)
    groups: dict[str, list[int]] = {}
    for i, schema in enumerate(schemas):
        groups.setdefault(schema.json(), []).append(i)
    quoted = "\\Q" + folder.rstrip("/").removeprefix("file:") + "\\E"
    inside = F.split(F.regexp_replace(file_path(), "^.*?" + quoted + "/+", ""), "/")[0]
    profiles = [spark.createDataFrame([], f"table_name STRING, estimated_row_count BIGINT, columns {_COLUMNS}")]
    for members in groups.values():
        schema = schemas[members[0]]
        rows = spark.read.format(fmt).schema(schema).load([path(tables[i]) for i in members])
        name = F.substring(inside, F.lit(1), F.length(inside) - len(suffix))
        measured = profile(rows.select("*", name.alias(_NAME)), [_NAME])
        listed = spark.createDataFrame([(tables[i],) for i in members], "table_name STRING")
        # Tables without rows have columns all the same.
        profiles.append(listed.join(measured, listed["table_name"] == measured[_NAME], "left").select(
            "table_name", F.coalesce("estimated_row_count", F.lit(0)).alias("estimated_row_count"),
            F.coalesce("columns", F.array(*[_entry(i, f, F.lit(0), F.lit(None)) for i, f in enumerate(schema.fields, start=1)])).alias("columns")))
    return reduce(DataFrame.unionByName, profiles)


def lake_tables(profiles: DataFrame) -> DataFrame:
    return profiles.select("table_name", F.lit("TABLE").alias("table_type"), "estimated_row_count",
                           F.size("columns").alias("column_count"))


def lake_columns(profiles: DataFrame) -> DataFrame:
    return profiles.select("table_name", F.inline("columns")).withColumn(
        "has_nulls", F.col("null_count") > 0)


def discover_lake(spark: SparkSession, folder: str, tables: list[str] | None = None, fmt: str = "parquet",
                  suffix: str = ".parquet") -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of a lake folder. The profile, one row per table, is written once so that
    both listings come from the same scans."""
    profiles = materialize(profile_lake(spark, folder, tables, fmt, suffix), "lake-profile")
    return lake_tables(profiles), lake_columns(profiles)
