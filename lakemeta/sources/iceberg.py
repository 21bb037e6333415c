"""Iceberg table metadata documents to catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemeta.functions.datatypes import parse_iceberg_type
from lakemeta.session import materialize
from lakemeta.sources.files import file_path, list_files

_METADATA = """`current-schema-id`: INT,
 schemas: ARRAY<STRUCT<`schema-id`: INT, fields: ARRAY<STRUCT<
   id: INT, name: STRING, required: BOOLEAN, type: STRING, doc: STRING>>>>,
 `partition-specs`: ARRAY<STRUCT<`spec-id`: INT, fields: ARRAY<STRUCT<name: STRING, transform: STRING>>>>,
 `sort-orders`: ARRAY<STRUCT<`order-id`: INT, fields: ARRAY<STRING>>>,
 properties: MAP<STRING, STRING>,
 snapshots: ARRAY<STRUCT<summary: MAP<STRING, STRING>>>"""
# Catalog responses wrap the document in "metadata"; files on storage hold it bare. One schema
# reads both. A field's type is a string or an object; as STRING the object keeps its JSON text.
_DOCUMENT = f"STRUCT<metadata: STRUCT<{_METADATA}>, {_METADATA}>"
_FIELDS = ["current-schema-id", "schemas", "partition-specs", "sort-orders", "properties", "snapshots"]


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, table_name, path): each table's metadata file of the highest version, from names alone.

    Files lie at ``<namespace parts>/<table>/metadata/<version>.metadata.json``.
    """
    inside = F.col("inside")
    name = F.try_element_at(inside, F.lit(-1))
    located = list_files(spark, path, "*.metadata.json").select(
        F.array_join(F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 3, F.lit(0))), ".").alias("namespace"),
        F.try_element_at(inside, F.lit(-3)).alias("table_name"),
        F.struct(F.regexp_extract(name, r"^v?(\d+)", 1).try_cast("bigint").alias("version"), name.alias("name")).alias("_version"),
        "path")
    return located.groupBy("namespace", "table_name").agg(F.max_by("path", "_version").alias("path"))


def read_iceberg_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, table_name, document): the current metadata document of every table under ``path``.

    In two steps: the newest version of each table is picked from the listing, then only those files are read. The
    driver, which lists the folder anyway, holds one path a table. A folder without tables gives no rows.
    """
    found = materialize(current_versions(spark, path), "iceberg-versions")
    paths = [r.path for r in found.select("path").toLocalIterator()]
    if not paths:
        return found.select("namespace", "table_name", F.col("path").alias("document")).limit(0)
    documents = spark.read.text(paths, wholetext=True).select(
        F.regexp_replace(file_path(), "^file:/+", "file:/").alias("path"), F.col("value").alias("document"))
    return (found.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(documents, "path")
            .select("namespace", "table_name", "document"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Replaces ``document`` by the parsed ``meta`` struct."""
    wrapped = F.col("_parsed.metadata").isNotNull()
    pick = lambda f: F.when(wrapped, F.col(f"_parsed.metadata.`{f}`")).otherwise(
        F.col(f"_parsed.`{f}`")).alias(f.replace("-", "_"))
    return (documents.withColumn("_parsed", F.from_json("document", _DOCUMENT))
            .withColumn("meta", F.struct(*[pick(f) for f in _FIELDS]))
            .drop("_parsed", "document"))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _current_fields(meta: str = "meta") -> Column:
    schemas = F.col(f"{meta}.schemas")
    wanted = F.coalesce(F.col(f"{meta}.current_schema_id"), F.lit(0))
    current = F.get(F.filter(schemas, lambda s: s["schema-id"] == wanted), F.lit(0))
    return F.coalesce(current, F.get(schemas, F.lit(0)))["fields"]


def iceberg_columns(parsed: DataFrame) -> DataFrame:
    """Columns of the current schema (or the first, if the current id is not listed)."""
    keys = [c for c in parsed.columns if c != "meta"]
    fields = parsed.select(*keys, F.posexplode(_current_fields()).alias("_pos", "_field"))
    kind = parse_iceberg_type(F.col("_field.type"))
    return fields.select(
        *keys, F.col("_field.name").alias("column_name"),
        (F.col("_pos") + 1).alias("ordinal_position"),
        kind["data_type"].alias("data_type"), kind["full_data_type"].alias("full_data_type"),
        (~F.coalesce(F.col("_field.required"), F.lit(False))).alias("is_nullable"),
        kind["character_max_length"].alias("character_max_length"),
        kind["numeric_precision"].alias("numeric_precision"),
        kind["numeric_scale"].alias("numeric_scale"),
        F.nullif(F.col("_field.doc"), F.lit("")).alias("column_comment"),
        F.lit(False).alias("is_primary_key"), F.lit(False).alias("is_auto_increment"))


def iceberg_comment() -> Column:
    """Partitioning of the latest spec, size of the latest sort order, number of properties."""
    spec = _last(F.col("meta.partition_specs"))["fields"]
    fields = F.array_join(F.transform(
        spec, lambda f: F.concat(f["name"], F.lit("("), f["transform"], F.lit(")"))), ", ")
    sort = F.size(_last(F.col("meta.sort_orders"))["fields"])
    props = F.size(F.map_keys("meta.properties"))
    counted = lambda label, n, unit: F.when(
        n > 0, F.concat(F.lit(f"{label}: "), n.cast("string"), F.lit(f" {unit}(s)")))
    comment = F.concat_ws(
        " | ",
        F.when(F.size(spec) > 0, F.concat(F.lit("Partitioned by: "), fields)),
        counted("Sort order", sort, "field"), counted("Properties", props, "key"))
    return F.nullif(comment, F.lit(""))


def iceberg_row_count() -> Column:
    total = _last(F.col("meta.snapshots"))["summary"]["total-records"]
    return F.regexp_extract(total, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def iceberg_tables(parsed: DataFrame, table_type: str = "TABLE") -> DataFrame:
    keys = [c for c in parsed.columns if c != "meta"]
    return parsed.select(*keys, F.lit(table_type).alias("table_type"),
                         iceberg_comment().alias("table_comment"),
                         iceberg_row_count().alias("estimated_row_count"))


def namespace_name(parts: Column | str) -> Column:
    return F.array_join(parts, ".")
