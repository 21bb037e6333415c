"""Raw driver metadata to the canonical catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemeta.functions import datatypes
from lakemeta.functions import fixed_values as fx
from lakemeta.model import COLUMN_KEY, SCHEMA_KEY, TABLE_KEY, Catalog, RawMetadata
from lakemeta.operators.limits import cap_per_group


# --- schemas ---------------------------------------------------------------------------------

def is_system_schema(database_type: Column | str, name: Column | str) -> Column:
    """Whether a schema belongs to the database itself; a few constant hash-set lookups per row."""
    kind = F.col(database_type) if isinstance(database_type, str) else database_type
    schema = F.col(name) if isinstance(name, str) else name
    hit = F.lit(False)
    for database, names in fx.SYSTEM_SCHEMAS.items():
        hit = hit | ((kind == database) & schema.isin(names))
    return F.coalesce(hit, F.lit(False))


def resolve_schemas(raw_schemas: DataFrame, raw_catalogs: DataFrame,
                    connectors: DataFrame) -> DataFrame:
    """Schemas to read per connector; the first non-empty source wins.

    Order: the connector's explicit list, for MySQL its database, listed schemas of that database
    that are not system schemas, catalogs that are not, the database name itself.
    """
    conn = connectors.select("connector_id", "database_type", "database_name", "schemas")
    explicit = (conn.filter(F.size("schemas") > 0)
                .select("connector_id", F.explode("schemas").alias("schema_name"),
                        F.lit(0).alias("_tier")))
    open_ended = conn.filter(F.coalesce(F.size("schemas"), F.lit(0)) <= 0)
    is_mysql = F.coalesce(F.col("database_type") == "MYSQL", F.lit(False))
    own_name = open_ended.filter(F.col("database_name").isNotNull()).select(
        "connector_id", F.col("database_name").alias("schema_name"),
        F.when(is_mysql, F.lit(1)).otherwise(F.lit(4)).alias("_tier"))
    listing = open_ended.filter(~is_mysql)
    in_database = (F.col("table_catalog").isNull()
                   | (F.coalesce(F.col("database_name"), F.lit("")) == "")
                   | (F.lower("table_catalog") == F.lower("database_name")))
    listed = (raw_schemas.join(listing, "connector_id").filter(in_database)
              .select("connector_id", "database_type", F.col("table_schem").alias("schema_name"),
                      F.lit(2).alias("_tier")))
    catalogs = (raw_catalogs.join(listing, "connector_id")
                .select("connector_id", "database_type", F.col("table_cat").alias("schema_name"),
                        F.lit(3).alias("_tier")))
    found = (listed.unionByName(catalogs)
             .filter(F.col("schema_name").isNotNull()
                     & ~is_system_schema("database_type", "schema_name"))
             .drop("database_type"))
    candidates = explicit.unionByName(own_name).unionByName(found)
    best = candidates.groupBy("connector_id").agg(F.min("_tier").alias("_tier"))
    return candidates.join(best, ["connector_id", "_tier"]).select(*SCHEMA_KEY)


# --- tables and columns ----------------------------------------------------------------------

def classify_tables(raw_tables: DataFrame) -> DataFrame:
    kept = raw_tables.filter(F.col("table_type").isin("TABLE", "VIEW"))
    return kept.select(
        *TABLE_KEY,
        F.when(F.col("table_type").contains("VIEW"), F.lit("VIEW")).otherwise(F.lit("TABLE"))
         .alias("table_type"),
        F.nullif(F.col("remarks"), F.lit("")).alias("table_comment"))


def normalize_columns(raw_columns: DataFrame) -> DataFrame:
    type_name, size = F.col("type_name"), F.col("column_size")
    string_like, numeric_like = datatypes.is_string_like(type_name), datatypes.is_numeric_like(type_name)
    return raw_columns.select(
        *COLUMN_KEY,
        "ordinal_position",
        F.coalesce(F.lower(type_name), F.lit("unknown")).alias("data_type"),
        datatypes.full_data_type(type_name, size, "decimal_digits").alias("full_data_type"),
        F.coalesce(F.col("nullable") == 1, F.lit(False)).alias("is_nullable"),
        F.col("column_def").alias("column_default"),
        F.when(string_like & (size > 0), size).alias("character_max_length"),
        F.when(numeric_like & (size > 0), size).alias("numeric_precision"),
        F.when(numeric_like, F.col("decimal_digits")).alias("numeric_scale"),
        F.nullif(F.col("remarks"), F.lit("")).alias("column_comment"),
        F.lit(False).alias("is_primary_key"),
        F.coalesce(F.upper("is_autoincrement") == "YES", F.lit(False)).alias("is_auto_increment"))


# --- keys and indexes ------------------------------------------------------------------------

def _in_order(*fields: str) -> Column:
    """The group's ``fields`` as structs, sorted by the first field."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def assemble_primary_keys(raw_keys: DataFrame) -> DataFrame:
    """One row per table. A repeated key position keeps its last row, and so does the name.

    Positions are reduced first (partially, before the shuffle), so the list collected per table
    is as long as the key, however often its rows repeat.
    """
    positions = raw_keys.groupBy(*TABLE_KEY, "key_seq").agg(
        F.max_by(F.struct("column_name", "pk_name"), "seq").alias("_last"),
        F.max("seq").alias("seq"))
    positions = positions.select(*TABLE_KEY, "key_seq", "seq", "_last.*")
    keys = positions.groupBy(*TABLE_KEY).agg(
        _in_order("key_seq", "column_name").alias("_ordered"),
        F.max_by("pk_name", "seq").alias("pk_name"))
    name = F.coalesce(F.col("pk_name"), F.concat(F.lit("PK_"), F.col("table_name")))
    return keys.select(*TABLE_KEY, name.alias("constraint_name"),
                       F.col("_ordered.column_name").alias("columns"))


def assemble_foreign_keys(raw_keys: DataFrame) -> DataFrame:
    """One row per table and constraint; the reference comes from the constraint's first row."""
    empty = F.lit("")
    name = F.coalesce(F.col("fk_name"), F.concat(
        F.lit("FK_"), F.col("table_name"), F.lit("_"), F.col("pktable_name")))
    schema = F.coalesce(F.nullif(F.col("pktable_schem"), empty),
                        F.nullif(F.col("pktable_cat"), empty), F.col("schema_name"))
    named = raw_keys.withColumn("constraint_name", name).withColumn("referenced_schema", schema)
    grouped = named.groupBy(*TABLE_KEY, "constraint_name").agg(
        _in_order("seq", "fkcolumn_name", "pkcolumn_name").alias("_pairs"),
        F.min_by(F.struct("referenced_schema", "pktable_name"), "seq").alias("_first"))
    return grouped.select(
        *TABLE_KEY, "constraint_name",
        F.col("_pairs.fkcolumn_name").alias("columns"),
        F.col("_first.referenced_schema").alias("referenced_schema"),
        F.col("_first.pktable_name").alias("referenced_table"),
        F.col("_pairs.pkcolumn_name").alias("referenced_columns"))


def assemble_indexes(raw_indexes: DataFrame) -> DataFrame:
    """One row per table and index. Expression columns are left out; the index stays."""
    statistic = 0
    rows = raw_indexes.filter(F.col("index_name").isNotNull()
                              & (F.coalesce(F.col("type"), F.lit(0)) != statistic))
    member = F.when(F.col("column_name").isNotNull(), F.struct("seq", "column_name"))
    unique = ~F.coalesce(F.col("non_unique"), F.lit(False))
    grouped = rows.groupBy(*TABLE_KEY, "index_name").agg(
        F.array_sort(F.collect_list(member)).alias("_members"),
        F.min_by(unique, "seq").alias("is_unique"))
    return grouped.select(*TABLE_KEY, "index_name",
                          F.col("_members.column_name").alias("columns"), "is_unique")


def _key_columns(keys: DataFrame, flag: str) -> DataFrame:
    """Distinct (table, column) members of PKs or FKs, flagged."""
    return (keys.select(*TABLE_KEY, F.explode("columns").alias("column_name"))
            .distinct().withColumn(flag, F.lit(True)))


def flag_columns(columns: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
    """Sets ``flag`` on columns that are members of ``keys``.

    The join is on the full column key, unique on the key side, so a table with very many columns
    spreads over all tasks.
    """
    members = _key_columns(keys, "_member")
    flagged = columns.drop(flag).join(members, COLUMN_KEY, "left")
    return flagged.withColumn(flag, F.coalesce("_member", F.lit(False))).drop("_member")


def flag_pk_columns(columns: DataFrame, primary_keys: DataFrame) -> DataFrame:
    return flag_columns(columns, primary_keys, "is_primary_key").select(*columns.columns)


# --- whole catalogs --------------------------------------------------------------------------

def build_catalog(raw: RawMetadata, schemas: DataFrame,
                  max_schemas: int | None = None, max_tables: int | None = None,
                  max_columns: int | None = None) -> Catalog:
    """Catalog of the given schemas: all of it, unless the caller asks for the first N schemas of a
    connector, tables of a schema (in name order) or columns of a table (in ordinal order)."""
    def first(df: DataFrame, keys: list[str], order: list[str], n: int | None) -> DataFrame:
        return df if n is None else cap_per_group(df, keys, order, n)

    schemas = first(schemas.select(*SCHEMA_KEY).distinct(), ["connector_id"], ["schema_name"], max_schemas)
    tables = first(classify_tables(raw.tables).join(schemas, SCHEMA_KEY, "left_semi"),
                   SCHEMA_KEY, ["table_name"], max_tables)
    within = lambda df: df.join(tables.select(*TABLE_KEY), TABLE_KEY, "left_semi")
    keys = assemble_primary_keys(within(raw.primary_keys))
    columns = first(normalize_columns(within(raw.columns)), TABLE_KEY,
                    ["ordinal_position", "column_name"], max_columns)
    return Catalog(
        schemas=schemas,
        tables=tables,
        columns=flag_pk_columns(columns, keys),
        primary_keys=keys,
        foreign_keys=assemble_foreign_keys(within(raw.imported_keys)),
        indexes=assemble_indexes(within(raw.index_info)))


def nest_tables(catalog: Catalog, columns_per_part: int = fx.MAX_COLUMNS_PER_TABLE,
                connectors: DataFrame | None = None) -> DataFrame:
    """One row per table holding its columns, key, foreign keys and indexes.

    A schema without tables has a row with no table name. So does each of ``connectors`` (connector_id) that
    has no schema, with no schema name either: that it was looked at and nothing was found.

    A table whose ordinals pass ``columns_per_part`` has further rows, numbered by ``part``, with the
    columns of those ordinals and nothing else; every column is in exactly one part. Nesting stops at
    table grain; schemas and databases stay ordinary groupings of these rows.
    """
    def members(df: DataFrame, name: str, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
        fields = [*order, *[c for c in df.columns if c not in (*TABLE_KEY, *order, *by)]]
        return df.groupBy(*TABLE_KEY, *by).agg(_in_order(*fields).alias(name))

    part = F.greatest(F.floor((F.coalesce("ordinal_position", F.lit(1)) - 1) / columns_per_part), F.lit(0)).cast("int")
    columns = members(catalog.columns.withColumn("part", part), "columns", "ordinal_position", "column_name", by=("part",))
    first = columns.filter("part = 0").drop("part")
    further = catalog.tables.join(columns.filter("part > 0"), TABLE_KEY)
    primary = catalog.primary_keys.select(
        *TABLE_KEY, F.struct("constraint_name", "columns").alias("primary_key"))
    nested = (catalog.tables
              .withColumn("part", F.lit(0))
              .join(first, TABLE_KEY, "left")
              .join(primary, TABLE_KEY, "left")
              .join(members(catalog.foreign_keys, "foreign_keys", "constraint_name"), TABLE_KEY, "left")
              .join(members(catalog.indexes, "indexes", "index_name"), TABLE_KEY, "left")
              .unionByName(further, allowMissingColumns=True))
    heads = catalog.schemas.select(*SCHEMA_KEY).join(catalog.tables.select(*SCHEMA_KEY).distinct(), SCHEMA_KEY, "left_anti")
    if connectors is not None:
        found = catalog.schemas.select("connector_id").distinct()
        heads = heads.unionByName(connectors.select("connector_id").distinct().join(found, "connector_id", "left_anti"),
                                  allowMissingColumns=True)
    nested = nested.unionByName(heads.withColumn("part", F.lit(0)), allowMissingColumns=True)
    for name in ("columns", "foreign_keys", "indexes"):
        nested = nested.withColumn(name, F.coalesce(F.col(name), F.array()))
    return nested


def flatten_columns(nested: DataFrame) -> DataFrame:
    """The flat columns of nested tables and views."""
    return nested.select(*TABLE_KEY, "table_type", F.inline("columns"))


def discovery_summary(catalog: Catalog, snapshots: DataFrame | None = None) -> DataFrame:
    """What was found, per connector. Each table is counted in one pass before anything moves."""
    counters = ["schemas_found", "tables_found", "views_found", "columns_found",
                "foreign_keys_found", "indexes_found", "duration_ms"]

    def counted(df: DataFrame, **metrics: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return df.groupBy("connector_id").agg(
            *[F.coalesce(metrics.get(c, zero), zero).cast("bigint").alias(c) for c in counters])

    is_view = F.col("table_type") == "VIEW"
    parts = [
        counted(catalog.schemas, schemas_found=F.count("*")),
        counted(catalog.tables, tables_found=F.count_if(~is_view), views_found=F.count_if(is_view)),
        counted(catalog.columns, columns_found=F.count("*")),
        counted(catalog.foreign_keys, foreign_keys_found=F.count("*")),
        counted(catalog.indexes, indexes_found=F.count("*"))]
    if snapshots is not None:
        parts.append(counted(snapshots, duration_ms=F.max("duration_ms")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("connector_id").agg(*[F.sum(c).alias(c) for c in counters])
