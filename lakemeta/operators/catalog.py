"""Searches, filters and freshness over catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemeta.functions.redact import mask_column
from lakemeta.model import COLUMN_KEY, TABLE_KEY, Catalog
from lakemeta.operators.discovery import flag_columns

MAX_PATTERN = 500
DEFAULT_TTL_HOURS = 24
DEFAULT_RETAINED = 100


def search_columns(columns: DataFrame, pattern: str, connector: str | None = None) -> DataFrame:
    """Columns whose name contains a match of ``pattern``, ignoring case.

    The pattern is checked before any data is read: Spark itself would only fail once tasks run.
    """
    if not 1 <= len(pattern) <= MAX_PATTERN:
        raise ValueError(f"pattern must have 1..{MAX_PATTERN} characters")
    matches = lambda c: F.coalesce(c, F.lit("")).rlike(f"(?i){pattern}")
    try:
        columns.sparkSession.range(1).select(matches(F.lit("").cast("string"))).collect()
    except Exception as error:
        raise ValueError(f"invalid pattern: {pattern}") from error
    if connector is not None:
        columns = columns.filter(F.col("connector_id") == connector)
    return columns.filter(F.col("column_name").rlike(f"(?i){pattern}")).select(
        *COLUMN_KEY, "data_type", "full_data_type")


def get_schema(df: DataFrame, schema: str | None = None, table: str | None = None) -> DataFrame:
    """Rows of one schema, or of one table in it; names compare without case.

    The table only counts when a schema is given. Works on any table with those name columns.
    """
    if schema:
        df = df.filter(F.lower("schema_name") == schema.lower())
        if table:
            df = df.filter(F.lower("table_name") == table.lower())
    return df


def column_inventory(columns: DataFrame, schema: str | None = None) -> DataFrame:
    """The flat column listing that ``sources.exports.write_inventory_csv`` writes."""
    return get_schema(columns, schema).select(
        F.col("connector_id").alias("connector"), F.col("schema_name").alias("schema"),
        F.col("table_name").alias("table"), F.col("column_name").alias("column"),
        F.col("data_type").alias("dataType"), F.col("full_data_type").alias("fullDataType"),
        F.col("is_nullable").alias("nullable"), F.col("is_primary_key").alias("isPrimaryKey"))


def column_sheet(catalog: Catalog) -> DataFrame:
    """Columns with key badges: member of the table's primary key, member of any foreign key."""
    sheet = catalog.columns.select(
        *TABLE_KEY, "ordinal_position", "column_name", "full_data_type",
        F.when(F.col("is_nullable"), F.lit("YES")).otherwise(F.lit("NO")).alias("nullable"),
        F.coalesce("column_default", F.lit("")).alias("column_default"),
        F.coalesce("column_comment", F.lit("")).alias("column_comment"))
    sheet = flag_columns(sheet, catalog.primary_keys, "pk_badge")
    return flag_columns(sheet, catalog.foreign_keys, "fk_badge")


def latest_per_key(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The row with the greatest ``order`` per key, reduced map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every connector, whatever its age."""
    return latest_per_key(snapshots, ["connector_id"], F.struct("discovered_at", "snapshot_id"))


def fresh_snapshots(snapshots: DataFrame, as_of, ttl_hours: float = DEFAULT_TTL_HOURS) -> DataFrame:
    """Each connector's newest snapshot at ``as_of``, hidden once older than the time to live."""
    as_of = F.lit(str(as_of)).cast(snapshots.schema["discovered_at"].dataType)
    oldest = as_of - F.make_dt_interval(secs=F.lit(ttl_hours * 3600.0))
    known = snapshots.filter((F.col("discovered_at") <= as_of) & (F.col("discovered_at") >= oldest))
    return latest_snapshots(known)


def retain_newest(snapshots: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest snapshots overall; the oldest are the ones to evict."""
    order = [F.col("discovered_at").desc(), F.col("snapshot_id").desc()]
    return snapshots.orderBy(*order).limit(n)


def connector_status(connectors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """All connectors with whether, and when, they were last discovered. Secrets are masked."""
    last = snapshots.groupBy("connector_id").agg(F.max("discovered_at").alias("last_discovered_at"))
    status = connectors.join(last, "connector_id", "left").withColumn(
        "has_cached_discovery", F.col("last_discovered_at").isNotNull())
    return mask_column(status, "password") if "password" in status.columns else status
