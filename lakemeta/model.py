"""Canonical flat tables, as DDL schemas. Every catalog entity is one DataFrame keyed by names."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

SCHEMA_KEY = ["connector_id", "schema_name"]
TABLE_KEY = [*SCHEMA_KEY, "table_name"]
COLUMN_KEY = [*TABLE_KEY, "column_name"]

EDGE_PAIR = ["source_element_pid", "target_element_pid"]
EDGE_KEY = [*EDGE_PAIR, "source_type"]

CONNECTORS = (
    "connector_id STRING, database_type STRING, database_name STRING, schemas ARRAY<STRING>")

SNAPSHOTS = (
    "connector_id STRING, snapshot_id STRING, database_name STRING, server_version STRING, "
    "database_type STRING, discovered_at TIMESTAMP, duration_ms BIGINT")

SCHEMAS = ("connector_id STRING, schema_name STRING")

TABLES = (
    "connector_id STRING, schema_name STRING, table_name STRING, table_type STRING, "
    "table_comment STRING, estimated_row_count BIGINT, size_bytes BIGINT")

COLUMNS = (
    "connector_id STRING, schema_name STRING, table_name STRING, column_name STRING, "
    "ordinal_position INT, data_type STRING, full_data_type STRING, is_nullable BOOLEAN, "
    "column_default STRING, character_max_length INT, numeric_precision INT, numeric_scale INT, "
    "column_comment STRING, is_primary_key BOOLEAN, is_auto_increment BOOLEAN")

PRIMARY_KEYS = (
    "connector_id STRING, schema_name STRING, table_name STRING, constraint_name STRING, "
    "columns ARRAY<STRING>")

FOREIGN_KEYS = (
    "connector_id STRING, schema_name STRING, table_name STRING, constraint_name STRING, "
    "columns ARRAY<STRING>, referenced_schema STRING, referenced_table STRING, "
    "referenced_columns ARRAY<STRING>")

INDEXES = (
    "connector_id STRING, schema_name STRING, table_name STRING, index_name STRING, "
    "columns ARRAY<STRING>, is_unique BOOLEAN")

EDGES = (
    "source_element_pid STRING, target_element_pid STRING, source_type STRING, "
    "source_app_pid STRING, target_app_pid STRING, seq BIGINT")

RUNS = (
    "id STRING, job_id STRING, connector_id STRING, status STRING, triggered_by STRING, "
    "started_at STRING, completed_at STRING, duration_ms BIGINT, "
    "discovery_summary STRUCT<schemas_found: BIGINT, tables_found: BIGINT, views_found: BIGINT, "
    "columns_found: BIGINT, foreign_keys_found: BIGINT, indexes_found: BIGINT, "
    "discovery_duration_ms: BIGINT>, "
    "diff STRUCT<has_changes: BOOLEAN, tables_added: BIGINT, tables_dropped: BIGINT, "
    "tables_modified: BIGINT, columns_added: BIGINT, columns_dropped: BIGINT, "
    "columns_modified: BIGINT, pk_changes: BIGINT, fk_changes: BIGINT, index_changes: BIGINT>, "
    "ingestion_result STRUCT<created: BIGINT, updated: BIGINT, deleted: BIGINT, skipped: BIGINT, "
    "errors: ARRAY<STRING>>, error STRING")

CATALOG_STORE = (
    "pid STRING, kind STRING, parent_pid STRING, application_pid STRING, name STRING, "
    "description STRING, type_pid STRING, server STRING, position INT, length INT, "
    "`precision` INT, scale INT, pii_indicator STRING, is_active STRING")


class RawMetadata(NamedTuple):
    """The five driver-metadata result sets, already tagged with connector and schema."""

    tables: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    imported_keys: DataFrame
    index_info: DataFrame


class Catalog(NamedTuple):
    """One or more connectors' catalogs as flat tables."""

    schemas: DataFrame
    tables: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame
    indexes: DataFrame
