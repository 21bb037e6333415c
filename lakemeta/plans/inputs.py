"""Catalogs assembled from the workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemeta.model import SCHEMA_KEY, Catalog
from lakemeta.operators import discovery
from lakemeta.plans.workloads import load


def workload_catalog(spark: SparkSession, sf_dir: str, side: str = "all") -> Catalog:
    tables = load(spark, sf_dir, f"catalog_tables_{side}")
    return Catalog(
        schemas=tables.select(*SCHEMA_KEY).distinct(),
        tables=tables,
        columns=load(spark, sf_dir, f"catalog_columns_{side}"),
        primary_keys=discovery.assemble_primary_keys(load(spark, sf_dir, f"raw_primary_keys_{side}")),
        foreign_keys=discovery.assemble_foreign_keys(load(spark, sf_dir, f"raw_imported_keys_{side}")),
        indexes=discovery.assemble_indexes(load(spark, sf_dir, f"raw_index_info_{side}")))


def versions(connectors: DataFrame) -> DataFrame:
    """One snapshot row per connector, naming its server version."""
    return connectors.select("connector_id", F.concat(
        F.lit("Server release with a rather long product name, build "),
        "connector_id").alias("server_version"))
