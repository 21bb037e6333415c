"""The five driver-metadata result sets as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemeta.model import RawMetadata


def read_raw_metadata(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                      names: dict[str, str] | None = None, **options: str) -> RawMetadata:
    """Reads tables, columns, primary keys, imported keys and index info.

    From files, each set is a sub-folder of ``path``. With ``fmt="jdbc"`` each is a table or view
    of the database that ``options`` connect to, with a driver the user supplies; add
    ``partitionColumn`` and bounds there to read in parallel. ``names`` renames the sets.
    """
    def read(name: str) -> DataFrame:
        name = (names or {}).get(name, name)
        reader = spark.read.format(fmt).options(**options)
        df = reader.option("dbtable", name).load() if fmt == "jdbc" else reader.load(f"{path}/{name}")
        return df.toDF(*[c.lower() for c in df.columns])

    return RawMetadata(*[read(name) for name in RawMetadata._fields])
