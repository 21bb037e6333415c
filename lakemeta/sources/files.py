"""Parquet tables, spread over the cores when their files alone would not be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reads a parquet table.

    A table in fewer files than there are cores — in the extreme one file with one row group —
    would run every map-side step on as few tasks. Only such a table is redistributed, after column
    pruning and filters, which still reach the scan. A table of many files is read as it lies.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def list_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, inside) of every file below ``folder`` whose name fits the glob: its full path and the parts of it
    that lie inside the folder. Only names are listed; no file is opened."""
    quoted = "\\Q" + folder.rstrip("/").removeprefix("file:") + "\\E"
    inside = F.split(F.regexp_replace("path", "^.*?" + quoted + "/+", ""), "/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
             .load(folder).select("path"))
    return files.select("path", inside.alias("inside"))


def file_path() -> Column:
    """The file a row comes from, as ``list_files`` names it; the metadata column has it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
