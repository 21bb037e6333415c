"""JSON-lines logs of jobs and runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN_LINE = """id STRING, jobId STRING, connectorId STRING, status STRING, triggeredBy STRING,
 startedAt STRING, completedAt STRING, durationMs BIGINT,
 discoverySummary STRUCT<schemasFound: BIGINT, tablesFound: BIGINT, viewsFound: BIGINT,
   columnsFound: BIGINT, foreignKeysFound: BIGINT, indexesFound: BIGINT, discoveryDurationMs: BIGINT>,
 diff STRUCT<hasChanges: BOOLEAN, summary: STRUCT<tablesAdded: BIGINT, tablesDropped: BIGINT,
   tablesModified: BIGINT, columnsAdded: BIGINT, columnsDropped: BIGINT, columnsModified: BIGINT,
   pkChanges: BIGINT, fkChanges: BIGINT, indexChanges: BIGINT>>,
 ingestionResult STRUCT<created: BIGINT, updated: BIGINT, deleted: BIGINT, skipped: BIGINT,
   errors: ARRAY<STRING>>,
 error STRING"""
_JOB_LINE = """id STRING, connectorId STRING, name STRING, scheduleType STRING, intervalSeconds BIGINT,
 dailyRunTime STRING, timeoutSeconds BIGINT, pushChanges BOOLEAN, isEnabled BOOLEAN, nextRunAt STRING"""
_BAD = "_bad"


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def _renamed(kind: T.DataType) -> T.DataType:
    """The type with its struct fields in snake case; a cast renames them by position."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(_snake(f.name), _renamed(f.dataType)) for f in kind])
    return kind


def _read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json(
        "value", f"{schema}, {_BAD} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    malformed = F.col(f"_row.{_BAD}").isNotNull() | F.col("_row").isNull()
    rows = parsed.filter(~malformed).select("_row.*").drop(_BAD)
    rows = rows.select(*[F.col(f.name).cast(_renamed(f.dataType)).alias(_snake(f.name))
                         for f in rows.schema])
    return rows, parsed.filter(malformed).select(F.col("value").alias("line"))


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, bad lines) of a JSON-lines run log. Blank lines vanish, malformed ones are reported."""
    runs, bad = _read_lines(spark, path, _RUN_LINE)
    flat = F.when(F.col("diff").isNotNull(), F.struct("diff.has_changes", "diff.summary.*"))
    return runs.withColumnRenamed("id", "run_id").withColumn("diff", flat), bad


def read_job_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    jobs, bad = _read_lines(spark, path, _JOB_LINE)
    return jobs.withColumnRenamed("id", "job_id"), bad
