"""Run history of discovery jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemeta.functions import fixed_values as fx

RUN_STATUSES = ["RUNNING", "COMPLETED", "FAILED", "TIMED_OUT", "NO_CHANGES"]


def started(runs: DataFrame) -> Column:
    """Start time; text that is no time sorts as the epoch."""
    column = F.col("started_at")
    kind = runs.schema["started_at"].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.try_to_timestamp(column), F.timestamp_seconds(F.lit(0)))
    return F.coalesce(column, F.timestamp_seconds(F.lit(0)).cast(kind))


def latest_runs(runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """Each job's newest run; among equal start times the first logged (smallest ``tie``)."""
    rest = [c for c in runs.columns if c != "job_id"]
    newest_first = F.struct((-F.unix_micros(started(runs).cast("timestamp"))).alias("age"), F.col(tie))
    best = runs.groupBy("job_id").agg(F.min_by(F.struct(*rest), newest_first).alias("_best"))
    return best.select("job_id", "_best.*").select(*runs.columns)


def list_runs(runs: DataFrame, job_id=None, k: int = 20, tie: str = "run_id") -> DataFrame:
    """The ``k`` newest runs, of all jobs or one."""
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    if job_id is not None:
        runs = runs.filter(F.col("job_id") == job_id)
    return runs.orderBy(started(runs).desc(), F.col(tie)).limit(k)


def jobs_with_latest(jobs: DataFrame, runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """All jobs, with their newest run's summary where there is one."""
    latest = latest_runs(runs, tie).select(
        "job_id", F.col(tie).alias("latest_run_id"), F.col("status").alias("latest_status"),
        F.col("started_at").alias("latest_started_at"),
        F.col("duration_ms").alias("latest_duration_ms"))
    return jobs.join(latest, "job_id", "left")


def recover_orphans(runs: DataFrame, as_of) -> DataFrame:
    """Closes runs left RUNNING: failed, completed at ``as_of``, lasting until then."""
    kind = runs.schema["started_at"].dataType
    now = F.lit(str(as_of)).cast(T.TimestampType() if isinstance(kind, T.StringType) else kind)
    stale = F.col("status") == "RUNNING"
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    lasted = millis(now) - millis(started(runs))
    changed = lambda name, value: F.when(stale, value).otherwise(
        F.col(name) if name in runs.columns else F.lit(None))
    times = {f.name: f.dataType for f in runs.schema}
    updates = {
        "status": changed("status", F.lit("FAILED")),
        "error": changed("error", F.lit(fx.ORPHANED_RUN_ERROR)),
        "completed_at": changed("completed_at", now.cast(times.get("completed_at", times["started_at"]))),
        "duration_ms": changed("duration_ms", F.when(F.col("started_at").isNotNull(), lasted)
                               .otherwise(F.col("duration_ms")))}
    return runs.withColumns(updates)


def classify_outcome(df: DataFrame, error: str = "error", has_changes: str = "has_changes") -> DataFrame:
    """Status of a finished run from its error text and whether its diff found anything."""
    status = (F.when(F.col(error).contains("timed out"), F.lit("TIMED_OUT"))
               .when(F.col(error).isNotNull(), F.lit("FAILED"))
               .when(F.col(has_changes), F.lit("COMPLETED"))
               .otherwise(F.lit("NO_CHANGES")))
    return df.withColumn("outcome", status)


# --- health ----------------------------------------------------------------------------------

def run_status_mix(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs per status; with ``by``, per group too."""
    return runs.groupBy(*(by or []), "status").agg(F.count("*").alias("runs"))


def last_success(runs: DataFrame, key: str = "job_id") -> DataFrame:
    """When each job or connector last succeeded; NO_CHANGES is a success. Start times given as text are
    compared as times; text that is no time counts as the epoch."""
    ok = F.col("status").isin("COMPLETED", "NO_CHANGES")
    return runs.groupBy(key).agg(
        F.max(F.when(ok & F.col("started_at").isNotNull(), started(runs))).alias("last_success_at"),
        F.count_if(ok).alias("successes"), F.count("*").alias("runs"))


def duration_trend(runs: DataFrame, bucket: str = "day", key: str = "job_id",
                   window: int = 3) -> DataFrame:
    """Run durations per job and time bucket, with the previous bucket and a moving total.

    Runs are first reduced to one row per bucket; only those rows enter the per-job window, so its
    size follows calendar time, not the number of runs.
    """
    kind = runs.schema["started_at"].dataType
    start = F.date_trunc(bucket, started(runs)).cast("timestamp" if isinstance(kind, T.StringType) else kind)
    buckets = (runs.filter(F.col("duration_ms").isNotNull())
               .groupBy(key, start.alias("bucket"))
               .agg(F.count("*").alias("runs"), F.sum("duration_ms").alias("total_ms"),
                    F.max("duration_ms").alias("max_ms")))
    ordered = Window.partitionBy(key).orderBy("bucket")
    recent = ordered.rowsBetween(-(window - 1), 0)
    return buckets.select(
        "*", F.lag("max_ms").over(ordered).alias("previous_max_ms"),
        F.sum("total_ms").over(recent).alias("recent_total_ms"),
        F.sum("runs").over(recent).alias("recent_runs"))


def run_health(runs: DataFrame, key: str = "connector_id") -> DataFrame:
    """Per connector: rejected operations and errors of its deltas, and the churn its diffs saw."""
    skipped = F.col("ingestion_result.skipped")
    errors = F.size("ingestion_result.errors")
    churn = sum((F.coalesce(F.col(f"diff.{c}"), F.lit(0)) for c in (
        "tables_added", "tables_dropped", "tables_modified", "columns_added", "columns_dropped",
        "columns_modified", "pk_changes", "fk_changes", "index_changes")), F.lit(0))
    zero = F.lit(0).cast("bigint")
    return runs.groupBy(key).agg(
        F.count("*").alias("runs"),
        F.coalesce(F.sum(skipped), zero).alias("skipped"),
        F.coalesce(F.sum(F.when(errors > 0, errors)), zero).alias("errors"),
        F.sum(churn).alias("churn"))
