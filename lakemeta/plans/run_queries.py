"""Queries over run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemeta.operators import runs
from lakemeta.plans.registry import query
from lakemeta.plans.workloads import ctes, load, table

_AS_OF = "2024-06-01 12:00:00"
_RUN = "run_id, job_id, started_at, duration_ms, status, error"
_LATEST = """SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, run_id) AS rn FROM runs"""


def _runs(spark, sf_dir):
    return load(spark, sf_dir, "runs")


@query(f"{ctes('runs')} SELECT {_RUN} FROM ({_LATEST}) WHERE rn = 1")
def latest_runs(spark, sf_dir):
    return runs.latest_runs(_runs(spark, sf_dir))


@query(f"{ctes('runs')} SELECT {_RUN} FROM runs ORDER BY started_at DESC, run_id LIMIT 500")
def recent_runs(spark, sf_dir):
    return runs.list_runs(_runs(spark, sf_dir), k=500)


@query(f"{ctes('runs')} SELECT {_RUN} FROM runs WHERE job_id = 7 ORDER BY started_at DESC, run_id LIMIT 20")
def recent_job_runs(spark, sf_dir):
    return runs.list_runs(_runs(spark, sf_dir), job_id=7)


@query(f"""{ctes("runs")} SELECT c_custkey AS job_id, c_mktsegment AS name, run_id AS latest_run_id,
  status AS latest_status, started_at AS latest_started_at, duration_ms AS latest_duration_ms
FROM customer LEFT JOIN (SELECT * FROM ({_LATEST}) WHERE rn = 1) l ON l.job_id = c_custkey""")
def jobs_latest(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("name"))
    return runs.jobs_with_latest(jobs, _runs(spark, sf_dir))


@query(f"""{ctes("runs")} SELECT run_id, job_id, started_at,
  CASE WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS status,
  CASE WHEN status = 'RUNNING' THEN 'Orphaned run recovered on startup' ELSE error END AS error,
  CASE WHEN status = 'RUNNING' THEN TIMESTAMP '{_AS_OF}' END AS completed_at,
  CASE WHEN status = 'RUNNING' THEN epoch_us(TIMESTAMP '{_AS_OF}') // 1000 - epoch_us(started_at) // 1000
    ELSE duration_ms END AS duration_ms FROM runs""")
def recovered_runs(spark, sf_dir):
    return runs.recover_orphans(_runs(spark, sf_dir), _AS_OF)


@query(f"""{ctes("finished_runs")} SELECT *, CASE WHEN error LIKE '%timed out%' THEN 'TIMED_OUT'
  WHEN error IS NOT NULL THEN 'FAILED' WHEN has_changes THEN 'COMPLETED' ELSE 'NO_CHANGES' END AS outcome
FROM finished_runs""")
def run_outcomes(spark, sf_dir):
    return runs.classify_outcome(load(spark, sf_dir, "finished_runs"))


@query(f"{ctes('runs')} SELECT job_id, status, count(*) AS runs FROM runs GROUP BY ALL")
def run_status_mix(spark, sf_dir):
    return runs.run_status_mix(_runs(spark, sf_dir), ["job_id"])


@query(f"""{ctes("runs")} SELECT job_id, max(started_at) FILTER (ok) AS last_success_at,
  count(*) FILTER (ok) AS successes, count(*) AS runs
FROM (SELECT *, status IN ('COMPLETED', 'NO_CHANGES') AS ok FROM runs) GROUP BY job_id""")
def last_success(spark, sf_dir):
    return runs.last_success(_runs(spark, sf_dir))


@query(f"""{ctes("runs")}, b AS (SELECT job_id, date_trunc('day', started_at) AS bucket, count(*) AS runs,
  CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms FROM runs
  WHERE duration_ms IS NOT NULL GROUP BY ALL)
SELECT job_id, CAST(bucket AS TIMESTAMP) AS bucket, runs, total_ms, max_ms,
  lag(max_ms) OVER w AS previous_max_ms,
  CAST(sum(total_ms) OVER (w ROWS 2 PRECEDING) AS BIGINT) AS recent_total_ms,
  CAST(sum(runs) OVER (w ROWS 2 PRECEDING) AS BIGINT) AS recent_runs
FROM b WINDOW w AS (PARTITION BY job_id ORDER BY bucket)""")
def duration_trend(spark, sf_dir):
    return runs.duration_trend(_runs(spark, sf_dir))


@query("""SELECT 'conn-' || (user_id % 10) AS connector_id, count(*) AS runs,
  CAST(coalesce(sum(event_id % 4) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS skipped,
  count(*) FILTER (event_type = 'purchase' AND event_id % 4 > 0) AS errors,
  CAST(coalesce(sum(event_id % 3 + event_id % 5) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS churn
FROM events GROUP BY ALL""")
def run_health(spark, sf_dir):
    ok = F.col("event_type") == "purchase"
    counters = {name: F.lit(0).cast("bigint") for name in (
        "tables_added", "tables_dropped", "tables_modified", "columns_added", "columns_dropped",
        "columns_modified", "pk_changes", "fk_changes", "index_changes")}
    counters |= {"tables_added": F.col("event_id") % 3, "columns_modified": F.col("event_id") % 5}
    skipped = F.col("event_id") % 4
    errors = F.when(skipped > 0, F.array(F.lit("rejected"))).otherwise(F.array().cast("array<string>"))
    history = table(spark, sf_dir, "events").select(
        F.concat(F.lit("conn-"), (F.col("user_id") % 10).cast("string")).alias("connector_id"),
        F.when(ok, F.struct(*[c.alias(n) for n, c in counters.items()])).alias("diff"),
        F.when(ok, F.struct(skipped.alias("skipped"), errors.alias("errors"))).alias("ingestion_result"))
    return runs.run_health(history)


# Start times as text, some of them no times at all.
_TEXT_RUNS = """SELECT *, CASE WHEN run_id % 50 = 0 THEN 'garbage' ELSE CAST(started_at AS STRING) END AS started_text FROM runs"""


@query(f"""{ctes("runs")}, t AS (SELECT *, coalesce(try_cast(started_text AS TIMESTAMP), TIMESTAMP '1970-01-01') AS s
  FROM ({_TEXT_RUNS})) SELECT job_id, max(s) FILTER (ok) AS last_success_at, count(*) FILTER (ok) AS successes,
  count(*) AS runs FROM (SELECT *, status IN ('COMPLETED', 'NO_CHANGES') AS ok FROM t) GROUP BY job_id""")
def last_success_of_text_times(spark, sf_dir):
    text = F.when(F.col("run_id") % 50 == 0, F.lit("garbage")).otherwise(F.col("started_at").cast("string"))
    return runs.last_success(_runs(spark, sf_dir).withColumn("started_at", text))
