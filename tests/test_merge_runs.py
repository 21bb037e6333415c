from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakemeta.operators import merge, payload, runs


@pytest.fixture
def store(spark):
    return spark.createDataFrame([("a", "old"), ("b", "old")], "pid STRING, name STRING")


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([("a", "1", 0), ("c", "2", 1), ("c", "3", 2)], "pid STRING, name STRING, seq BIGINT")


def test_upsert(store, batch):
    actions = {(r.pid, r.seq): r.action for r in merge.upsert_results(store, batch).collect()}
    assert actions == {("a", 0): "updated", ("c", 1): "created", ("c", 2): "updated"}
    after = {r.pid: r.name for r in merge.upsert_store(store, batch).collect()}
    assert after == {"a": "1", "b": "old", "c": "3"}


def test_second_upsert_only_updates(store, batch):
    after = merge.upsert_store(store, batch)
    row = merge.ingestion_summary(merge.upsert_results(after, batch)).first()
    assert (row.total, row.created, row.updated, row.failed, row.status) == (3, 0, 3, 0, "completed")


def test_entity_payload_without_container_is_rejected_whole(spark, store):
    batch = spark.createDataFrame([("x", 1, "a"), ("y", 2, "zz"), ("z", 2, "zz")],
                                  "pid STRING, payload_id INT, container_pid STRING")
    accepted, rejected = merge.split_entity_batch(store, batch)
    assert [r.pid for r in accepted.collect()] == ["x"]
    row = merge.rejected_payloads(rejected).first()
    assert (row.payload_id, row.rejected_rows, row.error) == (2, 2, "Container not found: zz")


def test_lineage_upsert(spark):
    ddl = "application_pid STRING, source_element_pid STRING, target_element_pid STRING, lineage_source STRING, seq INT"
    edges = spark.createDataFrame([("A", "s", "t", "FK", 0), ("A", "s", "t", "ETL", 1), ("A", "x", "x", None, 2),
                                   ("A", "u", "v", None, 3), ("A", "q", "r", "GUESS", 4), ("B", "s", "t", "FK", 5)], ddl)
    empty = spark.createDataFrame([], "application_pid STRING, edge_key STRING, source_element_pid STRING, "
                                      "target_element_pid STRING, lineage_source STRING")
    after, results = merge.upsert_lineage(empty, edges)
    assert {(r.application_pid, r.edge_key): r.lineage_source for r in after.collect()} == {
        ("A", "s|t"): "ETL", ("A", "u|v"): "FK", ("B", "s|t"): "FK"}
    row = merge.ingestion_summary(results).first()
    assert (row.created, row.updated, row.failed, row.status) == (3, 1, 2, "partial")
    errors = {r.edge_key: r.error for r in results.collect() if r.error}
    assert errors == {"x→self": "Self-referencing edge", "q|r": "Invalid lineage_source: GUESS"}


def test_required_fields(spark):
    df = spark.createDataFrame([("a", "x"), (" ", None)], "application_pid STRING, container STRING")
    rows = merge.missing_fields(df, ["application_pid", "container"]).collect()
    assert [r.missing for r in rows] == ["application_pid,container"]


def test_push_of_nothing(spark):
    none = spark.createDataFrame([], "created BIGINT, updated BIGINT, failed BIGINT")
    assert set(payload.push_totals(none).first().asDict().values()) == {0}


# --- runs ------------------------------------------------------------------------------------

@pytest.fixture
def history(spark):
    return spark.createDataFrame(
        [(1, "j", "2024-01-01T00:00:00Z", "COMPLETED", 10), (2, "j", "2024-01-02T00:00:00Z", "RUNNING", None),
         (3, "j", "2024-01-02T00:00:00Z", "FAILED", 5), (4, "k", "not a time", "NO_CHANGES", 7)],
        "run_id INT, job_id STRING, started_at STRING, status STRING, duration_ms BIGINT")


def test_latest_and_recent(history):
    assert {r.job_id: r.run_id for r in runs.latest_runs(history).collect()} == {"j": 2, "k": 4}
    assert [r.run_id for r in runs.list_runs(history).collect()] == [2, 3, 1, 4]
    assert [r.run_id for r in runs.list_runs(history, "j", k=1).collect()] == [2]
    assert runs.list_runs(history, k=500).count() == 4
    with pytest.raises(ValueError):
        runs.list_runs(history, k=0)


def test_jobs_without_runs_stay(history, spark):
    jobs = spark.createDataFrame([("j",), ("none",)], "job_id STRING")
    rows = {r.job_id: r.latest_run_id for r in runs.jobs_with_latest(jobs, history).collect()}
    assert rows == {"j": 2, "none": None}


def test_orphans(history):
    rows = {r.run_id: r for r in runs.recover_orphans(history, "2024-01-02 00:00:01").collect()}
    assert (rows[2].status, rows[2].duration_ms) == ("FAILED", 1000)
    assert rows[2].error == "Orphaned run recovered on startup"
    assert (rows[1].status, rows[1].error, rows[1].completed_at) == ("COMPLETED", None, None)


def test_logged_runs_have_text_ids_and_times(history, spark):
    logged = history.withColumn("run_id", F.concat(F.lit("r"), "run_id")).withColumn(
        "completed_at", F.col("started_at"))
    assert {r.job_id: r.run_id for r in runs.latest_runs(logged).collect()} == {"j": "r2", "k": "r4"}
    closed = {r.run_id: r.completed_at for r in runs.recover_orphans(logged, "2024-01-02 00:00:01").collect()}
    assert (closed["r2"], closed["r1"]) == ("2024-01-02 00:00:01", "2024-01-01T00:00:00Z")


def test_outcomes(spark):
    df = spark.createDataFrame([(None, True), (None, False), ("Job timed out after 9s", None), ("boom", True)],
                               "error STRING, has_changes BOOLEAN")
    assert Counter(r.outcome for r in runs.classify_outcome(df).collect()) == Counter(
        ["COMPLETED", "NO_CHANGES", "TIMED_OUT", "FAILED"])
