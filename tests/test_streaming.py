from collections import Counter

import pytest
from pyspark.sql import functions as F

from builders import database, orders, schema, users
from lakemeta.model import EDGE_KEY, Catalog
from lakemeta.operators import lineage, merge
from lakemeta.operators.discovery import nest_tables
from lakemeta.streaming import batches, buckets, edges, sync, timeouts, upsert

EDGE_DDL = ", ".join(f"{c} STRING" for c in EDGE_KEY)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder stream: ``feed(df)`` adds files, ``feed.stream(n)`` reads them, n files a batch."""
    class Feed:
        folder, schema, number = str(tmp_path / "feed"), None, 0

        def __call__(self, df):
            df.coalesce(1).write.parquet(f"{self.folder}/{self.number}")
            self.schema, self.number = df.schema, self.number + 1

        def stream(self, files=1):
            return (spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files)
                    .parquet(f"{self.folder}/*"))
    return Feed()


@pytest.fixture
def edge_rows(spark):
    def build(n, start=0):
        return spark.range(start, start + n).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot@T@S@APP-A"))
             .otherwise(F.concat(F.lit("c"), F.col("id") % 7, F.lit("@T@S@APP-A"))).alias(EDGE_KEY[0]),
            F.concat(F.lit("d"), F.col("id") % 2, F.lit("@U@S@APP-B")).alias(EDGE_KEY[1]),
            F.element_at(F.array(F.lit("FK"), F.lit("ETL")), (F.col("id") % 2 + 1).cast("int")).alias(EDGE_KEY[2]))
    return build


def test_edges_equal_batch_result(spark, feed, edge_rows, tmp_path):
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    feed(edge_rows(60))
    feed(edge_rows(60, 30))
    edges.collect_edges(feed.stream(), store, checkpoint).awaitTermination()
    feed(edge_rows(10, 500))
    edges.collect_edges(feed.stream(), store, checkpoint).awaitTermination()
    everything = edge_rows(60).unionByName(edge_rows(60, 30)).unionByName(edge_rows(10, 500))
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(edges.read_edges(spark, store)) == rows(lineage.dedup_edges(everything).select(*EDGE_KEY))
    counts = {(r.app_bucket, r.source_type): r.unique_edges for r in edges.read_lineage_counts(spark, checkpoint).collect()}
    summary = lineage.lineage_summary(everything).first()
    assert counts["__CROSS_APP__", "FK"] == summary.fk_edges
    assert edges.read_raw_count(spark, checkpoint).first().total_raw == 130


def test_a_batch_of_edges_costs_the_same_however_long_the_history(spark, feed, edge_rows, tmp_path, monkeypatch):
    """Ten batches: each reads its own file, touches the state of its own edges, and no folder written before."""
    store = str(tmp_path / "store")
    for n in range(10):
        feed(spark.range(40).select(F.concat(F.lit(f"{n}-"), F.col("id") % 20).alias(EDGE_KEY[0]), F.lit("d@U@S@APP-B").alias(EDGE_KEY[1]),
                                    F.lit("FK").alias(EDGE_KEY[2])).unionByName(edge_rows(6)))
    monkeypatch.setattr(batches, "read", lambda *a, **k: pytest.fail("a batch read a table"))
    query = edges.collect_edges(feed.stream(), store, str(tmp_path / "cp"))
    query.awaitTermination()
    seen = [p for p in query.recentProgress if p["numInputRows"]]
    monkeypatch.undo()
    assert [p["numInputRows"] for p in seen] == [46] * 10
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in seen]
    common = lineage.dedup_edges(edge_rows(6)).count()
    assert updated == [20 + common] * 10
    assert [p["stateOperators"][0]["numRowsTotal"] for p in seen] == [20 * n + common for n in range(1, 11)]
    assert edges.read_edges(spark, store).count() == 200 + common


def test_edge_stream_deduplicates(spark, feed, edge_rows, tmp_path):
    feed(edge_rows(60))
    feed(edge_rows(60))
    out = str(tmp_path / "out")
    (edges.dedup_edge_stream(feed.stream()).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == lineage.dedup_edges(edge_rows(60)).count()


def test_a_retried_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    batches.create(spark, path, "k INT, v INT")
    rows = spark.createDataFrame([(1, 1), (2, 1)], "k INT, v INT")
    batches.write(rows, path, 0)
    batches.write(rows, path, 0)
    batches.write(spark.createDataFrame([(1, 2)], "k INT, v INT"), path, 1)
    batches.create(spark, path, "k INT, v INT")
    table = batches.read(spark, path, "k INT, v INT")
    assert table.count() == 3
    assert {r.k: r.v for r in batches.latest(table, ["k"]).collect()} == {1: 2, 2: 1}
    target = str(tmp_path / "compacted")
    batches.compact(spark, path, target, "k INT, v INT", ["k"], upto=1)
    assert {r.k: r.v for r in spark.read.parquet(target).collect()} == {1: 2, 2: 1}


def test_stream_upsert_equals_batch(spark, feed, tmp_path):
    store, ddl = str(tmp_path / "store"), "pid STRING, name STRING, seq BIGINT"
    first = spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], ddl)
    second = spark.createDataFrame([("a", "2", 2), ("c", "1", 3), ("c", "2", 4)], ddl)
    feed(first)
    feed(second)
    stream = feed.stream()
    upsert.stream_upsert(stream, store, str(tmp_path / "cp")).awaitTermination()
    got = {r.pid: r.name for r in upsert.read_store(spark, store, "pid STRING, name STRING").collect()}
    empty = spark.createDataFrame([], "pid STRING, name STRING")
    assert got == {r.pid: r.name for r in merge.upsert_store(empty, first.unionByName(second)).collect()}
    results = upsert.read_results(spark, store, upsert.results_ddl(stream, ["pid"]))
    assert Counter(r.action for r in results.collect()) == Counter(created=3, updated=2)


def test_a_batch_prunes_the_buckets_it_does_not_touch(spark, feed, tmp_path):
    store, ddl = str(tmp_path / "store"), "pid STRING, name STRING, seq BIGINT"
    feed(spark.range(500).select(F.concat(F.lit("p"), "id").alias("pid"), F.lit("0").alias("name"), F.col("id").alias("seq")))
    upsert.stream_upsert(feed.stream(), store, str(tmp_path / "cp")).awaitTermination()
    small = spark.createDataFrame([("p7", "1", 900), ("new", "1", 901)], ddl)
    some = buckets.touched(small, ["pid"], upsert.BUCKETS)
    assert 1 <= len(some) <= 2
    stored = buckets.read(spark, f"{store}/rows", "pid STRING, name STRING", before=1, buckets=some)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line).split("PartitionFilters")[1]
    assert "bucket" in filters and "batch_id" in filters
    read = {r[0] for r in stored.select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1)).distinct().collect()}
    assert read <= set(map(str, some)) and 0 < stored.count() < 60
    feed(small)
    upsert.stream_upsert(feed.stream(), store, str(tmp_path / "cp")).awaitTermination()
    results = upsert.read_results(spark, store, f"{ddl}, action STRING, error STRING").filter("batch_id = 1")
    assert {r.pid: r.action for r in results.collect()} == {"p7": "updated", "new": "created"}


def test_a_compacted_store_goes_on(spark, feed, tmp_path):
    """Compaction of some buckets, then of all, between batches of a stream; the store and the accounting don't change."""
    store, checkpoint, ddl = str(tmp_path / "store"), str(tmp_path / "cp"), "pid STRING, name STRING"
    batch = lambda n: spark.range(40).select(
        F.concat(F.lit("p"), F.col("id") * (n + 1) % 50).alias("pid"), F.lit(str(n)).alias("name"), F.col("id").alias("seq"))
    everything = spark.createDataFrame([], ddl)
    for n in range(4):
        feed(batch(n))
        upsert.stream_upsert(feed.stream(), store, checkpoint, count=8).awaitTermination()
        everything = merge.upsert_store(everything, batch(n))
        if n == 1:
            upsert.compact_store(spark, store, ddl, upto=1, only=[0, 3, 5], count=8)
        if n == 2:
            upsert.compact_store(spark, store, ddl, upto=2, count=8)
            upsert.compact_store(spark, store, ddl, upto=2, count=8)
        got = {r.pid: r.name for r in upsert.read_store(spark, store, ddl).collect()}
        assert got == {r.pid: r.name for r in everything.collect()}
    files = [r[0] for r in buckets.read(spark, f"{store}/rows", ddl).select(F.input_file_name()).distinct().collect()]
    assert not any(f"batch_id={n}/" in f for f in files for n in range(3)) and any("batch_id=3/" in f for f in files)
    results = upsert.read_results(spark, store, f"{ddl}, seq BIGINT, action STRING, error STRING")
    assert results.filter("action = 'created'").select("pid").distinct().count() == results.filter("action = 'created'").count() == len(got)


def test_a_retried_bucket_batch_applies_once(spark, tmp_path):
    path, ddl = str(tmp_path / "rows"), "pid STRING, name STRING"
    buckets.create(spark, path, ddl)
    assert buckets.read(spark, path, ddl).count() == 0
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], ddl)
    for _ in range(2):
        buckets.write(rows, path, 0, ["pid"], 4)
    assert buckets.read(spark, path, ddl, before=0).count() == 0
    assert sorted((r.pid, r.batch_id) for r in buckets.read(spark, path, ddl, before=1).collect()) == [("a", 0), ("b", 0)]


def test_incremental_sync(spark, feed, load_documents, connectors, tmp_path):
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    shorter = users()
    shorter["columns"] = shorter["columns"][:2]
    for number, schemas in enumerate(([schema()], [schema()], [schema(tables=[shorter], views=[])])):
        cat, snaps = load_documents({"test-pg": database(schemas)}, f"v{number}")
        feed(nest_tables(cat).withColumn("snapshot_id", F.lit(f"s{number}")))
    sync.run_incremental_sync(feed.stream(), store, checkpoint, connectors, snaps).awaitTermination()
    runs = {r.snapshot_id: r for r in sync.read_sync_runs(spark, store).collect()}
    assert [runs[f"s{i}"].status for i in range(3)] == ["COMPLETED", "NO_CHANGES", "COMPLETED"]
    assert (runs["s0"].created, runs["s0"].deleted) == (1 + 3 + 9, 0)
    assert (runs["s2"].tables_dropped, runs["s2"].columns_dropped, runs["s2"].deleted) == (2, 7, 9)
    rows = sync.read_catalog_store(spark, store).collect()
    active = {r.pid.split("@")[0] for r in rows if r.is_active == "Y"}
    assert active == {"PUBLIC", "USERS", "USER_ID", "EMAIL"} and len(rows) == 13


def test_a_late_snapshot_is_superseded(spark, feed, load_documents, connectors, tmp_path):
    """A snapshot discovered earlier but arriving later changes nothing; without push nothing is applied at all."""
    shorter = users()
    shorter["columns"] = shorter["columns"][:2]
    whole, snaps = load_documents({"test-pg": database([schema()])}, "whole")
    less, _ = load_documents({"test-pg": database([schema(tables=[shorter], views=[])])}, "less")
    late = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    feed(nest_tables(whole).withColumns({"snapshot_id": F.lit("b"), "discovered_at": late(2)}))
    feed(nest_tables(less).withColumns({"snapshot_id": F.lit("z"), "discovered_at": late(1)}))
    for push in (True, False):
        store = str(tmp_path / f"store-{push}")
        sync.run_incremental_sync(feed.stream(), store, str(tmp_path / f"cp-{push}"), connectors, snaps, push=push).awaitTermination()
        runs = {r.snapshot_id: r for r in sync.read_sync_runs(spark, store).collect()}
        assert (runs["b"].status, runs["z"].status) == ("COMPLETED", "SUPERSEDED")
        assert (runs["b"].tables_found, runs["b"].columns_found) == (3, 9) and runs["b"].columns_added == 9
        assert runs["b"].created == (13 if push else 0)
        assert sync.read_catalog_store(spark, store).filter("is_active = 'Y'").count() == (13 if push else 0)


def test_a_connector_can_report_that_nothing_is_left(spark, feed, load_documents, connectors, tmp_path):
    """Header rows of an empty catalog empty the listed connector, and a schema without tables keeps its container."""
    store = str(tmp_path / "store")
    whole, snaps = load_documents({"test-pg": database([schema()])}, "whole")
    none = Catalog(*[df.limit(0) for df in whole])
    bare = none._replace(schemas=whole.schemas)
    listed = spark.createDataFrame([("test-pg",)], "connector_id STRING")
    for number, cat in enumerate((whole, bare, none)):
        feed(nest_tables(cat, connectors=listed).withColumn("snapshot_id", F.lit(f"s{number}")))
        sync.run_incremental_sync(feed.stream(), store, str(tmp_path / "cp"), connectors, snaps).awaitTermination()
        active = Counter(r.kind for r in sync.read_catalog_store(spark, store).filter("is_active = 'Y'").collect())
        assert active == ({"container": 1, "entity": 3, "element": 9}, {"container": 1}, {})[number]
    runs = {r.snapshot_id: r for r in sync.read_sync_runs(spark, store).collect()}
    assert [runs[f"s{i}"].tables_found for i in range(3)] == [3, 0, 0]
    assert (runs["s1"].status, runs["s1"].tables_dropped, runs["s1"].deleted) == ("COMPLETED", 3, 12)


def test_a_failed_discovery_is_logged_and_changes_nothing(spark, feed, load_documents, connectors, tmp_path):
    store = str(tmp_path / "store")
    cat, snaps = load_documents({"test-pg": database([schema()]), "test-mssql": database([schema("dbo", [orders()], [])])})
    nested = nest_tables(cat).withColumns({"snapshot_id": F.lit("s0"), "error": F.lit(None).cast("string")})
    feed(nested)
    half = nested.filter("connector_id = 'test-pg'").limit(1).withColumn("snapshot_id", F.lit("s1"))
    feed(half.withColumn("error", F.lit("connection refused")).unionByName(
        nested.filter("connector_id = 'test-mssql'").limit(1).withColumns({"snapshot_id": F.lit("s1"), "error": F.lit("Job timed out after 60s")})))
    sync.run_incremental_sync(feed.stream(), store, str(tmp_path / "cp"), connectors, snaps).awaitTermination()
    runs = {(r.connector_id, r.snapshot_id): r for r in sync.read_sync_runs(spark, store).collect()}
    assert (runs["test-pg", "s1"].status, runs["test-pg", "s1"].error) == ("FAILED", "connection refused")
    assert (runs["test-mssql", "s1"].status, runs["test-mssql", "s1"].deleted) == ("TIMED_OUT", 0)
    assert runs["test-pg", "s0"].status == "COMPLETED" and runs["test-pg", "s0"].error is None
    assert all(r.duration_ms > 0 for r in runs.values())
    assert sync.read_catalog_store(spark, store).filter("is_active = 'Y'").count() == 13 + 6


def test_sync_of_several_connectors_in_one_batch(spark, feed, load_documents, connectors, tmp_path):
    store = str(tmp_path / "store")
    cat, snaps = load_documents({"test-pg": database(), "test-mssql": database([schema("dbo", [orders()], [])])})
    feed(nest_tables(cat).withColumn("snapshot_id", F.lit("s0")))
    sync.run_incremental_sync(feed.stream(10), store, str(tmp_path / "cp"), connectors, snaps).awaitTermination()
    created = {r.connector_id: r.created for r in sync.read_sync_runs(spark, store).collect()}
    assert created == {"test-pg": 13, "test-mssql": 6}


def test_run_timeouts(spark, feed, tmp_path):
    events = spark.createDataFrame(
        [(1, "start", 0, 60), (1, "end", 50, None), (2, "start", 0, 60), (2, "end", 90, None), (3, "start", 10, 60),
         (4, "start", 9000, 60), (5, "start", 20000, 5), (5, "end", 20001, None), (6, "start", 100, 9999),
         (6, "end", 3000, None)], "run_id INT, kind STRING, at INT, timeout_seconds INT")
    feed(events.withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)))
    stream = feed.stream()
    timed_out = timeouts.stream_run_timeouts(
        stream.filter("kind = 'start'").withColumnRenamed("ts", "started_at"),
        stream.filter("kind = 'end'").withColumnRenamed("ts", "ended_at").select("run_id", "ended_at"))
    out = str(tmp_path / "out")
    (timed_out.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = {r.run_id: r.error for r in spark.read.parquet(out).collect()}
    assert rows == {i: "Job timed out after 60s" for i in (2, 3, 4)}


def test_timeouts_of_any_length_are_kept(spark, feed, tmp_path):
    """Neither a second nor three hours is altered; an end on the deadline is in time."""
    events = spark.createDataFrame(
        [(1, "start", 0, 1), (2, "start", 0, 10800), (2, "end", 10799, None), (3, "start", 0, 10800), (3, "end", 10801, None),
         (4, "start", 0, 10800), (4, "end", 10800, None), (5, "start", 0, 0), (6, "start", 90000, 60), (7, "end", 90000, None)],
        "run_id INT, kind STRING, at INT, timeout_seconds INT")
    feed(events.withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)))
    stream = feed.stream()
    timed_out = timeouts.stream_run_timeouts(
        stream.filter("kind = 'start'").withColumnRenamed("ts", "started_at"),
        stream.filter("kind = 'end'").withColumnRenamed("ts", "ended_at").select("run_id", "ended_at"))
    out = str(tmp_path / "out")
    (timed_out.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    assert {r.run_id: r.timeout_seconds for r in spark.read.parquet(out).collect()} == {1: 1, 3: 10800, 5: 0}


def test_ends_that_run_ahead_make_no_start_late(spark, feed, tmp_path):
    """The first batch's ends are hours ahead of the second's starts, whose timeouts come out all the same."""
    ddl = "run_id INT, kind STRING, at INT, timeout_seconds INT"
    first = [(1, "start", 0, 60), (2, "start", 5, 9000), (2, "end", 8000, None), (1, "end", 7000, None)]
    second = [(3, "start", 400, 60), (4, "start", 500, 30), (4, "end", 510, None), (5, "start", 20000, 1), (5, "end", 20001, None)]
    for rows in (first, second):
        feed(spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)))
    stream = feed.stream()
    timed_out = timeouts.stream_run_timeouts(
        stream.filter("kind = 'start'").withColumnRenamed("ts", "started_at"),
        stream.filter("kind = 'end'").withColumnRenamed("ts", "ended_at").select("run_id", "ended_at"))
    out = str(tmp_path / "out")
    (timed_out.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    assert {r.run_id for r in spark.read.parquet(out).collect()} == {1, 3}
