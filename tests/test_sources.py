import json
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from builders import database, schema, users
from lakemeta.sources import iceberg, lake, run_log, snapshots


def test_unreadable_document_counts_as_none(load_documents):
    cat, snaps = load_documents({"good": database(), "bad": "{not json", "text": '"x"'})
    assert [r.connector_id for r in snaps.collect()] == ["good"]
    assert cat.columns.count() == 9


def test_snapshot_history(load_documents, spark, tmp_path):
    path = str(tmp_path / "history")
    first, first_snap = load_documents({"a": database(), "b": database()}, "one")
    later = database([schema(tables=[users()], views=[])], discovered_at="2024-05-02T00:00:00.000Z")
    second, second_snap = load_documents({"a": later}, "two")
    snapshots.save_snapshot(first, first_snap, path)
    snapshots.save_snapshot(second, second_snap, path)
    snapshots.save_snapshot(second, second_snap, path)
    counts = {r.connector_id: r["count"] for r in
              snapshots.load_catalog(spark, path).columns.groupBy("connector_id").count().collect()}
    assert counts == {"a": 3, "b": 9}
    assert snapshots.load_snapshots(spark, path).count() == 2


def test_lake_discovery(spark, tmp_path):
    spark.createDataFrame([(1, "ab", None), (2, "abcd", Decimal("1.5")), (3, None, Decimal("2.5"))],
                          "id BIGINT, name STRING, x DECIMAL(5,2)").write.parquet(f"{tmp_path}/t.parquet")
    tables, columns = lake.discover_lake(spark, str(tmp_path), ["t"])
    assert tables.first().estimated_row_count == 3
    rows = {r.column_name: r for r in columns.collect()}
    assert (rows["id"].full_data_type, rows["id"].has_nulls, rows["id"].ordinal_position) == ("bigint", False, 1)
    assert (rows["name"].character_max_length, rows["name"].has_nulls) == (4, True)
    assert (rows["x"].data_type, rows["x"].full_data_type) == ("decimal", "decimal(5,2)")


def test_iceberg_files(spark, tmp_path):
    def put(folder, name, meta):
        target = tmp_path / folder / "metadata"
        target.mkdir(parents=True, exist_ok=True)
        (target / name).write_text(json.dumps(meta))

    field = {"id": 1, "name": "id", "required": True, "type": "long"}
    old = {"schemas": [{"schema-id": 0, "fields": []}]}
    new = {"current-schema-id": 5, "schemas": [
        {"schema-id": 0, "fields": [field]},
        {"schema-id": 5, "fields": [field, {"id": 2, "name": "s", "required": False, "doc": "d",
                                            "type": {"type": "struct", "fields": []}}]}],
        "partition-specs": [{"spec-id": 0, "fields": [{"name": "d", "transform": "day"}]}],
        "properties": {"a": "b"}, "snapshots": [{"summary": {"total-records": "42"}}]}
    put("sales/eu/orders", "v9.metadata.json", old)
    put("sales/eu/orders", "v10.metadata.json", new)
    put("hr/people", "00001-x.metadata.json", {"metadata": old})
    parsed = iceberg.parse_documents(iceberg.read_iceberg_metadata(spark, str(tmp_path)))
    tables = {(r.namespace, r.table_name): r for r in iceberg.iceberg_tables(parsed).collect()}
    assert set(tables) == {("sales.eu", "orders"), ("hr", "people")}
    assert tables["sales.eu", "orders"].table_comment == "Partitioned by: d(day) | Properties: 1 key(s)"
    assert tables["sales.eu", "orders"].estimated_row_count == 42
    assert tables["hr", "people"].table_comment is None
    columns = {r.column_name: r for r in iceberg.iceberg_columns(parsed).collect()}
    assert columns["s"].full_data_type == '{"type":"struct","fields":[]}'
    assert (columns["s"].data_type, columns["s"].column_comment, columns["s"].is_nullable) == ("struct", "d", True)


def test_run_log(spark, tmp_path):
    good = {"id": "r1", "jobId": "j", "status": "COMPLETED", "startedAt": "2024-01-01T00:00:00Z", "durationMs": 5,
            "diff": {"hasChanges": True, "summary": {"tablesAdded": 2}},
            "ingestionResult": {"created": 1, "skipped": 2, "errors": ["e"]}}
    (tmp_path / "runs.jsonl").write_text("\n".join([json.dumps(good), "", "   ", '{"id": "half', json.dumps({"id": "r2"})]))
    runs, bad = run_log.read_run_log(spark, str(tmp_path / "runs.jsonl"))
    rows = {r.run_id: r for r in runs.collect()}
    assert set(rows) == {"r1", "r2"} and [r.line for r in bad.collect()] == ['{"id": "half']
    assert rows["r1"]["diff"].tables_added == 2 and rows["r1"].ingestion_result.errors == ["e"]
    assert rows["r2"]["diff"] is None


def test_job_log(spark, tmp_path):
    (tmp_path / "jobs.jsonl").write_text(json.dumps({"id": "j", "scheduleType": "daily", "isEnabled": True}))
    jobs, bad = run_log.read_job_log(spark, str(tmp_path / "jobs.jsonl"))
    assert jobs.select("job_id", "schedule_type", "is_enabled").first() == ("j", "daily", True)
    assert bad.filter(F.lit(True)).count() == 0


def test_snapshot_ids_come_back_as_given_and_empty_tables_load(spark, load_documents, tmp_path):
    """A connector of digits with a leading zero, and a catalog without foreign keys and indexes."""
    plain = users(foreignKeys=[], indexes=[])
    path = str(tmp_path / "history")
    for day, tables in ((1, [plain]), (2, [plain])):
        catalog, listed = load_documents({"007": database([schema(tables=tables, views=[])],
                                                          discovered_at=f"2024-05-0{day}T10:00:00.000Z")}, f"day{day}")
        snapshots.save_snapshot(catalog, listed, path)
    newest = snapshots.load_snapshots(spark, path)
    assert [(r.connector_id, r.snapshot_id) for r in newest.collect()] == [("007", "2024-05-02T10:00:00.000Z")]
    loaded = snapshots.load_catalog(spark, path)
    assert {r.connector_id for r in loaded.tables.collect()} == {"007"} and loaded.columns.count() == 3
    assert loaded.foreign_keys.count() == loaded.indexes.count() == 0


def test_a_lake_is_listed_and_scanned_once_a_schema(spark, tmp_path):
    """Eleven tables of three schemas, in files and folders, one of them empty: three scans, and no list of names given."""
    folder = tmp_path / "lake"
    for n in range(6):
        spark.range(n).selectExpr("id", "concat('x', repeat('y', cast(id AS INT))) AS name").write.parquet(f"{folder}/a{n}.parquet")
    for n in range(4):
        spark.range(3).selectExpr("cast(id AS INT) AS k", "nullif(id, 1) AS v").write.parquet(f"{folder}/b {n}.parquet")
    pq.write_table(pa.table({"only": [1.5, None]}), f"{folder}/single.parquet")
    profiles = lake.profile_lake(spark, str(folder))
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
    rows = {r.table_name: r for r in lake.lake_tables(profiles).collect()}
    assert {k: r.estimated_row_count for k, r in rows.items()} == {f"a{n}": n for n in range(6)} | {f"b {n}": 3 for n in range(4)} | {"single": 2}
    columns = {(r.table_name, r.column_name): r for r in lake.lake_columns(profiles).collect()}
    assert columns["a5", "name"].character_max_length == 5 and columns["a0", "name"].character_max_length is None
    assert [columns[f"b {n}", "v"].null_count for n in range(4)] == [1] * 4 and columns["single", "only"].has_nulls
    assert not columns["a0", "id"].has_nulls and len(columns) == 12 + 8 + 1


def test_only_current_iceberg_files_are_read(spark, tmp_path):
    """Of many versions a table the newest is picked by name; the plan reads one file a table. An unreadable older one is never opened."""
    for name, versions in {"a/b/t1": (1, 2, 10, 9), "a/t 2+": (3,), "t3": ("00001-x", "00002-y")}.items():
        metadata = tmp_path / "ice" / name / "metadata"
        metadata.mkdir(parents=True)
        for v in versions:
            (metadata / f"{'v' if isinstance(v, int) else ''}{v}.metadata.json").write_text(f'{{"v":"{v}"}}')
        (metadata / "snap-1.avro").write_text("not metadata")
    (tmp_path / "ice/a/b/t1/metadata/v2.metadata.json").chmod(0)
    read = iceberg.read_iceberg_metadata(spark, str(tmp_path / "ice"))
    got = {(r.namespace, r.table_name): r.document for r in read.collect()}
    assert got == {("a.b", "t1"): '{"v":"10"}', ("a", "t 2+"): '{"v":"3"}', ("", "t3"): '{"v":"00002-y"}'}
    texts = [f for f in read.inputFiles() if f.endswith(".json")]
    assert len(texts) == 3
    (tmp_path / "none").mkdir()
    assert iceberg.read_iceberg_metadata(spark, str(tmp_path / "none")).count() == 0
