import datetime as dt

import pytest
from pyspark.sql import functions as F

from builders import database, orders, schema, users
from lakemeta.model import SNAPSHOTS
from lakemeta.operators import catalog, paging, payload
from lakemeta.operators.payload import catalog_rows, element_rows, entity_rows
from lakemeta.sources import exports


@pytest.fixture
def cat(load_documents):
    return load_documents({"test-pg": database()})[0]


def test_search(cat):
    assert {r.column_name for r in catalog.search_columns(cat.columns, "EMAIL").collect()} == {"email"}
    found = catalog.search_columns(cat.columns, ".*_id$").collect()
    assert found and all(r.column_name.endswith("_id") for r in found)
    assert catalog.search_columns(cat.columns, "email", "test-mssql").count() == 0
    assert catalog.search_columns(cat.columns, "zzz_nonexistent").count() == 0


@pytest.mark.parametrize("pattern", ["[unclosed", "a" * 501, ""])
def test_bad_patterns(cat, pattern):
    with pytest.raises(ValueError):
        catalog.search_columns(cat.columns, pattern)


def test_schema_filter_ignores_case_and_a_lone_table(cat):
    assert catalog.get_schema(cat.tables, "PUBLIC").count() == 3
    assert catalog.get_schema(cat.tables, "PUBLIC", "Users").count() == 1
    assert catalog.get_schema(cat.tables, table="Users").count() == 3
    assert catalog.get_schema(cat.tables, "missing").count() == 0


def test_page(spark):
    df = spark.range(50)
    rows = paging.page(df, ["id"], limit=10, offset=45).collect()
    assert [(r.id, r.total_count) for r in rows] == [(i, 50) for i in range(45, 50)]
    rows = paging.page(df, ["id"], limit=3, after=(44,)).collect()
    assert [(r.id, r.total_count) for r in rows] == [(i, 50) for i in (45, 46, 47)]
    for limit, offset in ((0, 0), (10001, 0), (1, -1)):
        with pytest.raises(ValueError):
            paging.page(df, ["id"], limit, offset)


def test_column_sheet_badges(cat):
    rows = {(r.table_name, r.column_name): r for r in catalog.column_sheet(cat).collect()}
    assert rows["orders", "user_id"].fk_badge and not rows["orders", "user_id"].pk_badge
    assert rows["users", "user_id"].pk_badge and not rows["active_users", "user_id"].pk_badge
    assert rows["users", "email"].nullable == "YES"


def snapshot(connector, number, when):
    return (connector, str(number), "db", "1", "POSTGRESQL", when, 5)


@pytest.fixture
def snapshots(spark):
    day = dt.datetime(2024, 5, 1)
    hours = lambda n: day + dt.timedelta(hours=n)
    return spark.createDataFrame(
        [snapshot("a", 1, hours(0)), snapshot("a", 2, hours(30)), snapshot("b", 3, hours(1))], SNAPSHOTS)


def test_latest_fresh_and_retained(snapshots):
    ids = lambda df: sorted(r.snapshot_id for r in df.collect())
    assert ids(catalog.latest_snapshots(snapshots)) == ["2", "3"]
    assert ids(catalog.fresh_snapshots(snapshots, "2024-05-02 01:00:00")) == ["3"]
    assert ids(catalog.fresh_snapshots(snapshots, "2024-05-02 00:00:00")) == ["1", "3"]
    assert ids(catalog.fresh_snapshots(snapshots, "2024-05-02 07:00:00", ttl_hours=1)) == ["2"]
    assert ids(catalog.retain_newest(snapshots, 2)) == ["2", "3"]


def test_connector_status(spark, snapshots):
    connectors = spark.createDataFrame([("a", "x"), ("c", "")], "connector_id STRING, password STRING")
    rows = {r.connector_id: r for r in catalog.connector_status(connectors, snapshots).collect()}
    assert rows["a"].has_cached_discovery and rows["a"].password == "********"
    assert not rows["c"].has_cached_discovery and rows["c"].last_discovered_at is None


# --- payloads and exports --------------------------------------------------------------------

APP = "APP-DISC-TEST-PG-POSTGRESQL-01"


@pytest.fixture
def rows(load_documents, connectors):
    cat, snaps = load_documents({"test-pg": database()})
    return catalog_rows(cat, connectors, snaps)


def test_catalog_rows(rows):
    by_pid = {r.pid: r for r in rows.collect()}
    container = by_pid[f"PUBLIC@{APP}"]
    assert container.description == "POSTGRESQL PostgreSQL 15.2 — public schema"
    assert (container.type_pid, container.server) == ("TYP-RDBMS", "discovered-via-mcp")
    assert by_pid[f"USERS@PUBLIC@{APP}"].description == "TABLE ~1,000 rows"
    assert by_pid[f"ACTIVE_USERS@PUBLIC@{APP}"].type_pid == "ENT-TYP-VW"
    user_id = by_pid[f"USER_ID@USERS@PUBLIC@{APP}"]
    assert user_id.description == "int4 NOT NULL PK AUTO_INCREMENT"
    assert (user_id.type_pid, user_id.position, user_id.pii_indicator) == ("DTYPE-INTEGER", 1, "N")
    assert by_pid[f"USER_ID@ORDERS@PUBLIC@{APP}"].description == "int4 NOT NULL FK"
    assert {r.is_active for r in by_pid.values()} == {"Y"} and len(by_pid) == 1 + 3 + 9


def test_unlisted_connector_keeps_its_rows(cat, spark):
    none = spark.createDataFrame([], "connector_id STRING, database_type STRING")
    assert entity_rows(cat.tables, none).count() == 3
    pid = element_rows(cat.columns, cat.foreign_keys, none).first().application_pid
    assert pid == "APP-DISC-TEST-PG-UNKNOWN-01"


def test_container_documents_hold_every_row_however_split(rows):
    for size in (1, 2, 500):
        documents = exports.container_documents(rows, entities_per_document=size).collect()
        names = [e.entity.data_entity_name for d in documents for e in d.entities]
        assert sorted(names) == ["active_users", "orders", "users"]
        assert {d.container.data_container_pid for d in documents} == {f"PUBLIC@{APP}"}
    [users_entity] = [e for d in documents for e in d.entities if e.entity.data_entity_name == "users"]
    assert [e.data_element_name for e in users_entity.elements] == ["user_id", "email", "name"]


def test_payload_json(rows, spark, tmp_path):
    exports.write_container_payloads(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.select(F.size("entities").alias("n")).first().n == 3


def test_inventory_csv(load_documents, tmp_path):
    table = users()
    table["columns"][1]["columnName"] = "description,field"
    table["columns"][2]["columnName"] = 'say "hi"'
    cat, _ = load_documents({"test-pg": database([schema(tables=[table], views=[]), schema("hr", [orders()], [])])})
    out = tmp_path / "csv"
    exports.write_inventory_csv(cat.columns, str(out), schema="PUBLIC")
    lines = [line for f in sorted(out.glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "connector,schema,table,column,dataType,fullDataType,nullable,isPrimaryKey"
    body = [line for line in lines if line != lines[0]]
    assert 'test-pg,public,users,"description,field",varchar,varchar(255),true,false' in body
    assert 'test-pg,public,users,"say ""hi""",varchar,varchar(100),true,false' in body
    assert len(body) == 3


def test_a_history_of_snapshots_gives_one_container_a_schema(spark):
    schemas = spark.createDataFrame([("c", "s")], "connector_id STRING, schema_name STRING")
    history = spark.createDataFrame(
        [("c", "1", "MYSQL", "v" * 60, 1), ("c", "2", "MYSQL", "w" * 60, 2)],
        "connector_id STRING, snapshot_id STRING, database_type STRING, server_version STRING, day INT").withColumn(
        "discovered_at", F.timestamp_seconds("day"))
    rows = payload.container_rows(schemas, history, history).collect()
    assert len(rows) == 1 and "w" * 60 in rows[0].description
    short = payload.container_rows(schemas, history, history, version_chars=50).first().description
    assert "w" * 50 in short and "w" * 51 not in short
