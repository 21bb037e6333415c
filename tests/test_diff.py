import pytest
from pyspark.sql import functions as F

from builders import PLAIN, active_users, column, database, orders, schema, users
from lakemeta.operators import diff
from lakemeta.operators.payload import delta_ops, delta_result, soft_delete_rows, with_outcomes


@pytest.fixture
def compare(load_documents):
    def run(old, new):
        before, _ = load_documents({"test-pg": old} if old else {"other": database([])}, "old")
        after, _ = load_documents({"test-pg": new}, "new")
        return diff.catalog_diff(before, after), before, after
    return run


def summary(d):
    return d.summary.first().asDict()


def statuses(df, name):
    return {r[name]: r.status for r in df.collect()}


def test_identical_catalogs(compare):
    d, *_ = compare(database(), database())
    row = summary(d)
    assert row["has_changes"] is False and sum(row[c] for c in diff.COUNTERS) == 0
    assert set(statuses(d.schemas, "schema_name").values()) == {"unchanged"}
    assert diff.change_report(d).count() == 0


def test_table_added_and_dropped(compare):
    extra = users(tableName="new_table", columns=[column()], indexes=[], primaryKey=None)
    d, *_ = compare(database(), database([schema(tables=[users(), extra])]))
    row = summary(d)
    assert (row["tables_added"], row["tables_dropped"], row["fk_changes"]) == (1, 1, 1)
    assert statuses(d.tables, "table_name") == {
        "users": "unchanged", "orders": "dropped", "new_table": "added", "active_users": "unchanged"}


def test_column_added(compare):
    phone = column("phone", 4, "varchar", "varchar(20)", True, **PLAIN)
    changed = users()
    changed["columns"] = [*changed["columns"], phone]
    d, *_ = compare(database(), database([schema(tables=[changed, orders()])]))
    assert summary(d)["columns_added"] == 1
    assert statuses(d.tables, "table_name")["users"] == "modified"
    assert statuses(d.columns, "column_name") == {"phone": "added"}


def wider_email():
    changed = users()
    changed["columns"][1]["fullDataType"] = "varchar(500)"
    return database([schema(tables=[changed, orders()])])


def test_column_type_change(compare):
    d, *_ = compare(database(), wider_email())
    assert summary(d)["columns_modified"] == 1
    change = diff.field_changes(d.columns).first()
    assert (change.field, change.old_value, change.new_value) == (
        "full_data_type", "varchar(255)", "varchar(500)")
    assert {r.line for r in diff.change_report(d).collect()} == {
        "~ SCHEMA public", "~ TABLE users", "~ email (full_data_type: varchar(255) → varchar(500))"}


def test_schema_added_and_dropped(compare):
    d, *_ = compare(database([schema(), schema("old_schema", [users()], [])]),
                    database([schema(), schema("analytics", [users()], [])]))
    assert statuses(d.schemas, "schema_name") == {
        "public": "unchanged", "old_schema": "dropped", "analytics": "added"}


def test_empty_schema_has_a_status_but_no_changes(compare):
    d, *_ = compare(database(), database([schema(), schema("empty", [], [])]))
    assert statuses(d.schemas, "schema_name")["empty"] == "added"
    assert summary(d)["has_changes"] is False


def test_first_run_adds_everything(load_documents):
    catalog, _ = load_documents({"test-pg": database()})
    row = summary(diff.all_added(catalog))
    assert (row["tables_added"], row["columns_added"], row["pk_changes"], row["fk_changes"],
            row["index_changes"], row["has_changes"]) == (3, 9, 2, 1, 1, True)


def test_what_a_diff_does_not_see(compare):
    """Comments, row counts, table type, key order, key names and re-paired foreign keys."""
    fk = {"constraintName": "f", "columns": ["a", "b"], "referencedSchema": "s", "referencedTable": "t",
          "referencedColumns": ["x", "y"]}
    old = users(foreignKeys=[fk], primaryKey={"constraintName": "p", "columns": ["user_id", "email"]})
    new = users(tableType="VIEW", tableComment="c", estimatedRowCount=7,
                foreignKeys=[{**fk, "referencedColumns": ["y", "x"]}],
                primaryKey={"constraintName": "q", "columns": ["email", "user_id"]})
    d, *_ = compare(database([schema(tables=[old])]), database([schema(tables=[], views=[new, active_users()])]))
    assert summary(d)["has_changes"] is False


def test_constraint_changes(compare):
    new = users(primaryKey={"constraintName": "users_pkey", "columns": ["email"]},
                indexes=[{"indexName": "idx_users_email", "columns": ["email"], "isUnique": False}])
    d, *_ = compare(database(), database([schema(tables=[new, orders(foreignKeys=[])])]))
    assert {(r.kind, r.name, r.change_type) for r in d.constraints.collect()} == {
        ("PK", None, "modified"), ("INDEX", "idx_users_email", "modified"),
        ("FK", "orders_user_id_fkey", "dropped")}


def test_empty_text_equals_null(compare):
    old, new = users(), users()
    old["columns"][1]["columnComment"] = ""
    d, *_ = compare(database([schema(tables=[old])]), database([schema(tables=[new])]))
    assert summary(d)["has_changes"] is False


def test_delta_of_a_key_change_is_one_table_update(compare, connectors):
    d, *_ = compare(database(), database([schema(tables=[users(), orders(foreignKeys=[])])]))
    ops = [(r.operation, r.entity_type, r["name"]) for r in delta_ops(d, connectors).collect()]
    assert ops == [("update", "table", "orders")]


def test_delta_and_soft_deletes(compare, connectors):
    shorter = users()
    shorter["columns"] = shorter["columns"][:2]
    d, old, new = compare(database(), database([schema(tables=[shorter], views=[active_users()])]))
    row = delta_result(delta_ops(d, connectors)).first()
    assert (row.created, row.updated, row.deleted, row.skipped) == (0, 0, 6, 0)
    dead = {r.pid.split("@")[0]: (r.kind, r.description, r.position)
            for r in soft_delete_rows(d, old, new, connectors).collect()}
    assert dead["NAME"] == ("element", "DROPPED", 0)
    assert dead["TOTAL"] == ("element", "", 3)
    assert dead["ORDERS"] == ("entity", "", None)


def test_rename_of_case_keeps_the_pid_active(compare, connectors):
    renamed = users()
    renamed["columns"][1]["columnName"] = "EMAIL"
    d, old, new = compare(database(), database([schema(tables=[renamed, orders()])]))
    assert summary(d)["columns_added"] == summary(d)["columns_dropped"] == 1
    assert soft_delete_rows(d, old, new, connectors).count() == 0


# --- keyed tables ----------------------------------------------------------------------------

def test_snapshot_diff_on_any_table(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (4, None, 4.0)],
                                "k INT, t STRING, x DOUBLE")
    new = spark.createDataFrame([(2, "b", 2.0), (3, "c", 3.0), (4, "", 4.0), (5, "e", 5.0)],
                                "k INT, t STRING, x DOUBLE")
    d = diff.snapshot_diff(old, new, ["k"], ["t", "x"])
    assert statuses(d, "k") == {1: "dropped", 2: "modified", 3: "unchanged", 4: "unchanged", 5: "added"}
    assert [tuple(r) for r in diff.field_changes(d).collect()] == [(2, "x", None, "2.0")]
    assert diff.status_counts(d).first().asDict() == {"added": 1, "dropped": 1, "modified": 1, "unchanged": 2}


def test_last_row_of_a_repeated_key_wins(spark):
    old = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.col("id").alias("v"))
    new = spark.createDataFrame([(1, 0, 299)], "k INT, pos BIGINT, v BIGINT")
    assert statuses(diff.diff_status(old, new, ["k"], ["v"], order="pos"), "k") == {1: "unchanged"}


def test_types_that_differ_compare_as_text(spark):
    old = spark.createDataFrame([(1, "5")], "k INT, v STRING")
    new = spark.createDataFrame([(1, 5)], "k INT, v INT")
    assert statuses(diff.diff_status(old, new, ["k"], ["v"]), "k") == {1: "unchanged"}


def test_the_last_of_repeated_names_counts(spark):
    side = lambda *types: spark.createDataFrame(
        [("c", "s", "t", "x", i, t) for i, t in enumerate(types)],
        "connector_id STRING, schema_name STRING, table_name STRING, column_name STRING, ordinal_position INT, full_data_type STRING")
    rows = diff.diff_columns(side("int", "text"), side("date", "text"), ["full_data_type"]).collect()
    assert [r.status for r in rows] == ["unchanged"]


def test_digests_find_what_a_full_join_finds(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None, i / 4 if i % 3 else None) for i in range(3000)]
    old = spark.createDataFrame(rows, "k INT, t STRING, x DOUBLE")
    touched = {5: (5, "", 1.25), 6: (6, None, None), 7: (7, "t0", None), 8: (8, "t1", -0.0), 9: None}
    new = spark.createDataFrame([r for r in (touched.get(r[0], r) for r in rows) if r] + [(9000, "z", 1.0), (None, "n", 0.0)],
                                "k BIGINT, t STRING, x DOUBLE")
    want = sorted(map(repr, diff.snapshot_diff(old.withColumn("k", old.k.cast("bigint")), new, ["k"], ["t", "x"]).collect()))
    for levels in ((1024, 64), (4,), (1, 1)):
        assert sorted(map(repr, diff.digest_diff(old, new, ["k"], ["t", "x"], levels=levels).collect())) == want
    changed = diff.digest_diff(old, new, ["k"], ["t", "x"], unchanged=False)
    assert sorted(map(repr, changed.collect())) == [r for r in want if "unchanged" not in r]
    swapped = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "k INT, t STRING, u STRING")
    assert diff.changed_buckets(swapped, swapped.toDF("k", "u", "t"), ["k"], ["t", "u"]).count() == 2


def test_equal_sides_shuffle_digests_only(spark, tmp_path, capsys):
    spark.range(20000).selectExpr("id AS k", "concat('v', id) AS v").write.parquet(f"{tmp_path}/t")
    side = spark.read.parquet(f"{tmp_path}/t")
    one = side.withColumn("v", F.when(F.col("k") == 77, "new").otherwise(F.col("v")))
    assert diff.changed_buckets(side, side, ["k"], ["v"]).count() == 0
    buckets = diff.changed_buckets(side, one, ["k"], ["v"])
    assert buckets.count() == 1
    inside = diff._in_buckets(side, ["k"], buckets, 1024 * 64, "left_semi")
    assert inside.count() < 10
    diff._in_buckets(side, ["k"], buckets, 1024 * 64, "left_anti").explain("formatted")
    text = capsys.readouterr().out
    assert "hashpartitioning" not in text and "BroadcastExchange" in text
    found = diff.digest_diff(side, one, ["k"], ["v"])
    assert found.filter("status <> 'unchanged'").collect()[0].k == 77 and found.count() == 20000


def test_failed_operations_are_skipped(spark):
    ops = spark.createDataFrame([("c", "s", "create", "table", "t", "T@S@A", True, None), ("c", "s", "delete", "column", "t.x", "X@T@S@A", True, None),
                                 ("c", "s", "create", "schema", "s", "S@A", True, None)],
                                "connector_id STRING, schema_name STRING, operation STRING, entity_type STRING, name STRING, pid STRING, "
                                "success BOOLEAN, error STRING")
    results = spark.createDataFrame([("T@S@A", "late"), ("T@S@A", "gone"), ("T@S@A", None), ("X@T@S@A", None), ("other", "lost")], "pid STRING, error STRING")
    found = with_outcomes(ops, results)
    assert {r["name"]: (r.success, r.error) for r in found.collect()} == {"t": (False, "gone"), "t.x": (True, None), "s": (True, None)}
    assert tuple(delta_result(found).first()) == (1, 0, 1, 1) and found.columns == ops.columns
