import pytest

from builders import database, orders, schema, users
from lakemeta.model import EDGES
from lakemeta.operators import lineage

AB = ("A@T@S@APP", "B@T@S@APP")
CD = ("C@T@S@APP", "D@T@S@APP")


@pytest.fixture
def edges(spark):
    def build(*rows):
        full = [(*r, *([None, None][len(r) - 3:] if len(r) < 5 else []), i) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, EDGES)
    return build


def kinds(df):
    return sorted(r.source_type for r in df.collect())


def test_same_edge_from_same_provider_counts_once(edges):
    assert lineage.dedup_edges(edges((*AB, "FK"), (*AB, "FK"))).count() == 1


def test_same_edge_from_two_providers_is_kept(edges):
    assert kinds(lineage.dedup_edges(edges((*AB, "FK"), (*AB, "OPERATIONAL")))) == ["FK", "OPERATIONAL"]


def test_first_seen_keeps_its_overrides(edges):
    rows = lineage.dedup_edges(edges((*AB, "FK", "X", "Y"), (*AB, "FK", "Z", "W"))).collect()
    assert [(r.source_app_pid, r.target_app_pid) for r in rows] == [("X", "Y")]


def test_payload_without_order_is_refused(edges):
    with pytest.raises(ValueError):
        lineage.dedup_edges(edges((*AB, "FK")).drop("seq"))


def test_highest_weight_wins(edges):
    assert kinds(lineage.winner_edges(edges((*AB, "MANUAL"), (*AB, "FK")))) == ["FK"]


def test_weight_override(edges):
    assert kinds(lineage.winner_edges(edges((*AB, "FK"), (*AB, "MANUAL")), {"MANUAL": 200})) == ["MANUAL"]


def test_equal_weights_go_alphabetically(edges):
    both = edges((*AB, "SQL_PARSER"), (*AB, "ETL"))
    assert kinds(lineage.winner_edges(both, {"ETL": 70, "SQL_PARSER": 70})) == ["ETL"]
    key_only = both.select(*lineage.EDGE_KEY)
    assert kinds(lineage.winner_edges(key_only, {"ETL": 70, "SQL_PARSER": 70})) == ["ETL"]


def test_summary(edges):
    row = lineage.lineage_summary(edges((*AB, "FK"), (*AB, "FK"), (*CD, "OPERATIONAL"))).first()
    assert (row.total_raw, row.unique_edges, row.duplicates_removed) == (3, 2, 1)
    assert (row.fk_edges, row.operational_edges, row.etl_edges) == (1, 1, 0)


def test_summary_of_nothing(edges, spark):
    row = lineage.lineage_summary(spark.createDataFrame([], EDGES)).first()
    assert set(row.asDict().values()) == {0}


def test_cross_app(edges):
    cross = edges(("A@T@S@APP-SRC", "B@T@S@APP-TGT", "OPERATIONAL", "APP-SRC", "APP-TGT"))
    assert lineage.lineage_summary(cross).first().cross_app_edges == 1
    assert lineage.edges_by_app(cross).first().app_bucket == "__CROSS_APP__"


def test_intra_and_unknown_app(edges):
    rows = lineage.edges_by_app(edges(
        ("A@T@S@APP-DISC-PG-01", "B@T@S@APP-DISC-PG-01", "FK"), ("a@t@s@pg", "b@t@s@pg", "FK"),
        ("a@t@s@pg", "B@T@S@APP-X", "FK"))).collect()
    assert sorted(r.app_bucket for r in rows) == ["APP-DISC-PG-01", "APP-X", "__UNKNOWN__"]


def test_fk_edges_keep_case_and_connector(load_documents):
    catalog, _ = load_documents({"test-pg": database()})
    rows = lineage.fk_edges(catalog.foreign_keys).collect()
    assert [tuple(r) for r in rows] == [
        ("user_id@orders@public@test-pg", "user_id@users@public@test-pg", "FK")]


def test_fk_payload_upper_cases(load_documents, connectors):
    catalog, _ = load_documents({"test-pg": database()})
    app = "APP-DISC-TEST-PG-POSTGRESQL-01"
    rows = lineage.fk_lineage_payload(catalog.foreign_keys, connectors).collect()
    assert [tuple(r) for r in rows] == [
        (app, "FK", f"USER_ID@ORDERS@PUBLIC@{app}", f"USER_ID@USERS@PUBLIC@{app}")]


def test_mismatched_foreign_key_is_skipped(load_documents, connectors):
    bad = {"constraintName": "bad_fk", "columns": ["a", "b"], "referencedSchema": "public",
           "referencedTable": "other", "referencedColumns": ["x"]}
    blank = {**bad, "constraintName": "blank", "columns": ["a", ""], "referencedColumns": ["x", "y"]}
    catalog, _ = load_documents({"test-pg": database([schema(tables=[users(foreignKeys=[bad, blank])])])})
    assert lineage.fk_lineage_payload(catalog.foreign_keys, connectors).count() == 1
    assert lineage.fk_edges(catalog.foreign_keys).count() == 2


def test_filter_connector_is_case_sensitive_table_is_not(load_documents):
    catalog, _ = load_documents({"test-pg": database([schema(tables=[users(), orders()])])})
    edges = lineage.fk_edges(catalog.foreign_keys)
    assert lineage.filter_lineage(edges, connector="test-pg").count() == 1
    assert lineage.filter_lineage(edges, connector="TEST-PG").count() == 0
    assert lineage.filter_lineage(edges, connector="test-mssql").count() == 0
    assert lineage.filter_lineage(edges, table="ORDERS").count() == 1
    assert lineage.filter_lineage(edges, table="nonexistent").count() == 0


def test_readable_edges(edges):
    row = lineage.readable_edges(edges(("c@t@s@a@b", "bare", "FK"))).first()
    assert (row.source_column, row.source_table, row.source_schema, row.source_connector) == ("c", "t", "s", "a@b")
    assert (row.target_column, row.target_table, row.target_connector) == ("bare", "?", "?")


def test_an_unknown_kind_is_an_error_unless_weighted(spark):
    one = spark.createDataFrame([("a@APP-1", "b@APP-1", "GUESS")], "source_element_pid STRING, target_element_pid STRING, source_type STRING")
    for plan in (lineage.winner_edges(one), lineage.lineage_summary(one)):
        with pytest.raises(Exception, match="unknown edge kind: GUESS"):
            plan.collect()
    assert [r.source_type for r in lineage.winner_edges(one, {"GUESS": 1}).collect()] == ["GUESS"]
