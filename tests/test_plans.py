"""Physical plans: what must, and must not, be in them."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lakemeta.operators import catalog, lineage
from lakemeta.operators.limits import cap_per_group

QUERIES = queries()


@pytest.fixture
def plan(capsys):
    def text(df):
        df.explain("formatted")
        return capsys.readouterr().out
    return text


LAZY = ["dedup_edges", "winner_edges", "winner_edges_first_seen", "lineage_summary", "edges_by_app", "lineage_page",
        "orders_diff_status", "diff_columns", "element_payloads", "upsert_results", "upsert_store", "upsert_lineage",
        "latest_runs", "latest_snapshot", "resolved_schemas", "fk_orphans", "dtype_mapping", "redacted_logs"]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_and_no_python(name, plan, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert forbidden not in text


@pytest.mark.parametrize("name", ["dedup_edges", "winner_edges", "winner_edges_first_seen", "lineage_summary",
                                  "latest_runs", "latest_snapshot", "repeated_upsert_results"])
def test_groups_reduce_before_the_shuffle_not_in_a_window(name, plan, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Window" not in text and ("partial_" in text or "HashAggregate" in text)


def test_winner_is_a_hash_aggregate_with_one_shuffle(plan, spark, sf_dir):
    edges = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderstatus").alias("source_element_pid"), F.col("o_orderpriority").alias("target_element_pid"),
        F.lit("FK").alias("source_type"))
    text = plan(lineage.winner_edges(edges))
    assert "SortAggregate" not in text and text.count(") Exchange\n") == 1
    text = plan(lineage.lineage_summary(edges))
    assert "SortAggregate" not in text and text.count("hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(plan, spark, tmp_path):
    path = str(tmp_path / "columns")
    spark.createDataFrame([("c", "s", "t", "n", "int", "int", "x")],
                          "connector_id STRING, schema_name STRING, table_name STRING, column_name STRING, "
                          "data_type STRING, full_data_type STRING, column_comment STRING").write.parquet(path)
    text = plan(catalog.search_columns(spark.read.parquet(path), "n", "c"))
    assert "EqualTo(connector_id,c)" in text and "column_comment" not in text


def test_pages_and_retention_are_top_k(plan, spark, sf_dir):
    for name in ("lineage_page", "retained_snapshots", "recent_runs"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_small_caps_trim_groups_before_the_shuffle(plan, spark):
    text = plan(cap_per_group(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], ["id"], 10))
    assert "WindowGroupLimit" in text
