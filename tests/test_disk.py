"""What queries over catalogs move and leave on disk, on rows made here."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lakemeta.model import COLUMN_KEY, TABLE_KEY
from lakemeta.operators import diff, payload
from lakemeta.plans.inputs import workload_catalog
from lakemeta.plans.workloads import load
from lakemeta.session import dealt, materialize, settings

QUERIES = queries()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with a lineitem of 4,000 rows, some twice, some without a part or supplier, and its suppliers."""
    folder = str(tmp_path_factory.mktemp("lines"))
    ids = spark.range(4000).withColumn("id", F.col("id") % 3900)
    part, supplier = F.pmod(F.xxhash64("id"), F.lit(180)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))
    ids.select(F.when(F.col("id") % 97 > 0, part).alias("l_partkey"), F.when(F.col("id") % 89 > 0, supplier).alias("l_suppkey"),
               (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return folder


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def shuffle_files(spark, most=0):
    """How many there are, after a while for those that go."""
    def there():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))
    until = time.time() + 10
    while (now := there()) > most and time.time() < until:
        time.sleep(0.1)
    return now


def test_a_tables_rows_travel_once(spark, lines):
    """Names, DISTINCT and keys are made where the rows of a table lie; the sides of a diff meet there."""
    assert exchanges(workload_catalog(spark, lines, "old").primary_keys) == 1
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        sides = [load(spark, lines, f"catalog_columns_{side}") for side in ("old", "new")]
        assert exchanges(diff.diff_columns(*sides)) == 2


def test_steps_leave_no_shuffle_files(spark, lines):
    before = shuffle_files(spark)
    counted = materialize(load(spark, lines, "catalog_columns_all").groupBy("column_name").count(), "counted")
    assert shuffle_files(spark, before) <= before
    assert counted.count() == 17


def test_staying_rows_join_as_dealt_ones(spark):
    """Null keys meet nobody, repeated ones meet each other, dealt or not."""
    side = lambda n: spark.createDataFrame(
        [("c", "s", f"t{i % 3}" if i % 5 else None, f"f{i % 4}", n * i % 7) for i in range(40)], [*COLUMN_KEY, "v"])
    old, new = side(1), side(2)
    expected = diff.diff_status(old, new, COLUMN_KEY, ["v"])
    found = materialize(diff.diff_status(dealt(old, *TABLE_KEY), dealt(new, *TABLE_KEY), COLUMN_KEY, ["v"]), "status", stay=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


# One at a time, each leaves behind what it returns and no shuffles of its steps.
@pytest.mark.parametrize("name", ["diff_tables", "diff_constraints", "diff_schemas", "diff_summary", "delta_ops", "soft_deletes"])
def test_queries_leave_no_shuffle_files(name, spark, lines):
    before = shuffle_files(spark)
    QUERIES[name](spark, lines)
    assert shuffle_files(spark, before) <= before


def test_a_sheet_leaves_no_shuffle_files(spark, lines):
    before = shuffle_files(spark)
    QUERIES["column_sheet"](spark, lines).write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark, before) <= before


@pytest.mark.parametrize("name, most", [("nested_tables", 11), ("container_payload_sizes", 16)])
def test_nesting_deals_narrow_rows_once(name, most, spark, lines):
    assert exchanges(QUERIES[name](spark, lines)) <= most


def test_a_type_of_every_connector_is_sent(spark, lines):
    """Rows are not dealt by their few connectors, however low Spark's limit is."""
    connectors = load(spark, lines, "connectors")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        named = payload.entity_rows(load(spark, lines, "catalog_tables_all"), connectors)
        assert exchanges(named) == 1 and "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()
