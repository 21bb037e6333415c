"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lakemeta.plans import catalog as plans
from lakemeta.plans.workloads import TABLES

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_query_here_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    assert {r.source_type: r.winning_edges for r in entry(spark).collect()}.keys() == {
        "FK", "OPERATIONAL", "ETL", "MANUAL", "SQL_PARSER"}
