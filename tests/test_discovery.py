from collections import Counter

import pytest
from pyspark.sql import functions as F

from builders import database
from lakemeta.model import CONNECTORS, TABLE_KEY, RawMetadata
from lakemeta.operators import discovery, keys
from lakemeta.operators.limits import cap_per_group
from lakemeta.sources.raw_metadata import read_raw_metadata
from lakemeta.sources.snapshots import unnest_tables

KEY = ("c", "s", "t")
KEY_DDL = "connector_id STRING, schema_name STRING, table_name STRING"


def test_primary_key_order_and_repeated_position(spark):
    raw = spark.createDataFrame(
        [(*KEY, "old", 2, "b", 1), (*KEY, "old", 1, "a", 2), (*KEY, None, 2, "B", 3)],
        f"{KEY_DDL}, pk_name STRING, key_seq INT, column_name STRING, seq INT")
    row = discovery.assemble_primary_keys(raw).first()
    assert (row.constraint_name, row["columns"]) == ("PK_t", ["a", "B"])


def test_foreign_key_reference_falls_back(spark):
    raw = spark.createDataFrame(
        [(*KEY, "f", "", "cat", "p", "b", "y", 2), (*KEY, "f", None, "", "q", "a", "x", 1),
         (*KEY, None, None, None, "p", "c", "z", 3)],
        f"{KEY_DDL}, fk_name STRING, pktable_schem STRING, pktable_cat STRING, pktable_name STRING, "
        "fkcolumn_name STRING, pkcolumn_name STRING, seq INT")
    rows = {r.constraint_name: r for r in discovery.assemble_foreign_keys(raw).collect()}
    assert rows["f"]["columns"] == ["a", "b"] and rows["f"].referenced_columns == ["x", "y"]
    assert (rows["f"].referenced_schema, rows["f"].referenced_table) == ("s", "q")
    assert rows["FK_t_p"].referenced_schema == "s"


def test_indexes_skip_statistics_and_keep_expression_indexes(spark):
    raw = spark.createDataFrame(
        [(*KEY, "i", 3, False, "b", 2), (*KEY, "i", 3, False, "a", 1), (*KEY, "e", 3, True, None, 3),
         (*KEY, None, 3, True, "x", 4), (*KEY, "stat", 0, True, "x", 5)],
        f"{KEY_DDL}, index_name STRING, type INT, non_unique BOOLEAN, column_name STRING, seq INT")
    rows = {r.index_name: (r["columns"], r.is_unique) for r in discovery.assemble_indexes(raw).collect()}
    assert rows == {"i": (["a", "b"], True), "e": ([], False)}


@pytest.mark.parametrize("n", [3, 1200])
def test_cap_is_exact_under_skew(spark, n):
    """One group holds most rows; caps below and above Catalyst's own limit agree with brute force."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id") % 40).alias("g"),
        ((F.col("id") * 7919) % 6007).alias("v"))
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    expected = Counter((g, v) for g, vs in groups.items() for v in sorted(vs)[:n])
    assert Counter((r.g, r.v) for r in cap_per_group(df, ["g"], ["v"], n).collect()) == expected


def test_resolve_schemas(spark):
    connectors = spark.createDataFrame([
        ("explicit", "POSTGRESQL", "db", ["pg_catalog"]), ("my", "MYSQL", "shop", None),
        ("pg", "POSTGRESQL", "db", []), ("tera", "TERADATA", "db", None), ("bare", "ORACLE", "db", None),
        ("other", "DREMIO", None, None)], CONNECTORS)
    schemas = spark.createDataFrame([
        ("explicit", "x", None), ("my", "x", None), ("pg", "public", "DB"), ("pg", "pg_catalog", "db"),
        ("pg", "elsewhere", "db2"), ("pg", "PG_CATALOG", None), ("tera", "DBC", None), ("bare", "SYS", None),
        ("other", "sys", None)], "connector_id STRING, table_schem STRING, table_catalog STRING")
    catalogs = spark.createDataFrame(
        [("pg", "unused"), ("tera", "sales"), ("tera", "tdwm"), ("bare", "SYSTEM")],
        "connector_id STRING, table_cat STRING")
    got = Counter(tuple(r) for r in discovery.resolve_schemas(schemas, catalogs, connectors).collect())
    assert got == Counter([("explicit", "pg_catalog"), ("my", "shop"), ("pg", "public"), ("pg", "PG_CATALOG"),
                           ("tera", "sales"), ("bare", "db"), ("other", "sys")])


def raw_sets(spark):
    return RawMetadata(
        tables=spark.createDataFrame([("c", "s", "t", "TABLE", ""), ("c", "s", "v", "VIEW", "seen"),
                                      ("c", "s", "x", "SYNONYM", None), ("c", "zz", "t", "TABLE", None)],
                                     f"{KEY_DDL}, TABLE_TYPE STRING, REMARKS STRING"),
        columns=spark.createDataFrame(
            [(*KEY, "id", 1, "NUMBER", 10, 0, 0, None, None, "yes"), (*KEY, "n", 2, "VARCHAR2", 20, None, 1, "x", "", "NO")],
            f"{KEY_DDL}, COLUMN_NAME STRING, ORDINAL_POSITION INT, TYPE_NAME STRING, COLUMN_SIZE INT, "
            "DECIMAL_DIGITS INT, NULLABLE INT, COLUMN_DEF STRING, REMARKS STRING, IS_AUTOINCREMENT STRING"),
        primary_keys=spark.createDataFrame([(*KEY, "pk", 1, "id", 1)],
                                           f"{KEY_DDL}, PK_NAME STRING, KEY_SEQ INT, COLUMN_NAME STRING, SEQ INT"),
        imported_keys=spark.createDataFrame([(*KEY, None, None, None, "p", "n", "k", 1)],
                                            f"{KEY_DDL}, FK_NAME STRING, PKTABLE_SCHEM STRING, PKTABLE_CAT STRING, "
                                            "PKTABLE_NAME STRING, FKCOLUMN_NAME STRING, PKCOLUMN_NAME STRING, SEQ INT"),
        index_info=spark.createDataFrame([(*KEY, "ix", 3, False, "id", 1)],
                                         f"{KEY_DDL}, INDEX_NAME STRING, TYPE INT, NON_UNIQUE BOOLEAN, "
                                         "COLUMN_NAME STRING, SEQ INT"))


def test_raw_metadata_to_catalog(spark, tmp_path):
    for name, df in raw_sets(spark)._asdict().items():
        df.write.parquet(f"{tmp_path}/{name}")
    raw = read_raw_metadata(spark, str(tmp_path))
    schemas = spark.createDataFrame([("c", "s")], "connector_id STRING, schema_name STRING")
    cat = discovery.build_catalog(raw, schemas)
    assert {(r.table_name, r.table_type, r.table_comment) for r in cat.tables.collect()} == {
        ("t", "TABLE", None), ("v", "VIEW", "seen")}
    columns = {r.column_name: r for r in cat.columns.collect()}
    assert columns["id"].is_primary_key and columns["id"].full_data_type == "number(10)"
    assert columns["id"].is_auto_increment and not columns["id"].is_nullable
    assert (columns["n"].full_data_type, columns["n"].character_max_length) == ("varchar2(20)", 20)
    assert cat.foreign_keys.first().constraint_name == "FK_t_p"
    row = discovery.discovery_summary(cat).first()
    assert (row.schemas_found, row.tables_found, row.views_found, row.columns_found, row.foreign_keys_found,
            row.indexes_found) == (1, 1, 1, 2, 1, 1)


def test_nesting_round_trip(load_documents):
    cat, _ = load_documents({"test-pg": database()})
    back = unnest_tables(discovery.nest_tables(cat))
    for name in ("tables", "columns", "primary_keys", "foreign_keys", "indexes"):
        before, after = getattr(cat, name), getattr(back, name)
        rows = lambda df: Counter(map(str, df.select(*sorted(cat_columns)).collect()))  # noqa: B023,E731
        cat_columns = before.columns
        assert rows(before) == rows(after), name
    flat = discovery.flatten_columns(discovery.nest_tables(cat))
    assert flat.count() == 9 and set(TABLE_KEY) < set(flat.columns)


def test_declared_keys(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k INT")
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "p INT")
    tables = {"parent": parent, "child": child}
    pk = keys.check_primary_keys(tables, [keys.PrimaryKey("parent", "pk", ["k"])]).first()
    assert (pk.duplicate_keys, pk.duplicate_rows, pk.null_rows) == (1, 1, 1)
    fk = keys.check_foreign_keys(tables, [keys.ForeignKey("child", "fk", ["p"], "parent", ["k"])]).first()
    assert (fk.orphan_keys, fk.orphan_rows) == (1, 2)


def test_keys_of_any_type_in_one_scan_a_table(spark, tmp_path, capsys):
    """Composite, fractional, text and mixed keys, a table that references itself, and one without rows."""
    rows = [(1, 1, 0.0, "a", None), (2, 2, -0.0, "b", 1), (3, None, 1.5, None, 9), (3, None, None, "a,b", 9)]
    spark.createDataFrame(rows, "id INT, k BIGINT, x DOUBLE, t STRING, up INT").write.parquet(f"{tmp_path}/t")
    tables = {"t": spark.read.parquet(f"{tmp_path}/t"),
              "none": spark.createDataFrame([], "id DECIMAL(4,1)"), "pair": spark.createDataFrame([("a,b", 3)], "t STRING, id INT")}
    key = lambda name, *columns: keys.PrimaryKey("t", name, list(columns))
    found = keys.check_primary_keys(tables, [key("id", "id"), key("x", "x"), key("kt", "k", "t"), keys.PrimaryKey("none", "n", ["id"])])
    assert {r.constraint_name: tuple(r)[2:] for r in found.collect()} == {
        "id": (1, 1, 0), "x": (1, 1, 1), "kt": (0, 0, 2), "n": (0, 0, 0)}
    refers = lambda name, columns, table, others: keys.ForeignKey("t", name, columns, table, others)
    found = keys.check_foreign_keys(tables, [refers("self", ["up"], "t", ["id"]), refers("none", ["id"], "none", ["id"]),
                                             refers("pair", ["t", "id"], "pair", ["t", "id"])])
    assert {r.constraint_name: tuple(r)[2:] for r in found.collect()} == {"self": (1, 2), "none": (3, 4), "pair": (2, 2)}
    found.explain("formatted")
    assert capsys.readouterr().out.count("ReadSchema") == 1


def test_a_wide_table_nests_in_parts(load_documents):
    """No column is dropped: parts hold those of their ordinals, keys stay in the first."""
    cat, _ = load_documents({"c": database()})
    nested = discovery.nest_tables(cat, columns_per_part=2)
    assert nested.groupBy(*TABLE_KEY).count().count() == cat.tables.count() < nested.count()
    assert discovery.flatten_columns(nested).count() == cat.columns.count()
    assert nested.filter("part > 0 AND (primary_key IS NOT NULL OR size(foreign_keys) > 0)").count() == 0
    again = unnest_tables(nested)
    for name, df in cat._asdict().items():
        assert getattr(again, name).count() == df.count(), name


def test_nothing_is_capped_unless_asked(spark):
    raw = RawMetadata(
        spark.range(200).selectExpr("'c' AS connector_id", "concat('s', id) AS schema_name", "'t' AS table_name", "'TABLE' AS table_type", "'' AS remarks"),
        *[spark.createDataFrame([], ddl) for ddl in (
            "connector_id STRING, schema_name STRING, table_name STRING, column_name STRING, ordinal_position INT, type_name STRING, "
            "column_size INT, decimal_digits INT, nullable INT, column_def STRING, remarks STRING, is_autoincrement STRING",
            "connector_id STRING, schema_name STRING, table_name STRING, column_name STRING, pk_name STRING, key_seq INT, seq INT",
            "connector_id STRING, schema_name STRING, table_name STRING, fk_name STRING, pktable_schem STRING, pktable_cat STRING, "
            "pktable_name STRING, fkcolumn_name STRING, pkcolumn_name STRING, seq INT",
            "connector_id STRING, schema_name STRING, table_name STRING, index_name STRING, type INT, non_unique BOOLEAN, column_name STRING, seq INT")])
    schemas = raw.tables.select("connector_id", "schema_name")
    assert discovery.build_catalog(raw, schemas).tables.count() == 200
    assert discovery.build_catalog(raw, schemas, max_schemas=7).tables.count() == 7
