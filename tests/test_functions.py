import random
import re

import pytest
from pyspark.sql import functions as F

from lakemeta.functions import datatypes, describe, pids, redact
from lakemeta.functions import fixed_values as fx


@pytest.fixture
def apply(spark):
    """Evaluates a column expression over text values."""
    def run(values, expression):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
        return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]
    return run


# --- identifiers -----------------------------------------------------------------------------

def test_app_pid(apply):
    assert apply(["test_db.prod", "pg", None], lambda c: pids.app_pid(c, F.lit("MYSQL"))) == [
        "APP-DISC-TEST-DB-PROD-MYSQL-01", "APP-DISC-PG-MYSQL-01", "APP-DISC--MYSQL-01"]
    assert apply(["x"], lambda c: pids.app_pid(c, F.lit(None).cast("string"))) == ["APP-DISC-X-UNKNOWN-01"]


def test_child_pids(apply):
    assert apply(["orders", None], lambda c: pids.entity_pid(c, pids.container_pid(F.lit("sales"), F.lit("APP-X")))) == [
        "ORDERS@SALES@APP-X", "@SALES@APP-X"]


def test_extract_app_pid_takes_the_rightmost(apply):
    assert apply(["A@B@C@APP-1", "APP-2@x", "a@APP-1@APP-2@y", "a@b", "", "xAPP-1", "APP-", None],
                 pids.extract_app_pid) == ["APP-1", "APP-2", "APP-2", None, None, None, "APP-", None]


# --- types -----------------------------------------------------------------------------------

@pytest.mark.parametrize("native, family", [
    ("VARCHAR(45)", "DTYPE-VARCHAR"), ("smallint unsigned", "DTYPE-INTEGER"),
    ("int(10) unsigned zerofill", "DTYPE-INTEGER"), ("tinyint identity", "DTYPE-INTEGER"),
    ("int identity(1,1)", "DTYPE-INTEGER"), ("timestamp(6) with time zone", "DTYPE-TIMESTAMP"),
    ("double precision", "DTYPE-VARCHAR"), ("int32", "DTYPE-VARCHAR"),
    ("time without time zone", "DTYPE-VARCHAR"), ("Long  Raw", "DTYPE-BINARY"),
    ("numeric(10,2)", "DTYPE-NUMERIC"), ("bit", "DTYPE-BOOLEAN"), ("NCLOB", "DTYPE-TEXT"),
    ("bpchar", "DTYPE-CHAR"), ("date", "DTYPE-DATE"), ("whatever", "DTYPE-VARCHAR")])
def test_logical_type(apply, native, family):
    assert apply([native], datatypes.map_data_type) == [family]


def test_every_listed_type_maps_to_its_family(apply):
    pairs = [(n, f) for f, names in fx.TYPE_FAMILIES.items() for n in names]
    assert len(pairs) == 78
    assert apply([n for n, _ in pairs], datatypes.map_data_type) == [f for _, f in pairs]


def test_modifiers_can_be_extended(apply):
    assert apply(["int compressed"], datatypes.map_data_type) == ["DTYPE-VARCHAR"]
    more = [*fx.TYPE_MODIFIERS, "compressed"]
    assert apply(["int compressed"], lambda c: datatypes.map_data_type(c, more)) == ["DTYPE-INTEGER"]


def test_pii(apply):
    marked = ["customer_email_2", "home_phone", "Passport_No", "invoice_total", "shipped_on", "", None]
    assert apply(marked, datatypes.pii_indicator) == ["Y", "Y", "Y", "N", "N", "N", "N"]


def test_full_type(apply):
    full = lambda size, digits: lambda c: datatypes.full_data_type(c, F.lit(size), F.lit(digits))
    assert apply(["VARCHAR", "NUMERIC", "int4", None], full(10, 2)) == ["varchar(10)", "numeric(10,2)", "int4", "unknown"]
    assert apply(["NUMBER", "CLOB"], full(10, 0)) == ["number(10)", "clob(10)"]
    assert apply(["NUMBER", "CLOB"], full(0, None)) == ["number", "clob"]


def test_iceberg_types(apply):
    texts = ["decimal(15, 2)", "fixed[16]", "Long", '{"type":"list"}', '{"fields":[]}', "decimal(3)"]
    parts = {k: apply(texts, lambda c, k=k: datatypes.parse_iceberg_type(c)[k]) for k in
             ("data_type", "full_data_type", "character_max_length", "numeric_precision", "numeric_scale")}
    assert parts["data_type"] == ["decimal", "fixed", "long", "list", "struct", "decimal(3)"]
    assert parts["full_data_type"] == texts
    assert parts["character_max_length"] == [None, 16, None, None, None, None]
    assert parts["numeric_precision"] == [15, None, None, None, None, None]
    assert parts["numeric_scale"] == [2, None, None, None, None, None]


# --- descriptions ----------------------------------------------------------------------------

def test_format_bytes(apply):
    sizes = ["0", "1023", "1024", "1280", "1048576", "1610612736", None]
    assert apply(sizes, lambda c: describe.format_bytes(c.cast("bigint"))) == [
        "0 B", "1023 B", "1.0 KB", "1.3 KB", "1.0 MB", "1.5 GB", None]


def test_entity_description(apply):
    text = lambda c: describe.entity_description(
        F.lit("TABLE"), c.cast("bigint"), F.lit(2048), F.lit(""))
    assert apply(["50000", None], text) == ["TABLE ~50,000 rows 2.0 KB", "TABLE 2.0 KB"]


def test_element_description_puts_fk_after_the_comment(apply):
    text = lambda c: describe.element_description(
        c, F.lit(False), F.lit(True), F.lit(True), F.lit("note"), F.lit(True))
    assert apply(["int4"], text) == ["int4 NOT NULL PK AUTO_INCREMENT note FK"]


# --- redaction -------------------------------------------------------------------------------

@pytest.fixture
def masked(spark):
    def run(texts, **options):
        df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
        rows = redact.redact_credentials(df, "t", **options).orderBy("i").collect()
        return [r.t for r in rows]
    return run


@pytest.mark.parametrize("text, safe", [
    ("nothing to hide here", "nothing to hide here"),
    ("loader: Token=t0p then more", "loader: Token=***** then more"),
    ("retry with secret:  s1\tlater", "retry with secret:*****\tlater"),
    ("api_key: k=v tail", "api_key=***** tail"),
    ("login svc:hunter2@db.internal/x", "login svc:*****@db.internal/x"),
    ("pwd=abc@host rest", ":*****@ rest"),
    ("token=a token=b", "token=***** token=*****"),
    ("token=atoken: b c@d", "token=***** b c@d"),
    ("password=abc\ue002def \ue000x\ue001", "password=***** \ue000x\ue001"),
    ("password=", "password="), ("", ""), (None, None)])
def test_redaction_pairs(masked, text, safe):
    assert masked([text]) == [safe]


def test_bearer_tokens_never_survive(masked):
    text = ["Authorization: Bearer abc.def"]
    assert "abc" not in masked(text)[0]
    assert masked(text, bearer_first=False) == ["Authorization:***** abc.def"]


def test_no_secret_survives_and_clean_words_stay(masked):
    """Random logs of clean words and secrets: every secret is gone, every clean word is still there, in order."""
    rng = random.Random(7)
    texts, clean = [], []
    for i in range(1500):
        words, kept = [], []
        for j in range(rng.randint(1, 8)):
            secret = f"zz{i}q{j}\ue002x"
            kind = rng.choice(["clean", "clean", "key", "bearer", "url"])
            if kind == "clean":
                kept.append(f"w{i}x{j}")
                words.append(kept[-1])
            elif kind == "key":
                words.append(rng.choice(["password", "PWD", "Secret", "token", "api-key", "ApiKey", "authorization"])
                             + rng.choice(["=", ":", ": ", "=  "]) + secret)
            elif kind == "bearer":
                words.append("bearer " + f"zz{i}q{j}")
            else:
                words.append(f"db://u:{secret}@host")
        texts.append(" ".join(words))
        clean.append(kept)
    for options in ({}, {"bearer_first": False}):
        for text, kept in zip(masked(texts, **options), clean, strict=True):
            assert "zz" not in text
            assert [w for w in text.split() if re.fullmatch(r"w\d+x\d+", w)] == kept


def test_masks_as_many_as_secrets(masked):
    for n in range(1, 5):
        assert masked([" ".join(f"token=t{i}" for i in range(n))])[0].count(fx.MASK) == n


def test_http_and_service_dialects(spark):
    df = spark.createDataFrame([('{"api_key": "k1", x} Bearer t1 cookie=c1',), (None,)], "m STRING")
    http = redact.redact_http_body(df, "m").first().m
    assert "k1" not in http and "t1" not in http and "c1" not in http
    rows = redact.redact_service_error(
        spark.createDataFrame([("jdbc://u:pw@h PASSWORD=x pwd: y",), (None,)], "m STRING"), "m").collect()
    assert [r.m for r in rows] == ["jdbc://u:*****@h password=***** PWD=*****", "Unknown error"]


def test_mask_column(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "p STRING")
    assert [r.p for r in redact.mask_column(df, "p").collect()] == ["********", "", ""]
