"""Credential masking over text columns; every rule is a built-in regex replace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemeta.functions import fixed_values as fx


def _mask_key(text: Column, key: str) -> Column:
    """Masks ``key=value`` / ``key: value``; a value ends at white space.

    What replaces a match depends on the match: an ``@`` makes it a URL password, a ``=`` decides the
    separator. So the matches are taken out, masked one by one, and put between what lay around them.
    """
    pattern = rf"(?i){key}[=:]\s*\S+"

    def masked(match: Column) -> Column:
        separator = F.when(match.contains("="), F.lit("=")).otherwise(F.lit(":"))
        return F.when(match.contains("@"), F.lit(f":{fx.MASK}@")).otherwise(
            F.concat(F.regexp_extract(match, "^[^=:]*", 0), separator, F.lit(fx.MASK)))

    masks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), masked)
    around = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(around, F.concat(masks, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def redact_credentials(df: DataFrame, column: str, bearer_first: bool = True) -> DataFrame:
    """Masks credentials in free text.

    ``bearer_first`` masks bearer tokens before the key rules. Without it, ``Authorization: Bearer
    x`` keeps ``x``: the key rule takes the word ``Bearer`` for the value. Both orders agree on all
    other text.

    One combined test finds the texts that hold any key at all; only those go through the rules, each
    its own projection behind a test for its key. A text without any key is scanned once.
    """
    bearer = [(r"(?i)bearer\s", lambda c: F.regexp_replace(c, fx.BEARER_PATTERN, f"Bearer {fx.MASK}"))]
    keys = [(f"(?i){key}[=:]", lambda c, key=key: _mask_key(c, key)) for key in fx.SECRET_KEYS]
    url = [(fx.URL_PASSWORD_PATTERN, lambda c: F.regexp_replace(c, fx.URL_PASSWORD_PATTERN, f":{fx.MASK}@"))]
    anything = "|".join(["bearer\\s", f"(?:{'|'.join(fx.SECRET_KEYS)})[=:]", fx.URL_PASSWORD_PATTERN])
    df = df.withColumn("_suspect", F.col(column).rlike(f"(?i){anything}"))
    for pattern, rule in (bearer + keys if bearer_first else keys + bearer) + url:
        text = F.col(column)
        df = df.withColumn(column, F.when(F.col("_suspect") & text.rlike(pattern), rule(text)).otherwise(text))
    return df.drop("_suspect")


def redact_http_body(df: DataFrame, column: str) -> DataFrame:
    masked = reduce(lambda c, rule: F.regexp_replace(c, *rule), fx.HTTP_BODY_MASKS, F.col(column))
    return df.withColumn(column, masked)


def redact_service_error(df: DataFrame, column: str) -> DataFrame:
    masked = reduce(lambda c, rule: F.regexp_replace(c, *rule), fx.SERVICE_ERROR_MASKS, F.col(column))
    return df.withColumn(column, F.coalesce(masked, F.lit(fx.MISSING_ERROR)))


def mask_column(df: DataFrame, column: str) -> DataFrame:
    present = F.coalesce(F.col(column) != "", F.lit(False))
    return df.withColumn(column, F.when(present, F.lit(fx.COLUMN_MASK)).otherwise(F.lit("")))
