"""Stable identifiers (``COLUMN@TABLE@SCHEMA@APP``) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakemeta.functions import fixed_values as fx


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def app_pid(connector_id: Column | str, database_type: Column | str) -> Column:
    alias = F.regexp_replace(F.upper(F.coalesce(_col(connector_id), F.lit(""))), "[^A-Z0-9]", "-")
    return F.concat(F.lit("APP-DISC-"), alias, F.lit("-"),
                    F.coalesce(_col(database_type), F.lit("UNKNOWN")), F.lit("-01"))


def child_pid(name: Column | str, parent: Column | str) -> Column:
    """Container, entity and element identifiers share one rule: upper-cased name @ parent."""
    return F.concat(F.upper(F.coalesce(_col(name), F.lit(""))), F.lit("@"), _col(parent))


container_pid = child_pid
entity_pid = child_pid
element_pid = child_pid


def table_pid(app: Column | str) -> Column:
    return entity_pid("table_name", container_pid("schema_name", app))


def column_pid(app: Column | str) -> Column:
    return element_pid("column_name", table_pid(app))


def extract_app_pid(pid: Column | str) -> Column:
    """Right-most ``@`` segment starting ``APP-``; null when there is none.

    The last segment answers nearly every row; the regex only runs for the rest. Both stay inside
    whole-stage codegen, unlike a higher-order filter over ``split``.
    """
    pid = _col(pid)
    last = F.substring_index(pid, "@", -1)
    found = F.regexp_extract(pid, r"^(?s:.*@)?(APP-[^@]*)", 1)
    return F.when(last.startswith("APP-"), last).otherwise(F.nullif(found, F.lit("")))


def effective_app(override: Column | None, pid: Column | str) -> Column:
    extracted = extract_app_pid(pid)
    return extracted if override is None else F.coalesce(override, extracted)


def is_cross_app(source_app: Column, target_app: Column) -> Column:
    return F.coalesce(
        (source_app != "") & (target_app != "") & (source_app != target_app), F.lit(False))


def app_bucket(source_app: Column, target_app: Column) -> Column:
    return F.when(is_cross_app(source_app, target_app), F.lit(fx.CROSS_APP)).otherwise(
        F.coalesce(source_app, target_app, F.lit(fx.UNKNOWN_APP)))


def parse_pid(pid: Column | str) -> dict[str, Column]:
    """Display parts of a PID; short identifiers show as a bare column with unknown parents."""
    pid = _col(pid)
    parts = F.split(pid, "@")
    full = F.size(parts) >= 4
    unknown = F.lit("?")
    part = lambda i: F.when(full, F.get(parts, F.lit(i))).otherwise(unknown)
    rest = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "@")
    return {
        "column": F.when(full, F.get(parts, F.lit(0))).otherwise(
            F.coalesce(F.nullif(pid, F.lit("")), unknown)),
        "table": part(1),
        "schema": part(2),
        "connector": F.when(full, rest).otherwise(unknown),
    }
