"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

from lakemeta.plans import registry

_MODULES = ["lineage_queries", "discovery_queries", "catalog_queries", "diff_queries",
            "payload_queries", "run_queries", "source_queries", "stream_queries"]
for _module in _MODULES:
    import_module(f"lakemeta.plans.{_module}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
