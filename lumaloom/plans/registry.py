"""The named queries and their SQL; query modules register here when imported."""

from __future__ import annotations

from . import catalog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register ``fn(spark, sf_dir)``.  ``sql`` may use the catalog's views (asset, file, ...)."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = catalog.with_views(sql) if views else sql
        return fn

    return add


from . import (  # noqa: E402, F401
    aggregate_queries,
    browse_queries,
    function_queries,
    group_queries,
    join_queries,
    plan_queries,
    search_queries,
    snapshot_queries,
)
