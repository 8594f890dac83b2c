"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seclog.plans.fixture_sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None, steps: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query; ``check`` is SQL that may use the steps of ``fixture_sql`` and those of ``steps``."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if check is not None:
            ORACLES[name] = sql(check, steps)
        return build

    return register


def load_all() -> None:
    from seclog.plans import (  # noqa: F401
        queries_detect,
        queries_history,
        queries_lines,
        queries_parse,
        queries_report,
        queries_stream,
    )
