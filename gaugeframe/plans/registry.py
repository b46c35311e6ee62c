"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.plans.views import VIEW_SQL, VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def add(name: str, view: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a query over one view, with its check over the same view."""
    add_over_tables(name, lambda spark, sf_dir: run(VIEWS[view](spark, sf_dir)), sql and over_view(view, sql))


def add_over_tables(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")
    QUERIES[name] = run
    if sql:
        CHECKS[name] = sql


def over_view(view: str, sql: str) -> str:
    """SQL with the view put before it as a common table expression."""
    sql = sql.strip()
    head = f"WITH {view} AS ({VIEW_SQL[view]})"
    if sql.upper().startswith("WITH "):
        return f"{head}, {sql[5:]}"
    return f"{head}\n{sql}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all doubles: their last bits depend on the order of summation."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})
