"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.adapters import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name; ``views`` are prepended to the SQL as CTEs."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql, views)
        return fn

    return register


def with_views(sql: str, views: tuple[str, ...]) -> str:
    if not views:
        return sql
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views)
    head = sql.lstrip()
    return f"WITH {ctes}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {ctes} {head}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
