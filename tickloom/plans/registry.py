"""Where operator modules register their queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def settled(x: Column, places: int) -> Column:
    """``x`` rounded by way of a decimal of twelve places, so that a half in the last place goes up whatever the last bit of the double."""
    return F.round(x.cast("double").try_cast("decimal(38,12)"), places).cast("double")


def settled_sql(x: str, places: int) -> str:
    """The same for DuckDB."""
    return f"CAST(round(TRY_CAST(CAST({x} AS DOUBLE) AS DECIMAL(38,12)), {places}) AS DOUBLE)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
