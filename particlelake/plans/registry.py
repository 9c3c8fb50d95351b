"""Registry of queries with their independent SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column so results compare across engines."""
    columns: list[Column] = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), special.get(name, digits)).alias(name)
        columns.append(column)
    return df.select(*columns)


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body


def rounded_sql(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) AS {name}"
