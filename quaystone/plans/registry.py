"""The table of queries: name to function (spark, sf_dir) -> DataFrame, and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles to some digits, as sums of doubles depend on their order in the last place."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(columns: dict[str, str], digits: int = 6) -> str:
    """SELECT list of name: expression, rounded."""
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in columns.items())
