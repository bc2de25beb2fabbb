"""A small collection of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """``df`` with its doubles rounded, as the SQL side does."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under ``name``; its doubles are rounded to 6 places."""

        def register(f: Query) -> Query:
            self.queries[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return f

        return register
