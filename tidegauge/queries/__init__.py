"""Registered queries: each takes (spark, folder of the tables) and gives a DataFrame; SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL if it has one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return register

    def __iadd__(self, other: Registry) -> Registry:
        if twice := self.queries.keys() & other.queries.keys():
            raise ValueError(f"two queries named {sorted(twice)}")
        self.queries |= other.queries
        self.sql |= other.sql
        return self


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
