"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Derived:
    """Rows made from a driver table by expressions that both engines read alike."""

    def __init__(self, name: str, columns: dict[str, str], where: str = "true"):
        self.name, self.columns, self.where = name, columns, where

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.name).where(self.where).selectExpr(*[f"{e} AS `{c}`" for c, e in self.columns.items()])

    def sql(self) -> str:
        return f"SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.name} WHERE {self.where}"
