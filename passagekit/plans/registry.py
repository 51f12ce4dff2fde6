"""Queries by name, each with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagekit.fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Views and tables of a data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, *views: str):
    """Registers a function of `Tables`. ``sql`` may use ``views``; it goes on from their
    WITH clause, so it begins with further ones (``, name AS (...)``) or with SELECT."""

    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"{duck(*views)}\n{sql}" if views else sql
        return f

    return register
