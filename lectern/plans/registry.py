"""Registered queries: each has a Spark form and, where SQL can express it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("relational", "ranking", "quiz", "text", "cleaning", "documents", "retrieval", "lessons", "mutation", "lifecycle", "streams")


class Tables:
    """t.users is the table or view users of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    """Register f(t: Tables) under a name, with its DuckDB twin."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return put


def load() -> None:
    for m in MODULES:
        import_module(f"lectern.plans.{m}")


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["v7_retrieve_context"](spark, sf_dir)
