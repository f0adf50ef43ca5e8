"""Query registry and the SQL snippets the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale folder: ``t.orders``, ``t.events``, …"""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def sql_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def sql_cpf(x: str) -> str:
    d = sql_digits(x)
    return f"CASE WHEN length({d}) < 11 THEN lpad({d}, 11, '0') ELSE {d} END"


def sql_br(x: str, places: int = 2) -> str:
    """Brazilian text of a number: 1.234,56."""
    return f"translate(format('{{:,.{places}f}}', {x}), ',.', '.,')"
