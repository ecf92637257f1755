"""Registered queries: a name, its Spark plan over a data folder, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes; only those that a plan names are opened."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in PLANS:
            raise ValueError(f"two queries are named {name}")
        PLANS[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return plan

    return register
