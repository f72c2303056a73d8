"""The catalogue that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The provided tables of one folder; each is read with its needed columns only."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register ``build(tables)`` as ``name``, with the DuckDB statement of what it returns."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return build

    return register
