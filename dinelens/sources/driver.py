"""Lazy access to the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class BaseTables:
    """``t.table("lineitem")`` reads ``<root>/lineitem.parquet`` once per
    instance. Reads are lazy: only the columns and rows a plan needs reach
    the scan (Catalyst prunes columns and pushes filters into Parquet)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)
