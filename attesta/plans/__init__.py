"""Registered queries over the driver's tables, one module per operator family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run a statement shared with the oracle; `{name}` stands for a table."""
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)
    covers: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, covers: str, sql: str | None = None):
        """Register a query function taking `Tables`; `covers` lists operator ids."""

        def wrap(fn: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            self.covers[name] = covers
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return wrap


REGISTRY = Registry()
query = REGISTRY.query


def duck(text: str) -> str:
    """Turn a shared statement into DuckDB form (table names are registered views)."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text
