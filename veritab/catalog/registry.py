"""Where query functions and their DuckDB counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab import fixtures
from veritab.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Lazy access to given and derived tables: ``t.claims`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, name, self._known)

    def share(self, name: str) -> None:
        """Have a table that this query reads many times written once."""
        fixtures.share(self.spark, self.sf_dir, name, self._known)


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``; ``sql`` may name derived tables in braces."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = fixtures.oracle(sql)
        return fn

    return register
