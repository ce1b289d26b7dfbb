"""The query registry: each entry is a Spark plan over the given tables, most with an oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rebuff.functions.expressions import tidy
from rebuff.oracle.ctes import compose
from rebuff.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", ctes: dict[str, str] | None = None, digits: int = 6):
    """Register ``fn(views) -> DataFrame``. ``sql`` is the oracle's last SELECT over the shared
    views; ``doubles`` names its floating columns, rounded like Spark's."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Views(spark, sf_dir)), digits)
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql, doubles.split(), ctes or {}, digits)
        return fn
    return wrap
