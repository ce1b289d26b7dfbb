"""Connected components of links, by alternating star contraction over written tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rebuff.llm.common import materialize


def _ordered(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or smaller-or-equal) neighbours to the least node it knows. Only counts
    and minima are grouped; a hot node meets its neighbours in a join, which Spark may split."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    j = both.join(least, both["a"] == least["n"])
    if large:
        return _ordered(j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    return _ordered(j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without links are not listed."""
    e = materialize(_ordered(edges), "edges")
    seen = None
    while True:
        e = materialize(_star(_star(e, True), False), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
