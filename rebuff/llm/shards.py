"""K-d tree sharding: nodes are split at weighted medians along their widest metadata dimension.

A node that still has to yield k shards is cut at the fraction floor(k / 2) / k of its bytes, until every
leaf is one shard of about the target size. Each level is one range shuffle of narrow rows by (node, value,
tie-break): ranges sum their bytes, the sums' running totals give every row its exact position in its
node, and the row at which the fraction is crossed is the weighted median. No node is ever one task's.

Groups: rows with equal ``group`` stay together, unless keeping them would move a cut by more than
``slack`` of a shard; then the group is split between its rows, by id. A hot group so never unbalances.

Defined cases: null metadata sorts first; equal rows are told apart by a number; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.llm.common import materialize, spread

SLACK = 0.02


def kd_shards(rows: DataFrame, dims: list[str], size: str = "size", group: str = "group", n_shards: int | None = None,
              target_bytes: int | None = None, slack: float = SLACK) -> DataFrame:
    """``rows`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard). Input columns of
    these two names are replaced; all others come back as they are, whatever their names."""
    spark = rows.sparkSession
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    named = {f"_d{i}": F.col(d).cast("double") for i, d in enumerate(dims)}
    base = materialize(rows.select(F.struct(*kept).alias("_row"), F.col(size).cast("long").alias("_size"), F.col(group).alias("_group"),
                                   *[c.alias(d) for d, c in named.items()], F.monotonically_increasing_id().alias("_n")), "rows")
    dims = list(named)
    total = base.agg(F.sum("_size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    unit = max(1, total // n_shards)
    scaled = base.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims])
    at = base.select("_n", "_size", "_group", *dims, F.lit(0).alias("_node"), F.lit(n_shards).alias("_k"))
    span = scaled.first()
    width = {d: float(span[f"hi_{d}"] or 0) - float(span[f"lo_{d}"] or 0) for d in dims}
    k = n_shards
    while k > 1:
        at = _split(at, dims, width, unit * slack, spread(spark))
        k = -(-k // 2)
    at = _positions(at.select("_n", "_size", F.col("_node"), "_group"), "_node", ["_group", "_n"], spread(spark), count=True)
    out = at.select("_n", F.col("_node").alias("shard"), F.col("_before").alias("slot"))
    return base.select("_n", "_row").join(out, "_n").select("_row.*", "shard", "slot")


def _positions(rows: DataFrame, node: str, order: list[str], parts: int, count: bool = False) -> DataFrame:
    """``_before``: the weight (or rows) before each row in its node, by ``order``; exact, without a global task."""
    weight = F.lit(1).cast("long") if count else F.col("_size")
    ranged = rows.repartitionByRange(parts, node, *order).withColumn("_p", F.spark_partition_id()).withColumn("_w", weight)
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy(node, "_p").agg(F.sum("_w").alias("_s"))
    w = Window.partitionBy(node).orderBy("_p")      # one row per range and node
    offset = sums.select(F.col(node).alias("_on"), F.col("_p").alias("_op"), (F.sum("_s").over(w) - F.col("_s")).alias("_off"))
    inner = Window.partitionBy(node, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    joined = within.join(offset, (within[node] == offset["_on"]) & (within["_p"] == offset["_op"]))
    return joined.withColumn("_before", F.col("_in") + F.col("_off")).drop("_on", "_op", "_off", "_in", "_p", "_w")


def _split(at: DataFrame, dims: list[str], width: dict[str, float], slack: float, parts: int) -> DataFrame:
    def scaled(d: str) -> Column:
        return F.coalesce((F.max(d) - F.min(d)) / F.lit(width[d] or 1.0), F.lit(0.0))
    wide = at.groupBy("_node").agg(F.array_max(F.array(*[F.struct(scaled(d).alias("w"), F.lit(-i).alias("i")) for i, d in enumerate(dims)])).alias("_x"),
                                   F.sum("_size").alias("_t")).select(F.col("_node").alias("_wn"), (-F.col("_x.i")).alias("_d"), "_t")
    value = F.coalesce(*[F.when(F.col("_d") == i, F.col(d)) for i, d in enumerate(dims)], F.lit(float("-inf")))
    rows = at.join(wide, at["_node"] == wide["_wn"]).drop("_wn").withColumn("_v", value)
    rows = materialize(_positions(rows, "_node", ["_v", "_group", "_n"], parts), "positions")
    half = F.col("_t") * F.floor(F.col("_k") / 2) / F.col("_k")
    crossing = rows.where((F.col("_before") <= half) & (half < F.col("_before") + F.col("_size"))).select(
        F.col("_node").alias("_cn"), F.col("_v").alias("_cv"), F.col("_group").alias("_cg"), F.col("_before").alias("_cb"), half.alias("_half"), F.col("_size").alias("_cs"))
    same = rows.join(crossing, (rows["_node"] == crossing["_cn"]) & (rows["_v"] == crossing["_cv"]) & rows["_group"].eqNullSafe(crossing["_cg"]))
    bounds = same.groupBy("_node").agg(F.min("_before").alias("lo"), F.max(F.col("_before") + F.col("_size")).alias("hi"),
                                       F.first("_half").alias("h"), F.first("_cb").alias("cb"), F.first("_cs").alias("cs"))
    exact = F.when(F.col("h") - F.col("cb") < F.col("cs") / 2, F.col("cb")).otherwise(F.col("cb") + F.col("cs"))
    near = F.when(F.col("h") - F.col("lo") <= F.col("hi") - F.col("h"), F.col("lo")).otherwise(F.col("hi"))
    cut = F.when(F.abs(near - F.col("h")) <= slack, near).otherwise(exact)
    cuts = bounds.select(F.col("_node").alias("_cn"), cut.alias("_cut"))
    out = rows.join(cuts, rows["_node"] == cuts["_cn"], "left")
    left = F.floor(F.col("_k") / 2).cast("int")
    below = (F.col("_k") > 1) & (F.col("_before") >= F.col("_cut"))
    return out.select("_n", "_size", "_group", *dims, F.when(below, F.col("_node") + left).otherwise(F.col("_node")).alias("_node"),
                      F.when(F.col("_k") <= 1, F.col("_k")).when(below, F.col("_k") - left).otherwise(left).alias("_k"))
