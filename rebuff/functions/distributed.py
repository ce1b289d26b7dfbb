"""Global order without a global task.

A window without a selective partition key, or ``percentile`` over a huge group, pulls a whole
group into one task. These helpers cut each group into ranges first, so no task ever holds more
than one range, and only a table of range totals (groups x BUCKETS rows) is broadcast. They are
meant for few groups (arms, replicates) of unbounded size.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges per group. Totals and bounds tables have groups x BUCKETS entries.
BUCKETS = 64


def _totals(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per range: rows in earlier ranges (_off) and rows of the whole group (_total)."""
    t = binned.groupBy(*by, "_k").agg(F.sum("_n").alias("_t"))
    w = Window.partitionBy(*by)
    before = w.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(*by, "_k",
                    F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
                    F.sum("_t").over(w).alias("_total"))


def range_bins(counted: DataFrame, by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Adds the range number ``_k`` of ``_v``, cut at approximate quantiles of the rows' values."""
    by = list(by)
    probs = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = counted.groupBy(*by).agg(F.percentile_approx("_v", probs, F.lit(max(1000, 16 * buckets))).alias("_b"))
    joined = counted.join(F.broadcast(bounds), by) if by else counted.crossJoin(F.broadcast(bounds))
    return joined.withColumn("_k", F.size(F.filter("_b", lambda x: x < F.col("_v")))).drop("_b")


def ranked_values(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per (group, distinct value): ``n`` copies, ``n_before`` smaller ones, ``n_total``.

    Copies are counted before anything moves, so a value that holds a third of all rows is one
    row; the distinct values are then split at approximate quantiles.
    """
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(n.cast("long").alias("_n"))
               .where(F.col("_n") > 0))
    binned = range_bins(counted, by)
    w = Window.partitionBy(*by, "_k").orderBy("_v")
    within = binned.withColumn("_cum", F.sum("_n").over(w))
    return (within.join(F.broadcast(_totals(binned, by)), [*by, "_k"])
            .select(*by, F.col("_v").alias(value), F.col("_n").alias("n"),
                    (F.col("_off") + F.col("_cum") - F.col("_n")).alias("n_before"),
                    F.col("_total").alias("n_total")))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per entry of
    ``probs``, plus the count ``n``."""
    by = list(by)
    r = ranked_values(df, value, by, weight)
    aggs = [F.max("n_total").alias("n")]
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_total") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    out = r.groupBy(*by).agg(*aggs)
    return out.select(*by, "n", *[
        (F.col(f"_lo_{k}") + F.col(f"_f_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k in probs])


def _middle() -> Column:
    return (F.col("_all") - 1) / 2


def _holds(rank: Column) -> Column:
    return (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))


def middle_ranges(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of ranges (by, _k, _n) those that hold the middle unit, or one of the middle two, of their group: (by, _k), the group's
    weight ``_all`` and the weight ``_before`` the range. A group's ranges are few."""
    each = Window.partitionBy(*by)
    t = totals.withColumns({"_upto": F.sum("_n").over(each.orderBy("_k")), "_all": F.sum("_n").over(each)})
    return (t.where(_holds(F.floor(_middle())) | _holds(F.ceil(_middle())))
            .select(*by, "_k", "_all", (F.col("_upto") - F.col("_n")).alias("_before")))


def range_medians(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, median, _at) from the distinct values (_v, _n) of the ranges of ``middle_ranges``; ``_at`` is the lower middle's range."""
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy("_v"))
    lo, hi = (F.max(F.when(_holds(x(_middle())), F.col("_v"))) for x in (F.floor, F.ceil))
    return values.withColumn("_upto", upto).groupBy(*by).agg((lo + F.max(_middle() - F.floor(_middle())) * (hi - lo)).alias("median"), F.min("_k").alias("_at"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, value) -> average rank, 1-based, ties share the mean of their positions."""
    r = ranked_values(df, value, by)
    return r.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"), "n", "n_total")


def number_units(df: DataFrame, key: str, by: Sequence[str] = (), seed: str | None = None) -> DataFrame:
    """Dense numbers ``idx`` = 0..n_units-1 per group, in the order (md5 of the key, key). Each task
    numbers one of 256 hash slices; only the slice totals are broadcast."""
    by = list(by)
    text = F.col(key).cast("string")
    h = F.md5(text if seed is None else F.concat_ws(":", F.lit(str(seed)), text))
    binned = df.withColumn("_h", h).withColumn("_k", F.substring("_h", 1, 2)).withColumn("_n", F.lit(1))
    w = Window.partitionBy(*by, "_k").orderBy("_h", key)
    return (binned.withColumn("_r", F.row_number().over(w))
            .join(F.broadcast(_totals(binned, by)), [*by, "_k"])
            .withColumn("idx", (F.col("_off") + F.col("_r") - 1).cast("long"))
            .withColumn("n_units", F.col("_total").cast("long"))
            .drop("_h", "_k", "_n", "_r", "_off", "_total"))
