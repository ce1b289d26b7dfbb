"""Data contract: presence, schema, dates, digests, pins, reconciliation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def presence_check(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Every declared id with its presence, and the counts beside it."""
    p = present.select("a_id").distinct().withColumn("present", F.lit(True))
    d = declared.select("a_id").distinct().join(p, "a_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    t = d.agg(F.count(F.lit(1)).alias("n_declared"), F.count_if("present").alias("n_present"))
    return d.crossJoin(F.broadcast(t))


def schema_check(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns: there, and numeric. Reads the schema only; the row count proves the table opens."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in kinds).alias("exists"), F.lit(kinds.get(c, False)).alias("numeric")) for c in required])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(rows).alias("r")).select("r.*", "n_rows")


def date_check(series: DataFrame, text: str = "date_text", order: str = "ord") -> DataFrame:
    """Unparseable, duplicated and non-monotone dates per agent series (one row per stored day)."""
    d = series.withColumn("_d", F.expr(f"try_cast({text} as date)"))
    prev = F.lag("_d").over(Window.partitionBy("a_id").orderBy(order))
    d = d.withColumn("_back", F.coalesce(F.col("_d") < prev, F.lit(False)))
    return d.groupBy("a_id").agg(F.count_if(F.col("_d").isNull()).alias("unparseable"), (F.count("_d") - F.count_distinct("_d")).alias("duplicated"),
                                 F.count_if("_back").alias("non_monotone"))


def exclusion_report(declared: DataFrame, panel: DataFrame, min_days: int) -> DataFrame:
    """Below-minimum agents are exclusions with a reason, not failures."""
    n = panel.groupBy("a_id").agg(F.count(F.lit(1)).alias("_n"))
    reason = F.when(F.col("_n").isNull(), "no_rows").when(F.col("_n") < min_days, "below_min_days").otherwise("admitted")
    return declared.select("a_id").distinct().join(n, "a_id", "left").groupBy(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n_agents"), F.sum(F.coalesce("_n", F.lit(0))).alias("n_rows"))


def agent_digests(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """sha256 per agent over its date-ordered rows of integers (doubles print differently per engine)."""
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in ("date", *columns)])
    return panel.groupBy("a_id").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(row))), 256).alias("digest"), F.count(F.lit(1)).alias("n_rows"))


def cohort_digest(digests: DataFrame) -> DataFrame:
    """One digest for a cohort as a tree: 4096 id slices are digested in parallel, then the slices."""
    line = F.concat_ws(":", F.lpad(F.col("a_id").cast("string"), 20, "0"), "digest", F.col("n_rows").cast("string"))
    part = digests.groupBy(F.substring(F.md5(F.col("a_id").cast("string")), 1, 3).alias("_k")).agg(
        F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(line))), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    whole = F.sort_array(F.collect_list(F.concat_ws(":", "_k", "_d")))
    return part.agg(F.sha2(F.concat_ws("|", whole), 256).alias("content_digest"), F.sum("_n").alias("n_declared"))


def pin_compare(current: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, digest, n) against the registry: match, changed set, changed content, unpinned."""
    r = registry.select("key", F.col("digest").alias("_d"), F.col("n").alias("_n"))
    status = (F.when(F.col("_d").isNull(), "unpinned").when(F.col("n") != F.col("_n"), "changed_set")
              .when(F.col("digest") != F.col("_d"), "changed_content").otherwise("match"))
    return current.join(r, "key", "left").select("key", "n", status.alias("status"))


def id_problems(value: Column) -> Column:
    number = F.expr("try_cast(id_text as decimal(38,6))")
    return (F.when(value.isNull(), "null").when(F.lower(value).isin("true", "false"), "boolean").when(number.isNull(), "not_a_number")
            .when(number != F.floor(number), "fractional").when(number <= 0, "non_positive"))


def id_list_check(ids: DataFrame) -> DataFrame:
    """Refusals of an id list by reason, duplicates counted by their extra copies."""
    d = ids.withColumn("reason", id_problems(F.col("id_text")))
    bad = d.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    dup = (d.where("reason is null").groupBy("id_text").agg((F.count(F.lit(1)) - 1).alias("_x")).where("_x > 0")
           .agg(F.sum("_x").alias("n")).where("n is not null").select(F.lit("duplicate").alias("reason"), "n"))
    return bad.unionByName(dup)


def set_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both differences of two id sets; equal sets give no row."""
    a = left.select("a_id").distinct().withColumn("_l", F.lit(1))
    b = right.select("a_id").distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    return a.join(b, "a_id", "full").select("a_id", side.alias("side")).where("side is not null")


def registry_check(registry: DataFrame) -> DataFrame:
    """Registry rows: key kind by prefix, 64 hex digits, a non-negative whole count."""
    kind = F.when(F.col("key").startswith("axis"), "axis").otherwise("cohort")
    ok_d, ok_n = F.col("digest").rlike("^[0-9a-f]{64}$"), F.col("n") >= 0
    problem = F.when(~F.coalesce(ok_d, F.lit(False)), "bad_digest").when(~F.coalesce(ok_n, F.lit(False)), "bad_count").otherwise("ok")
    return registry.groupBy(kind.alias("kind"), problem.alias("problem")).agg(F.count(F.lit(1)).alias("n_rows"))


def pin_plan(current: DataFrame, registry: DataFrame) -> DataFrame:
    """What recording the current digests would do, as a table, before anything is written."""
    action = F.when(F.col("status") == "match", "keep").when(F.col("status") == "unpinned", "add").otherwise("replace")
    return pin_compare(current, registry).groupBy(action.alias("action"), "status").agg(F.count(F.lit(1)).alias("n_keys"))


def planned_registry(current: DataFrame, registry: DataFrame, replace: bool = False) -> DataFrame:
    """The registry that recording would leave: unpinned keys are added, changed ones replaced only if asked to."""
    new = current.select("key", F.struct("digest", F.col("n").cast("long").alias("n")).alias("_c"))
    old = registry.select("key", F.struct("digest", F.col("n").cast("long").alias("n")).alias("_r"))
    first, second = ("_c", "_r") if replace else ("_r", "_c")
    return new.join(old, "key", "full").select("key", F.coalesce(first, second).alias("x")).select("key", "x.*")


def interval_sanity(results: DataFrame, lo: str, hi: str, estimate: str) -> DataFrame:
    """Rows whose interval is inverted or misses its own estimate."""
    e = F.col(estimate)
    return results.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(lo) > F.col(hi)).alias("inverted"),
                       F.count_if((e < F.col(lo)) | (e > F.col(hi))).alias("outside"), F.count_if(F.col(lo).isNull() != F.col(hi).isNull()).alias("half_missing"))


def value_reconcile(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Claims against recomputed metrics at the claim's own precision."""
    scale = F.pow(F.lit(10.0), F.col("digits"))
    near = F.abs(F.round(F.col("metric") * scale) / scale - F.col("claimed")) < 1e-9
    status = F.when(F.col("metric").isNull(), "no_metric").when(near, "agrees").otherwise("differs")
    return claims.join(metrics, "key", "left").select("key", "claimed", status.alias("status"))


def partition_check(df: DataFrame, value: str, bins: Sequence[tuple[int, int]]) -> DataFrame:
    """How many rows fall into exactly one bin, none, or several."""
    hits = sum((F.col(value).between(lo, hi).cast("int") for lo, hi in bins[1:]), F.col(value).between(*bins[0]).cast("int"))
    return df.select(hits.alias("h")).agg(F.count_if(F.col("h") == 1).alias("exactly_one"), F.count_if(F.col("h") == 0).alias("none"),
                                          F.count_if(F.col("h") > 1).alias("several"), (F.min("h") == 1).alias("_a"), (F.max("h") == 1).alias("_b")
                                          ).withColumn("is_partition", F.col("_a") & F.col("_b")).drop("_a", "_b")


def hollow_result_guard(results: DataFrame) -> DataFrame:
    """Nulls with 0 draws over a non-empty pair set: a missing source, not a null of zero."""
    return results.withColumn("hollow", (F.col("n_draws") == 0) & (F.col("n_pairs") > 0))
