"""Labelled populations: splits, rosters with explicit precedence, censuses, overlaps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.functions.distributed import number_units
from rebuff.operators.panel import MAX_ID

SHARE_THRESHOLD = 0.25


def decoy_totals(honeypot: DataFrame) -> DataFrame:
    """Decoy hits per agent; NULL when every total is NULL."""
    return honeypot.groupBy(F.col("uh_a_id").alias("a_id")).agg(F.sum("uh_total").alias("tot"))


def honeypot_split(honeypot: DataFrame) -> DataFrame:
    """Agents with decoy hits > 0 and = 0; unknown totals belong to neither side."""
    t = decoy_totals(honeypot).where("tot >= 0 and tot is not null")
    return t.select("a_id", F.when(F.col("tot") > 0, "positive").otherwise("negative").alias("side"))


def trusted_ip_agents(log: DataFrame, trusted: DataFrame) -> DataFrame:
    """Agents ever seen from a trusted address; the address list is a curated one."""
    pairs = log.select(F.col("h_a_id").alias("a_id"), F.col("h_i_id").alias("i_id")).distinct()
    return pairs.join(trusted, "i_id", "left_semi").select("a_id").distinct()


def first_by_priority(tagged: DataFrame, order: list[Column]) -> DataFrame:
    """One row per agent, the first in ``order``."""
    w = Window.partitionBy("a_id").orderBy(*order)
    return tagged.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def roster_v1(labels: DataFrame, positive: DataFrame, trusted: DataFrame, negative: DataFrame) -> DataFrame:
    """Union of sources; a labelled role wins, and among labels the LAST class listed wins, so a
    human who is also a candidate human ends up as the candidate."""
    label_rank = (F.when(F.col("label") == "pothuman", 4).when(F.col("label") == "chrome", 3)
                  .when(F.col("label") == "human", 2).otherwise(1))
    parts = (labels.select("a_id", F.concat(F.lit("labeled_"), "label").alias("role"),
                                                          F.lit(4).alias("p"), label_rank.alias("q"))
             .unionByName(positive.select("a_id", F.lit("bot_hp").alias("role"), F.lit(3).alias("p"), F.lit(0).alias("q")))
             .unionByName(trusted.select("a_id", F.lit("ctrl_white").alias("role"), F.lit(2).alias("p"), F.lit(0).alias("q")))
             .unionByName(negative.select("a_id", F.lit("ctrl_hpneg").alias("role"), F.lit(1).alias("p"), F.lit(0).alias("q"))))
    role = F.col("role")
    return first_by_priority(parts, [F.desc("p"), F.desc("q")]).select(
        "a_id", "role", role.isin("bot_hp", "labeled_bot").alias("is_bot"),
        (role.startswith("ctrl_") | role.isin("labeled_human", "labeled_chrome", "labeled_pothuman")).alias("is_control"),
        (F.col("a_id") > MAX_ID).alias("over_limit"))


def draw_order(df: DataFrame, by: Sequence[str] = (), key: str = "a_id", seed: int = 42) -> DataFrame:
    """All rows with ``draw``, their place from 1 in the order md5(seed, key), per stratum. A sample is a filter on it."""
    return number_units(df, key, by, seed=str(seed)).withColumn("draw", F.col("idx") + 1).drop("idx", "n_units")


def seeded_sample(df: DataFrame, n: int, key: str = "a_id", seed: int = 42) -> DataFrame:
    """n rows in the order md5(seed, key): a bounded top-k per task. n = 0 means everyone."""
    if n < 0:
        raise ValueError("a negative sample size is neither a census nor a sample")
    if n == 0:
        return df
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(h, key).limit(n)


def sample_to_size_of(df: DataFrame, other: DataFrame, key: str = "a_id", seed: int = 42) -> DataFrame:
    """A seeded sample of ``df`` with as many rows as ``other``."""
    size = other.agg(F.count(F.lit(1)).alias("_size"))
    return draw_order(df, key=key, seed=seed).crossJoin(F.broadcast(size)).where(F.col("draw") <= F.col("_size")).drop("draw", "_size")


def stratified_sample(df: DataFrame, by: str, cap: int, key: str = "a_id", seed: int = 42) -> DataFrame:
    """At most ``cap`` per stratum, in md5 order; strata are numbered in hash slices, not in one task."""
    return draw_order(df, [by], key, seed).where(F.col("draw") <= cap).drop("draw")


def abusive_arm(honeypot: DataFrame, agent: DataFrame, threshold: float = SHARE_THRESHOLD) -> DataFrame:
    """Decoy hits over total hits, clipped to [0, 1], strictly above the threshold."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("tot") / F.col("a_totalhit")))
    return (decoy_totals(honeypot).where("tot > 0").join(agent.select("a_id", "a_totalhit"), "a_id")
            .select("a_id", F.col("tot").alias("decoy_hits"), "a_totalhit", share.alias("share"))
            .where(F.col("share") > threshold))


def curated(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col("label") == label).select("a_id")


def arm_of_record(arm: DataFrame, labels: DataFrame) -> DataFrame:
    """The abusive arm without verified humans: hand verification outranks a criterion."""
    return arm.join(curated(labels, "human"), "a_id", "left_anti")


def roster_v2(labels: DataFrame, arm: DataFrame) -> DataFrame:
    """verified_human > abusive_share > declared > pothuman; the first listed group wins."""
    groups = [("verified_human", curated(labels, "human")), ("abusive_share", arm.select("a_id")),
              ("declared", curated(labels, "bot")), ("pothuman", curated(labels, "pothuman"))]
    parts = None
    for p, (role, ids) in enumerate(groups):
        part = ids.select("a_id", F.lit(role).alias("role"), F.lit(p).alias("p"))
        parts = part if parts is None else parts.unionByName(part)
    return first_by_priority(parts, [F.asc("p")]).select(
        "a_id", "role", (F.col("role") == "abusive_share").alias("is_bot"),
        (F.col("role") == "verified_human").alias("is_control"), (F.col("a_id") > MAX_ID).alias("over_limit"))


def honeypot_census(honeypot: DataFrame) -> DataFrame:
    """Distinct agents by NULL, zero and positive totals."""
    t = F.col("tot")
    return decoy_totals(honeypot).agg(
        F.count(F.lit(1)).alias("distinct_agents"), F.count_if(t.isNull()).alias("null_total"),
        F.count_if(t == 0).alias("explicit_zero"), F.count_if(t > 0).alias("positive"))


def window_selection(honeypot: DataFrame, agent: DataFrame) -> DataFrame:
    """In- and out-of-window agents: size and 5-95 % span."""
    t = decoy_totals(honeypot).where("tot is not null").join(agent, "a_id")
    return t.groupBy(F.when(F.col("tot") > 0, "in_window").otherwise("out_of_window").alias("grp")).agg(
        F.count(F.lit(1)).alias("agents"), F.round(F.avg("a_totalhit"), 0).alias("mean_requests"),
        F.round(F.avg(F.datediff("a_last_5p", "a_start_5p")), 1).alias("mean_window_days"))


def population_overlap(members: DataFrame) -> DataFrame:
    """Pairwise intersections of named populations (population, a_id).

    Each agent's memberships (a handful of names) become one sorted array, and pairs of names are
    expanded from it; no join over agents."""
    names = members.distinct().groupBy("a_id").agg(F.sort_array(F.collect_set("population")).alias("ps"))
    pair = F.explode(F.flatten(F.transform("ps", lambda x: F.transform(
        F.filter("ps", lambda y: y > x), lambda y: F.struct(x.alias("left_pop"), y.alias("right_pop"))))))
    return names.select(pair.alias("p")).groupBy("p.left_pop", "p.right_pop").agg(F.count(F.lit(1)).alias("n_common"))


def cohort_counts(roster: DataFrame, panel: DataFrame) -> DataFrame:
    """Roster count against extracted count per role."""
    have = panel.select("a_id").distinct().withColumn("_have", F.lit(1))
    return roster.join(have, "a_id", "left").groupBy("role").agg(
        F.count(F.lit(1)).alias("n_roster"), F.count("_have").alias("n_extracted"))


def moderate_bots(honeypot: DataFrame, lo: int = 200, hi: int = 8000, n: int = 10) -> DataFrame:
    """All agents with a decoy total: whether it lies in [lo, hi], and whether the id is among the lowest n of those."""
    t = decoy_totals(honeypot).where("tot is not null").withColumn("moderate", F.col("tot").between(lo, hi))
    first = t.where("moderate").orderBy("a_id").limit(n).select("a_id", F.lit(True).alias("chosen"))
    return t.join(F.broadcast(first), "a_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))     # n rows


def size_screen(agent: DataFrame, cap: int = 500_000) -> DataFrame:
    """Marks the known giants that a bulk extraction plan leaves for single runs; an unknown size is not one."""
    return agent.withColumn("screened", F.coalesce(F.col("a_totalhit") > cap, F.lit(False)))


def arm_revision(old: DataFrame, new: DataFrame, roster: DataFrame) -> DataFrame:
    """Added, removed and kept agents between two arm definitions, with the roster role of each.
    (Inferred from the published counts; its producer is not public.)"""
    o = old.select("a_id").distinct().withColumn("_o", F.lit(1))
    n = new.select("a_id").distinct().withColumn("_n", F.lit(1))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("kept")
    return (o.join(n, "a_id", "full").join(roster.select("a_id", "role"), "a_id", "left")
            .groupBy(change.alias("change"), F.coalesce("role", F.lit("none")).alias("role"))
            .agg(F.count(F.lit(1)).alias("n_agents")))


def curated_labels(labels: DataFrame) -> DataFrame:
    """Labels per agent with the twin flag and the id-limit flag."""
    return (labels.groupBy("a_id")
            .agg(F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"),
                 F.count_distinct("label").alias("n_labels"))
            .withColumns({"twin": F.col("n_labels") > 1, "over_limit": F.col("a_id") > MAX_ID}))
