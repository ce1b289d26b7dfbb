"""Event detection on ordered daily rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.functions.expressions import safe_div, wilson

Z = 1.5
DEATH_MIN_DAYS, VOLUME_FLOOR, DROP, LOOK = 25, 5.0, 0.5, 20


def _by(keys: Sequence[str] = ("a_id",)):
    return Window.partitionBy(*keys)


def block_candidate(z: float = Z) -> Column:
    """A 401/403 spike over the agent's own mean + z population sd, or any rate-limited request."""
    w = _by()
    m, sd = F.avg("cblock").over(w), F.stddev_pop("cblock").over(w)
    spike = (F.col("n") >= 3) & (sd > 0) & (F.col("cblock") > F.greatest(m + z * sd, F.lit(0.0)))
    return spike | (F.col("c429") > 0)


def thin_indices(candidates: Column, gap: int) -> Column:
    """Greedy thinning of a sorted index array: keep i when i - last kept >= gap."""
    return F.aggregate(candidates, F.slice(candidates, 1, 1),
                       lambda kept, i: F.when(i - F.element_at(kept, -1) >= gap, F.concat(kept, F.array(i))).otherwise(kept))


def _flag(df: DataFrame, flag: str, gaps: dict[str, int], keys: Sequence[str]) -> DataFrame:
    """Adds one boolean per entry of ``gaps``: the row survives thinning at that gap.

    Only candidate indices are collected (at most one per day of an agent's life), and the join
    back is on the key the panel is already partitioned by.
    """
    keys = list(keys)
    cand = df.where(F.col(flag)).groupBy(*keys).agg(F.sort_array(F.collect_list("i")).alias("_c"))
    kept = cand.select(*keys, *[thin_indices(F.col("_c"), g).alias(f"_{n}") for n, g in gaps.items()])
    out = df.join(kept, keys, "left")
    return out.withColumns({n: F.coalesce(F.array_contains(F.col(f"_{n}"), F.col("i")), F.lit(False)) for n in gaps}).drop(
        *[f"_{n}" for n in gaps])


def block_candidates(idx: DataFrame) -> DataFrame:
    """Unthinned block-pressure days; ``idx`` needs i and n."""
    return idx.withColumn("cand", block_candidate()).where("cand")


def flag_block_events(idx: DataFrame, gaps: dict[str, int]) -> DataFrame:
    return _flag(idx.withColumn("cand", block_candidate()), "cand", gaps, ["a_id"])


def block_events(idx: DataFrame, spacing: int) -> DataFrame:
    return flag_block_events(idx, {"kept": spacing}).where("kept")


def flag_pressure_events(active: DataFrame, z: float = Z, gap: int = 5, keys: Sequence[str] = ("a_id", "label"),
                         value: str = "resistance") -> DataFrame:
    """Days whose resistance exceeds mean + z sd of the agent's active days; constant series (to
    numpy's closeness) and non-positive thresholds give none."""
    w = _by(keys)
    first = F.first(value).over(w.orderBy("i"))
    spread = F.max(F.abs(F.col(value) - F.col("_first"))).over(w)
    d = active.withColumn("_first", first).withColumns({
        "_m": F.avg(value).over(w), "_sd": F.stddev_pop(value).over(w), "_spread": spread})
    thr = F.col("_m") + z * F.col("_sd")
    varies = F.col("_spread") > 1e-8 + 1e-5 * F.abs("_first")
    d = d.withColumn("cand", (F.col("n") >= 3) & varies & (thr > 0) & (F.col(value) > thr)).drop("_first", "_m", "_sd", "_spread")
    return _flag(d, "cand", {"kept": gap}, keys)


def eligible(lead: int, lag: int) -> Column:
    """The full window lies inside the agent's series."""
    return (F.col("i") >= lead) & (F.col("i") + lag < F.col("n"))


def event_branches(idx: DataFrame, min_days: int = 20) -> DataFrame:
    """Event days by branch (spike only, 429 only, both), reach and concentration of blocking.
    This tally uses the bare spike rule, without the minimum-length guards."""
    w = _by()
    spike = F.col("cblock") > F.avg("cblock").over(w) + Z * F.stddev_pop("cblock").over(w)
    limited = F.col("c429") > 0
    d = idx.withColumn("spike", spike)
    s = F.col("spike")
    agent = d.groupBy("a_id").agg(
        F.sum("robots").alias("robots"), F.count(F.lit(1)).alias("days"), F.count_if(s & ~limited).alias("sp"),
        F.count_if(~s & limited).alias("q"), F.count_if(s & limited).alias("both"),
        F.sum("c429").alias("c429"), F.sum("cblock").alias("cblock"), F.sum("hits").alias("hits"))
    t = agent.agg(
        F.count(F.lit(1)).alias("agents"), F.count_if(F.col("robots") > 0).alias("ever_robots"),
        F.count_if(F.col("days") >= min_days).alias("agents_with_min_days"), F.sum("sp").alias("events_block_only"),
        F.sum("q").alias("events_429_only"), F.sum("both").alias("events_both"), F.sum("c429").alias("responses_429"),
        F.sum("cblock").alias("responses_block"), F.sum("hits").alias("hits"), F.count_if(F.col("cblock") > 0).alias("agents_ever_blocked"),
        F.max("cblock").alias("largest_agent_block"))
    total = F.col("events_block_only") + F.col("events_429_only") + F.col("events_both")
    one = F.lit(1)
    return t.withColumns({
        "ever_robots_pct": 100 * F.col("ever_robots") / F.greatest("agents", one),
        "pct_429_only": 100 * F.col("events_429_only") / F.greatest(total, one),
        "pct_touching_429": 100 * (F.col("events_429_only") + F.col("events_both")) / F.greatest(total, one),
        "pct_ever_blocked": 100 * F.col("agents_ever_blocked") / F.greatest("agents", one),
        "largest_agent_share_pct": safe_div(100 * F.col("largest_agent_block"), F.col("responses_block"))})


def spacing_cost(idx: DataFrame, a: int = 5, b: int = 11) -> DataFrame:
    """Events kept at two spacings and the share lost, from one pass."""
    t = flag_block_events(idx, {"ka": a, "kb": b}).agg(
        F.count_if("ka").alias("events_from"), F.count_if("kb").alias("events_to"))
    lost = F.col("events_from") - F.col("events_to")
    return t.select(F.lit(a).cast("long").alias("spacing_from"), F.lit(b).cast("long").alias("spacing_to"), "events_from",
                    "events_to", lost.alias("events_dropped"), safe_div(100 * lost, F.col("events_from")).alias("pct_dropped"))


def collapse_frames(idx: DataFrame) -> DataFrame:
    """pre: mean of the 5 rows before; tail: mean of everything after (total minus running sum, so
    the frame costs one pass); look: maximum of the next 20 rows."""
    w = _by()
    o = w.orderBy("i")
    total, run = F.sum("hits").over(w), F.sum("hits").over(o.rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("n") - F.col("i") - 1
    return idx.withColumns({
        "pre": F.avg("hits").over(o.rowsBetween(-5, -1)), "tail": safe_div(total - run, left),
        "look": F.max("hits").over(o.rowsBetween(1, LOOK))})


def _collapsed(floor: float, drop: float) -> Column:
    return ((F.col("n") >= DEATH_MIN_DAYS) & (F.col("i") >= 5) & (F.col("i") + 1 < F.col("n")) & (F.col("pre") >= floor)
            & (F.col("tail") < drop * F.col("pre")) & (F.col("look") < F.col("pre")))


def persistent_deaths(idx: DataFrame, floor: float = VOLUME_FLOOR, drop: float = DROP) -> DataFrame:
    """The LAST block day after which volume collapses to the end of observation. No thinning."""
    d = collapse_frames(idx.withColumn("cand", block_candidate())).where(F.col("cand") & _collapsed(floor, drop))
    return d.groupBy("a_id").agg(
        F.max("date").alias("t_death"), F.max_by("pre", "date").alias("pre_vol"), F.max_by("tail", "date").alias("tail_vol")
    ).withColumn("drop_ratio", F.col("tail_vol") / F.col("pre_vol"))


def placebo_deaths(idx: DataFrame, floor: float = VOLUME_FLOOR, drop: float = DROP) -> DataFrame:
    """The FIRST collapse day with no block within three observations on either side."""
    near = F.sum("cblock").over(_by().orderBy("i").rowsBetween(-3, 3))
    d = collapse_frames(idx.withColumn("cand", block_candidate()).withColumn("near", near))
    d = d.where(~F.col("cand") & (F.col("near") <= 0) & _collapsed(floor, drop))
    return d.groupBy("a_id").agg(
        F.min("date").alias("t_death"), F.min_by("pre", "date").alias("pre_vol"), F.min_by("tail", "date").alias("tail_vol"))


def post_event_presence(idx: DataFrame, panel_end: DataFrame, spacing: int = 16, width: int = 5, min_days: int = 20) -> DataFrame:
    """Per event: censored, gone, quiet for ``width`` days, returned after it, follow-up."""
    d = flag_block_events(idx.where(F.col("n") >= min_days), {"kept": spacing})
    w = _by()
    d = d.withColumns({"next": F.lead("date").over(w.orderBy("i")), "last": F.max("date").over(w)})
    d = d.where(F.col("kept") & (F.col("i") >= width)).crossJoin(F.broadcast(panel_end))
    end = F.date_add("date", width)
    gone = F.col("next").isNull()
    quiet = gone | (F.col("next") > end)
    return d.select("a_id", "arm", F.col("date").alias("event_date"), (end > F.col("panel_end")).alias("censored"),
                    gone.alias("gone"), quiet.alias("quiet5"), (quiet & ~gone).alias("returned_after_quiet"),
                    F.datediff("panel_end", "date").cast("long").alias("followup_days"),
                    F.datediff("last", "date").cast("long").alias("days_to_last_seen"))


def disappearance_rates(presence: DataFrame, required: Sequence[int] = (5, 30, 90, 180, 365, 730)) -> DataFrame:
    """Share gone by arm and minimum follow-up, Wilson interval, agent-level share, quiet and returned.
    Follow-up 0 is the plain rate over uncensored events."""
    d = presence.where("not censored").withColumn("min_days", F.explode(F.array(*[F.lit(r).cast("long") for r in (0, *required)])))
    agent = d.where(F.col("followup_days") >= F.col("min_days")).groupBy("arm", "min_days", "a_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("k"), F.count_if("quiet5").alias("q"),
        F.count_if("returned_after_quiet").alias("r"))
    t = agent.groupBy("arm", "min_days").agg(
        F.sum("n").alias("n"), F.sum("k").alias("gone"), F.sum("q").alias("quiet5"), F.sum("r").alias("returned"),
        F.count(F.lit(1)).alias("agents_with_events"), F.count_if(F.col("k") > 0).alias("agents_that_vanish"))
    lo, hi = wilson(F.col("gone"), F.col("n"))
    return t.withColumns({"pct": 100 * F.col("gone") / F.col("n"), "wilson_lo": lo, "wilson_hi": hi})
