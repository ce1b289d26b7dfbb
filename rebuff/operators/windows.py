"""Event-study estimators as window frames over each agent's ordered days.

One shuffle by agent serves index, thresholds, pre/post means and event-time trajectories; offsets
are lead/lag columns, never an event x offset join. An agent's window holds one row per day it was
active, so its size is bounded by the calendar however many requests it sent.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.functions.expressions import safe_div, shift_frame, solve
from rebuff.functions.resample import REPLICATES, interval, replicate_sums
from rebuff.operators import events
from rebuff.session import materialize

MIN_DAYS = 20
W = 5
LEAD = 10
RETREAT = 0.5


def index_days(df: DataFrame, keys: Sequence[str] = ("a_id",), order: str = "date") -> DataFrame:
    """0-based position ``i`` among the agent's rows, and their number ``n``."""
    w = Window.partitionBy(*keys)
    return df.withColumn("i", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn(
        "n", F.count(F.lit(1)).over(w))


def _w(keys: Sequence[str] = ("a_id",)):
    return Window.partitionBy(*keys).orderBy("i")


def frame_mean(col: str | Column, lo: int, hi: int, keys: Sequence[str] = ("a_id",)) -> Column:
    """Mean over rows lo..hi around the current one; NULL values are skipped."""
    return F.avg(col).over(_w(keys).rowsBetween(lo, hi))


def window_mean(col: str | Column, side: str, width: int = W, keys: Sequence[str] = ("a_id",)) -> Column:
    return frame_mean(col, *shift_frame(side, width), keys)


def at(col: str, t: int, keys: Sequence[str] = ("a_id",)) -> Column:
    return F.lead(col, t).over(_w(keys)) if t >= 0 else F.lag(col, -t).over(_w(keys))


def with_loghits(df: DataFrame) -> DataFrame:
    return df.withColumn("loghits", F.log1p("hits"))


def reference_frame(idx: DataFrame, control: Column, p404: str = "p404_bi", min_days: int = MIN_DAYS) -> DataFrame:
    """One row: mean and population sd (+1e-9) over control agents of their mean behaviour vector."""
    prof = (idx.where(control & (F.col("n") >= min_days)).groupBy("a_id").agg(
        F.avg(p404).alias("m1"), F.avg("robots_rate").alias("m2"), F.avg(F.log1p("hits")).alias("m3")))
    return prof.agg(*[x for k in (1, 2, 3) for x in (
        F.avg(f"m{k}").alias(f"u{k}"), (F.stddev_pop(f"m{k}") + 1e-9).alias(f"s{k}"))])


def _norm(p404: str | Column) -> Column:
    p = F.col(p404) if isinstance(p404, str) else p404
    z = [(p - F.col("u1")) / F.col("s1"), (F.col("robots_rate") - F.col("u2")) / F.col("s2"),
         (F.log1p("hits") - F.col("u3")) / F.col("s3")]
    return F.sqrt(z[0] * z[0] + z[1] * z[1] + z[2] * z[2])


def observability(idx: DataFrame, frame: DataFrame, p404: str = "p404_bi", name: str = "o",
                  min_days: int = MIN_DAYS) -> DataFrame:
    """Daily distance from the reference frame; the frame is one row."""
    return (idx.where(F.col("n") >= min_days).crossJoin(F.broadcast(frame))
            .withColumn(name, _norm(p404)).drop(*[f"{a}{k}" for a in "us" for k in (1, 2, 3)]))


def event_outcomes(obs: DataFrame, spacing: int = 16, base: tuple[int, int] = (-10, -6), post: tuple[int, int] = (1, 5),
                   lead: int = LEAD, lag: int = W, retreat: float = RETREAT) -> DataFrame:
    """Per kept event: pre and post O, geometric volumes, and the stealth flag (volume not halved)."""
    d = events.flag_block_events(with_loghits(obs), {"kept": spacing})
    d = d.withColumns({
        "pre_o": frame_mean("o", *base), "post_o": frame_mean("o", *post),
        "pre_v": F.expm1(window_mean("loghits", "pre")), "post_v": F.expm1(window_mean("loghits", "post"))})
    d = d.where(F.col("kept") & (F.col("i") >= lead) & (F.col("i") + lag < F.col("n")))
    return (d.withColumn("d_o", F.col("post_o") - F.col("pre_o")).where("d_o is not null")
            .withColumn("stealth", ~(F.col("post_v") < retreat * F.col("pre_v"))))


def agent_did_units(outcomes: DataFrame) -> DataFrame:
    """Agent means of the event deltas: agents, not events, are weighted equally."""
    return outcomes.groupBy("a_id", "arm").agg(
        F.avg("d_o").alias("d_o"), F.avg(F.when(F.col("stealth"), F.col("d_o"))).alias("d_o_stealth"),
        F.count(F.lit(1)).alias("n_events"))


def calendar_retreat(idx: DataFrame, panel_end: DataFrame, spacing: int = 16, width: int = W,
                     retreat: float = RETREAT) -> DataFrame:
    """Censored / disappeared / retreated / persisted per event on a zero-filled calendar.

    Calendar means come from range frames over the day number: absent days add nothing to the sum
    and are counted in the denominator, up to the agent's own last day."""
    d = events.flag_block_events(idx.where(F.col("n") >= MIN_DAYS), {"kept": spacing})
    day = F.datediff("date", F.lit("1970-01-01"))
    wk = Window.partitionBy("a_id")
    rng = wk.orderBy("dn")
    d = d.withColumn("dn", day).withColumns({
        "first": F.min("dn").over(wk), "last": F.max("dn").over(wk),
        "pre_sum": F.coalesce(F.sum("hits").over(rng.rangeBetween(-width, -1)), F.lit(0)),
        "post_sum": F.coalesce(F.sum("hits").over(rng.rangeBetween(1, width)), F.lit(0))})
    d = d.where(F.col("kept") & (F.col("i") >= width)).crossJoin(F.broadcast(panel_end))
    pre_days = F.least(F.lit(width), F.col("dn") - F.col("first"))
    post_days = F.least(F.lit(width), F.col("last") - F.col("dn"))
    pre_v, post_v = F.col("pre_sum") / pre_days, F.coalesce(safe_div(F.col("post_sum"), post_days), F.lit(0.0))
    end = F.date_add("date", width)
    outcome = (F.when(end > F.col("panel_end"), "censored").when(pre_days <= 0, "no_baseline")
               .when((F.col("dn") + width > F.col("last")) & (post_v == 0), "disappeared")
               .when(post_v < retreat * pre_v, "retreated").otherwise("persisted"))
    return d.select("a_id", "arm", "date", outcome.alias("outcome"))


def retreat_summary(events_: DataFrame) -> DataFrame:
    def n(x):
        return F.count_if(F.col("outcome") == x)
    t = events_.groupBy("arm").agg(
        F.count_distinct("a_id").alias("n_agents"), F.count(F.lit(1)).alias("n_events_all"), n("censored").alias("n_censored"),
        n("disappeared").alias("n_disappear"), n("retreated").alias("n_retreat"), n("persisted").alias("n_persist"))
    t = t.withColumn("evaluable", F.col("n_events_all") - F.col("n_censored"))
    return t.withColumns({
        "disappear_share": safe_div(F.col("n_disappear"), F.col("evaluable")),
        "retreat_share": safe_div(F.col("n_retreat"), F.col("evaluable")),
        "exit_share": safe_div(F.col("n_disappear") + F.col("n_retreat"), F.col("evaluable"))})


def full_events(df: DataFrame, spacing: int, width: int = W) -> DataFrame:
    """Rows with the ``kept`` flag and full adjacent windows; frames must be added before filtering."""
    return events.flag_block_events(df, {"kept": spacing}).withColumn(
        "full", F.col("kept") & (F.col("i") >= width) & (F.col("i") + width < F.col("n")))


def retreat_by_cut(idx: DataFrame, group: str, cuts: Sequence[float] = (0.3, 0.5, 0.7), spacing: int = 11) -> DataFrame:
    """Share of events whose geometric volume fell below (1 - cut) of the baseline."""
    d = full_events(with_loghits(idx.where(F.col("n") >= MIN_DAYS)), spacing)
    d = d.withColumn("ratio", F.expm1(window_mean("loghits", "post"))
                     / F.greatest(F.expm1(window_mean("loghits", "pre")), F.lit(1e-9))).where("full")
    d = d.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    return d.groupBy(F.col(group).alias("grp"), "cut").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("ratio") < 1 - F.col("cut")).alias("n_retreat"),
        F.avg((F.col("ratio") < 1 - F.col("cut")).cast("double")).alias("share"))


CHANNELS = ("d_p404", "d_robots", "d_loghits", "z_robots")
#: The four population contrasts (treated, control).
PAIRINGS = (("abusive", "verified"), ("declared", "verified"), ("abusive", "pothuman"), ("declared", "pothuman"))


def response_channels(idx: DataFrame, spacing: int = 11) -> DataFrame:
    """Agent means of four response channels, long form (a_id, pop, channel, value)."""
    d = full_events(with_loghits(idx.where(F.col("n") >= MIN_DAYS)), spacing)
    step = F.col("robots_rate") - F.lag("robots_rate").over(_w())
    d = d.withColumn("_step", step).withColumn("vol", F.coalesce(F.stddev_pop("_step").over(Window.partitionBy("a_id")), F.lit(0.0)))
    for name, col in (("d_p404", "p404"), ("d_robots", "robots_rate"), ("d_loghits", "loghits")):
        d = d.withColumn(name, window_mean(col, "post") - window_mean(col, "pre"))
    d = d.where("full").withColumn("z_robots", F.abs("d_robots") / (F.col("vol") + 1e-9))
    agent = d.groupBy("a_id", "pop").agg(*[F.avg(c).alias(c) for c in CHANNELS])
    return agent.unpivot(["a_id", "pop"], list(CHANNELS), "channel", "value")


def pair_sides(units: DataFrame) -> DataFrame:
    """Each agent joins every contrast its population takes part in, as side a or b."""
    out = [F.when(F.col("pop").isin(a, b), F.struct(F.lit(f"{a}_vs_{b}").alias("pair"),
                                                    F.when(F.col("pop") == a, "a").otherwise("b").alias("side")))
           for a, b in PAIRINGS]
    return (units.withColumn("_p", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())))
            .select("*", "_p.pair", "_p.side").drop("_p"))


def event_curves(df: DataFrame, flag: str, features: Sequence[str], keys: Sequence[str], width: int = W,
                 whole: bool = True) -> DataFrame:
    """(keys, i, feature, t, value): feature at offsets -width..width minus the event's pre-mean."""
    cells = []
    for f in features:
        base = window_mean(f, "pre", width, keys)
        cells += [F.struct(F.lit(f).alias("feature"), F.lit(t).cast("long").alias("t"), (at(f, t, keys) - base).alias("value"))
                  for t in range(-width, width + 1)]
    d = df.withColumn("_cells", F.array(*cells)).where(F.col(flag))
    d = d.select(*keys, "i", "n", F.explode("_cells").alias("c")).select(*keys, "i", "n", "c.*")
    return d if not whole else d.where("value is not null")


def trajectory(df: DataFrame, flag: str, value: str, lead: int = LEAD, keys: Sequence[str] = ("a_id",)) -> DataFrame:
    """Adds ``traj``: values at offsets -lead..lead, for events with the full span only."""
    d = df.withColumn("traj", F.array(*[at(value, t, keys) for t in range(-lead, lead + 1)]))
    return d.where(F.col(flag) & (F.col("i") >= lead) & (F.col("i") + lead < F.col("n")))


def agent_trajectories(df: DataFrame, flag: str, value: str = "o", ref: int | None = -6, lead: int = LEAD) -> DataFrame:
    """One row per agent with columns t_0..t_2*lead: mean over its events, each relative to ``ref``."""
    d = trajectory(df, flag, value, lead)
    if ref is not None:
        base = F.col("traj")[lead + ref]
        d = d.where(base.isNotNull())
        cells = [F.avg(F.col("traj")[k] - base).alias(f"t_{k}") for k in range(2 * lead + 1)]
    else:
        cells = [F.avg(F.col("traj")[k]).alias(f"t_{k}") for k in range(2 * lead + 1)]
    return d.groupBy("a_id", "arm").agg(F.count(F.lit(1)).alias("n_events"), *cells)


def long_trajectories(agent: DataFrame, lead: int = LEAD, keys: Sequence[str] = ("a_id", "arm")) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k - lead).cast("long").alias("t"), F.col(f"t_{k}").alias("v")) for k in range(2 * lead + 1)])
    return agent.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.t", "c.v")


def trajectory_replicates(agent: DataFrame, lead: int = LEAD, reps: int = REPLICATES) -> DataFrame:
    """(rep, d_0..d_2*lead): difference of arm means per offset. All offsets of a replicate share
    one draw of agents, so trends across offsets keep their covariance."""
    cols = range(2 * lead + 1)
    m = replicate_sums(agent, "a_id", ["arm"], [f"t_{k}" for k in cols], reps).select("arm", "rep", *[(F.col(f"t_{k}") / F.col(f"n_t_{k}")).alias(f"t_{k}") for k in cols])
    def arm(name, k):
        return F.max(F.when(F.col("arm") == name, F.col(f"t_{k}")))
    return m.groupBy("rep").agg(*[(arm("abusive", k) - arm("verified", k)).alias(f"d_{k}") for k in cols])


def trajectory_difference(agent: DataFrame, lead: int = LEAD) -> DataFrame:
    """One row: observed difference of arm means per offset, columns d_0.."""
    def arm(name, k):
        return F.avg(F.when(F.col("arm") == name, F.col(f"t_{k}")))
    return agent.agg(*[(arm("abusive", k) - arm("verified", k)).alias(f"d_{k}") for k in range(2 * lead + 1)])


def event_time_study(agent: DataFrame, lead: int = LEAD, reps: int = REPLICATES) -> DataFrame:
    """Per offset: arm means over agents, their difference and its percentile band."""
    agent = materialize(agent)
    cols = [f"d_{k}" for k in range(2 * lead + 1)]
    band = (trajectory_replicates(agent, lead, reps).unpivot(["rep"], cols, "k", "stat")
            .groupBy("k").agg(*interval(lo="diff_lo", hi="diff_hi")))
    means = long_trajectories(agent, lead).groupBy("t").agg(
        *[F.avg(F.when(F.col("arm") == a, F.col("v"))).alias(f"mean_{a}") for a in ("abusive", "verified")])
    return (means.withColumn("k", F.concat(F.lit("d_"), (F.col("t") + lead).cast("string"))).join(band, "k")
            .select("t", "mean_abusive", "mean_verified",
                    (F.col("mean_abusive") - F.col("mean_verified")).alias("diff"), "diff_lo", "diff_hi"))


def _slope(lo: int, hi: int, lead: int) -> Column:
    ts = range(lo, hi + 1)
    mid = sum(ts) / len(ts)
    den = sum((t - mid) ** 2 for t in ts)
    return sum((F.col(f"d_{t + lead}") * ((t - mid) / den) for t in ts), F.lit(0.0))


def pretrend_test(agent: DataFrame, lead: int = LEAD, reps: int = REPLICATES,
                  spans: Sequence[tuple[str, int, int]] = (("near", -5, -1), ("far", -10, -6))) -> DataFrame:
    """Slope of the arm difference over pre-event spans with its interval, and the number of
    offsets whose band excludes zero. Least squares on fixed offsets is a weighted sum of columns."""
    agent = materialize(agent)
    obs, rep = trajectory_difference(agent, lead), trajectory_replicates(agent, lead, reps)
    wide_o = obs.select(*[_slope(a, b, lead).alias(f"s_{n}") for n, a, b in spans])
    stats = []
    for n, a, b in spans:
        stats += interval(_slope(a, b, lead), f"lo_{n}", f"hi_{n}")
        outside = [((F.percentile(f"d_{t + lead}", F.lit(0.025)) > 0) | (F.percentile(f"d_{t + lead}", F.lit(0.975)) < 0)).cast("long")
                   for t in range(a, b + 1)]
        stats.append(sum(outside[1:], outside[0]).alias(f"x_{n}"))
    both = wide_o.crossJoin(F.broadcast(rep.agg(*stats)))
    rows = F.array(*[F.struct(F.lit(n).alias("span"), F.col(f"s_{n}").alias("slope"), F.col(f"lo_{n}").alias("slope_lo"),
                              F.col(f"hi_{n}").alias("slope_hi"), F.col(f"x_{n}").alias("n_excluding_zero"))
                     for n, _, _ in spans])
    return both.select(F.explode(rows).alias("r")).select("r.*")


def spec_units(idx: DataFrame, control: Column, spacings: Sequence[int] = (5, 11, 15, 16, 21), widths: Sequence[int] = (3, 5, 7),
               gaps: Sequence[int] = (0, 1, 3, 5), lead: int = LEAD) -> DataFrame:
    """Agent effects for every cell coordinate x spacing x width x gap, in one pass over the panel.

    Half-windows reaching past the balanced panel are silently shortened to it."""
    from rebuff.operators.panel import p404
    coords = ("baseline", "nonblocked", "vs200")
    d = idx.withColumns({f"c_{c}": p404(c) for c in coords}).where(F.col("n") >= MIN_DAYS)
    for c in coords:
        d = observability(d, reference_frame(d, control, f"c_{c}"), f"c_{c}", f"o_{c}")
    d = events.flag_block_events(d, {f"k_{g}": g for g in spacings})
    for c in coords:
        d = d.withColumn(f"tr_{c}", F.array(*[at(f"o_{c}", t) for t in range(-lead, lead + 1)]))
    d = d.where((F.col("i") >= lead) & (F.col("i") + lead < F.col("n")))
    d = d.withColumn("spacing", F.explode(F.filter(F.array(*[F.when(F.col(f"k_{g}"), F.lit(g)) for g in spacings]), lambda x: x.isNotNull())))
    d = d.select("a_id", "arm", "spacing", F.explode(F.array(*[
        F.struct(F.lit(c).alias("coord"), F.col(f"tr_{c}").alias("tr")) for c in coords])).alias("x"))
    agent = d.groupBy("a_id", "arm", "spacing", "x.coord").agg(*[F.avg(F.col("x.tr")[k]).alias(f"t_{k}") for k in range(2 * lead + 1)])
    def mean(ts):
        cells = F.filter(F.array(*[F.col(f"t_{t + lead}") for t in ts]), lambda x: x.isNotNull())
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x, lambda a: F.when(F.size(cells) > 0, a / F.size(cells)))
    cells = F.array(*[F.struct(
        F.lit(w).alias("w"), F.lit(g).alias("gap"),
        (mean(range(1, w + 1)) - mean(range(max(-lead, -(g + w)), -g))).alias("d")) for w in widths for g in gaps])
    return agent.select("a_id", "arm", "coord", F.col("spacing").cast("long").alias("spacing"), F.explode(cells).alias("c")).select(
        "a_id", "arm", "coord", "spacing", F.col("c.w").cast("long").alias("w"), F.col("c.gap").cast("long").alias("gap"), "c.d")


def full_pre_linear(long: DataFrame) -> DataFrame:
    """Mean post deviation from the agent's own extrapolated pre-trend (4+ pre points)."""
    t, v = F.col("t"), F.col("v")
    pre, post = (t <= -1) & v.isNotNull(), (t >= 1) & v.isNotNull()
    y, x = F.when(pre, v), F.when(pre, t.cast("double"))
    d = long.groupBy("a_id", "arm").agg(
        F.count(y).alias("k"), F.regr_slope(y, x).alias("b1"), F.regr_intercept(y, x).alias("b0"),
        F.avg(F.when(post, v)).alias("my"), F.avg(F.when(post, t)).alias("mt"))
    return d.where("k >= 4").select("a_id", "arm", (F.col("my") - F.col("b0") - F.col("b1") * F.col("mt")).alias("d"))


def segmented_level_shift(long: DataFrame) -> DataFrame:
    """Coefficient of ``post`` in v ~ 1 + t + post (6+ points): moment sums and a closed-form solve."""
    d = long.where("t <> 0 and v is not null").withColumn("p", (F.col("t") > 0).cast("double"))
    t, p, v = F.col("t").cast("double"), F.col("p"), F.col("v")
    s = {"n": F.count(F.lit(1)).cast("double"), "t": F.sum(t), "p": F.sum(p), "tt": F.sum(t * t), "tp": F.sum(t * p),
         "y": F.sum(v), "ty": F.sum(t * v), "py": F.sum(p * v)}
    m = d.groupBy("a_id", "arm").agg(*[e.alias(f"s_{k}") for k, e in s.items()]).where("s_n >= 6")
    c = {k: F.col(f"s_{k}") for k in s}
    sol = solve([[c["n"], c["t"], c["p"]], [c["t"], c["tt"], c["tp"]], [c["p"], c["tp"], c["p"]]], [c["y"], c["ty"], c["py"]])
    return m.select("a_id", "arm", sol[2].alias("d"))


def behaviour_frame(idx: DataFrame, control: Column, p404: str = "p404_bi", min_days: int = MIN_DAYS) -> DataFrame:
    """One row with control means, sds and sample covariance of the three coordinates."""
    prof = (idx.where(control & (F.col("n") >= min_days)).groupBy("a_id").agg(
        F.avg(p404).alias("m1"), F.avg("robots_rate").alias("m2"), F.avg(F.log1p("hits")).alias("m3")))
    cov = [F.covar_samp(f"m{a}", f"m{b}").alias(f"v{a}{b}") for a in (1, 2, 3) for b in (1, 2, 3) if a <= b]
    base = [x for k in (1, 2, 3) for x in (F.avg(f"m{k}").alias(f"u{k}"), (F.stddev_pop(f"m{k}") + 1e-9).alias(f"s{k}"))]
    return prof.agg(*base, *cov)


def observability_variants(idx: DataFrame, control: Column, strict: Column) -> DataFrame:
    """Daily O under four definitions: base, Mahalanobis, without volume, strict control centroid.
    (The producer is not public; definitions follow from the published names.)"""
    f = behaviour_frame(idx, control)
    s = reference_frame(idx, strict).select(*[F.col(f"{a}{k}").alias(f"x{a}{k}") for a in "us" for k in (1, 2, 3)])
    d = idx.where(F.col("n") >= MIN_DAYS).crossJoin(F.broadcast(f)).crossJoin(F.broadcast(s))
    x = [F.col("p404_bi"), F.col("robots_rate"), F.log1p("hits")]
    z = [(x[k] - F.col(f"u{k+1}")) / F.col(f"s{k+1}") for k in range(3)]
    y = [(x[k] - F.col(f"xu{k+1}")) / F.col(f"xs{k+1}") for k in range(3)]
    e = [x[k] - F.col(f"u{k+1}") for k in range(3)]
    v = {(a, b): F.col(f"v{min(a, b)}{max(a, b)}") for a in (1, 2, 3) for b in (1, 2, 3)}
    sol = solve([[v[(a, b)] for b in (1, 2, 3)] for a in (1, 2, 3)], e)
    def norm(parts):
        return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return d.withColumns({"o_base": norm(z), "o_novol": norm(z[:2]), "o_strict_centroid": norm(y),
                          "o_maha": F.sqrt(F.greatest(sum((e[k] * sol[k] for k in (1, 2)), e[0] * sol[0]), F.lit(0.0)))})


def agent_observability(idx: DataFrame, frame: DataFrame, p404: str = "p404_bi") -> DataFrame:
    """O of the agent's mean vector against the mean of its daily O."""
    d = observability(idx, frame, p404).groupBy("a_id", "arm").agg(
        F.avg("o").alias("o_dailymean"), F.avg(p404).alias("m1"), F.avg("robots_rate").alias("m2"),
        F.avg(F.log1p("hits")).alias("m3"), F.count(F.lit(1)).alias("n_days"))
    z = [(F.col(f"m{k}") - F.col(f"u{k}")) / F.col(f"s{k}") for k in (1, 2, 3)]
    o = F.sqrt(z[0] * z[0] + z[1] * z[1] + z[2] * z[2])
    return d.crossJoin(F.broadcast(frame)).select("a_id", "arm", "n_days", o.alias("o_meanvec"), "o_dailymean")


def botness_axis(idx: DataFrame, bot: Column, control: Column, min_days: int = MIN_DAYS) -> DataFrame:
    """One row: control centroid and sd, unit vector towards the bot centroid, centroid distance."""
    side = F.when(bot, "bot").when(control, "control")
    prof = (idx.where((F.col("n") >= min_days) & side.isNotNull()).groupBy("a_id", side.alias("side")).agg(
        F.avg("p404").alias("m1"), F.avg("robots_rate").alias("m2"), F.avg(F.log1p("hits")).alias("m3")))
    def of(name, fn, k):
        return fn(F.when(F.col("side") == name, F.col(f"m{k}")))
    f = prof.agg(*[x for k in (1, 2, 3) for x in (
        of("control", F.avg, k).alias(f"u{k}"), (of("control", F.stddev_pop, k) + 1e-9).alias(f"s{k}"),
        of("bot", F.avg, k).alias(f"b{k}"))])
    for k in (1, 2, 3):
        f = f.withColumn(f"z{k}", (F.col(f"b{k}") - F.col(f"u{k}")) / F.col(f"s{k}"))
    norm = F.sqrt(F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2") + F.col("z3") * F.col("z3"))
    f = f.withColumn("bot_centroid_b", norm)
    return f.select(*[f"{a}{k}" for a in "us" for k in (1, 2, 3)],
                    *[(F.col(f"z{k}") / (F.col("bot_centroid_b") + 1e-9)).alias(f"axis{k}") for k in (1, 2, 3)], "bot_centroid_b")


def botness_series(idx: DataFrame, axis: DataFrame) -> DataFrame:
    """Projection of each day's behaviour on the axis."""
    x = [F.col("p404"), F.col("robots_rate"), F.log1p("hits")]
    b = sum(((x[k] - F.col(f"u{k+1}")) / F.col(f"s{k+1}") * F.col(f"axis{k+1}") for k in (1, 2)),
            (x[0] - F.col("u1")) / F.col("s1") * F.col("axis1"))
    return idx.crossJoin(F.broadcast(axis)).withColumn("b", b).drop(
        *[f"{a}{k}" for a in ("u", "s", "axis") for k in (1, 2, 3)], "bot_centroid_b")


def align_window_scores(idx: DataFrame, scores: DataFrame, length: int = 30) -> DataFrame:
    """Score of window w (rows w..w+length-1) lands on its last row; earlier rows stay NULL."""
    s = scores.select("a_id", (F.col("w") + length - 1).alias("i"), "score")
    return idx.join(s, ["a_id", "i"], "left")


def robots_engagement(idx: DataFrame, group: str, min_days: int = MIN_DAYS) -> DataFrame:
    """Share of agents with a robots day among those with enough days."""
    a = idx.groupBy("a_id", F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("days"), F.max(F.coalesce("robots_rate", F.lit(0.0))).alias("top"))
    a = a.withColumn("q", F.col("days") >= min_days)
    t = a.groupBy("grp").agg(F.count(F.lit(1)).alias("n_declared"), F.count_if("q").alias("n_qualifying"),
                             F.count_if(F.col("q") & (F.col("top") > 0)).alias("n_ever_robots"))
    t = t.withColumn("pct_ever_robots", 100 * F.col("n_ever_robots") / F.greatest("n_qualifying", F.lit(1)))
    def share(g):
        return F.max(F.when(F.col("grp") == g, F.col("pct_ever_robots")))
    ratio = t.agg(safe_div(share("declared"), share("abusive")).alias("declared_over_abusive"))
    return t.crossJoin(F.broadcast(ratio))


RESPONSE_FEATURES = ("evasion_index", "ip_ent", "dom_ent", "ctry_ent", "compliance", "request_diversity", "log_hits", "resistance")


def event_deltas(active: DataFrame, features: Sequence[str] = RESPONSE_FEATURES, keys: Sequence[str] = ("a_id", "label"),
                 width: int = W) -> DataFrame:
    """Agent means of post - pre and of |post - pre| over the agent's own day-to-day noise."""
    keys = list(keys)
    d = active if "log_hits" in active.columns else active.withColumn("log_hits", F.log1p("hits"))
    d = events.flag_pressure_events(d, gap=width, keys=keys)
    o, all_ = _w(keys), Window.partitionBy(*keys)
    d = d.withColumns({f"_s_{f}": F.col(f) - F.lag(f).over(o) for f in features})
    d = d.withColumns({f"_v_{f}": F.stddev_pop(f"_s_{f}").over(all_) for f in features} | {
        f"d_{f}": window_mean(f, "post", width, keys) - window_mean(f, "pre", width, keys) for f in features})
    d = d.where(F.col("kept") & events.eligible(width, width))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.avg(f"d_{f}").alias(f"d_{f}") for f in features],
        *[F.avg(F.abs(f"d_{f}") / (F.col(f"_v_{f}") + 1e-9)).alias(f"z_{f}") for f in features])


def curve_summary(curves: DataFrame, group: str) -> DataFrame:
    """Pooled mean and standard error per (group, feature, offset)."""
    return curves.groupBy(group, "feature", "t").agg(
        F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("sem"), F.count("value").alias("n"))


def aligned_profile(idx: DataFrame, group: str, value: str = "robots_rate", spacing: int = 11) -> DataFrame:
    """Event-aligned profile: agent means first, then population mean, SEM and agent count."""
    d = full_events(idx.where(F.col("n") >= MIN_DAYS), spacing)
    c = event_curves(d, "full", [value], ["a_id", group])
    agent = c.groupBy("a_id", group, "t").agg(F.avg("value").alias("v"))
    return agent.groupBy(F.col(group).alias("grp"), "t").agg(
        F.avg("v").alias("mean"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("sem"), F.count("v").alias("n_agents"))


def score_events(idx: DataFrame, scores: DataFrame, width: int = W, keys: Sequence[str] = ("a_id", "arm")) -> DataFrame:
    """Per pressure event: change of an external daily score and of resistance, arithmetic volume ratio."""
    d = events.flag_pressure_events(idx.join(scores, ["a_id", "date"], "left"), gap=width, keys=keys)

    def change(c):
        return window_mean(c, "post", width, keys) - window_mean(c, "pre", width, keys)
    d = d.withColumns({"d_score": change("score"), "d_resistance": change("resistance"),
                       "vol_ratio": safe_div(window_mean("hits", "post", width, keys), window_mean("hits", "pre", width, keys))})
    return d.where(F.col("kept") & events.eligible(width, width) & F.col("d_score").isNotNull()).select(
        "a_id", "arm", "i", "d_score", "d_resistance", "vol_ratio")


def pooled_units(ev: DataFrame) -> DataFrame:
    """Per agent and outcome the sum and number of events: a cluster bootstrap of event-pooled means
    needs nothing else."""
    stealth = F.col("vol_ratio") >= 0.5
    parts = {"score": F.col("d_score"), "score_stealth": F.when(stealth, F.col("d_score")), "resistance": F.col("d_resistance")}
    agent = ev.groupBy("a_id", "arm").agg(*[x for k, e in parts.items() for x in (F.sum(e).alias(f"s_{k}"), F.count(e).alias(f"k_{k}"))])
    cells = F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(f"s_{k}").alias("s"), F.col(f"k_{k}").alias("k")) for k in parts])
    return agent.select("a_id", "arm", F.explode(cells).alias("c")).select("a_id", "arm", "c.*")


def pooled_difference(units: DataFrame, a: str = "abusive", b: str = "verified", reps: int = REPLICATES) -> DataFrame:
    """Event-pooled difference of arm means with an agent-clustered interval, per outcome."""
    units = materialize(units)

    def arm(name, x):
        return F.sum(F.when(F.col("arm") == name, F.col(x)))
    def drawn(name):
        return arm(name, "s") / F.nullif(arm(name, "k"), F.lit(0.0))
    did = arm(a, "s") / arm(a, "k") - arm(b, "s") / arm(b, "k")
    point = units.groupBy("outcome").agg((arm(a, "s") / arm(a, "k")).alias("mean_a"), (arm(b, "s") / arm(b, "k")).alias("mean_b"),
                                         did.alias("did"), arm(a, "k").alias("n_a"), arm(b, "k").alias("n_b"))
    draws = replicate_sums(units, "a_id", ["outcome", "arm"], ["s", "k"], reps).groupBy("outcome", "rep").agg((drawn(a) - drawn(b)).alias("stat"))
    return point.join(draws.groupBy("outcome").agg(*interval()), "outcome", "left")


def monthly_observability(obs: DataFrame, group: str) -> DataFrame:
    """Mean O over agent-days and the number of agents per group and month."""
    return obs.groupBy(F.col(group).alias("grp"), F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.avg("o").alias("mean_o"), F.count_distinct("a_id").alias("n_agents"))


def monthly_slope(monthly: DataFrame) -> DataFrame:
    """Least-squares slope per month with and without the last month. A group holds one row per
    month, so its window is small."""
    w = Window.partitionBy("grp")
    d = monthly.withColumn("x", (F.row_number().over(w.orderBy("month")) - 1).cast("double")).withColumn("k", F.count(F.lit(1)).over(w))
    inner = F.col("x") < F.col("k") - 1
    t = d.groupBy("grp").agg(
        F.max("k").alias("n_months"), F.regr_slope("mean_o", "x").alias("slope"),
        F.regr_slope(F.when(inner, F.col("mean_o")), F.when(inner, F.col("x"))).alias("slope_excluding_last"),
        F.max("month").alias("last_month"))
    return t.withColumn("sign_reverses", F.signum("slope") != F.signum("slope_excluding_last"))


def variant_units(idx: DataFrame, control: Column, strict: Column, spacing: int = 16) -> DataFrame:
    """Agent effects under every definition of O, from one pass over the panel."""
    names = ("base", "maha", "novol", "strict_centroid")
    d = events.flag_block_events(observability_variants(idx, control, strict), {"kept": spacing})
    d = d.withColumns({f"d_{v}": frame_mean(f"o_{v}", 1, 5) - frame_mean(f"o_{v}", -10, -6) for v in names})
    d = d.where(F.col("kept") & events.eligible(LEAD, W))
    return d.groupBy("a_id", "arm").agg(*[F.avg(f"d_{v}").alias(v) for v in names]).unpivot(["a_id", "arm"], list(names), "variant", "d_o")
