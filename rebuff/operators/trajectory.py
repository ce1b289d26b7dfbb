"""Trajectories, strategy mixtures and calibration over feature series."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from rebuff.functions.distributed import exact_quantiles
from rebuff.functions.expressions import unpivot
from rebuff.operators import inference as I
from rebuff.session import materialize

TEST_FEATURES = ("evasion_index", "ip_ent", "dom_ent", "ctry_ent", "url_ent", "resistance", "compliance", "p404",
                 "img", "html", "js", "php", "folder")
PROFILE = ("log_hits", "p200", "evasion_index", "ip_ent", "url_ent", "robots", "html", "php", "activity_rate", "husource")
STRATEGIES = ("evasive", "visible", "mimicry")


def global_scaler(active: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: mean m_<f> and population sd s_<f> (0 becomes 1) over pooled active days."""
    return active.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[
        F.when(F.stddev_pop(f) == 0, 1.0).otherwise(F.stddev_pop(f)).alias(f"s_{f}") for f in features])


def lifecycle_drift(active: DataFrame, scaler: DataFrame, features: Sequence[str], keys: Sequence[str], frac: float = 0.2,
                    min_n: int = 30) -> DataFrame:
    """Distance between the standardised centroids of the first and last fifth of active days."""
    k = F.greatest(F.lit(1), F.floor(F.lit(frac) * F.col("n")))
    early, late = F.col("i") < k, F.col("i") >= F.col("n") - k
    d = active.where(F.col("n") >= min_n).groupBy(*keys).agg(*[
        (F.avg(F.when(late, F.col(f))) - F.avg(F.when(early, F.col(f)))).alias(f"_d_{f}") for f in features])
    d = d.crossJoin(F.broadcast(scaler))
    parts = [F.pow(F.col(f"_d_{f}") / F.col(f"s_{f}"), 2) for f in features]
    return d.select(*keys, F.sqrt(sum(parts[1:], parts[0])).alias("lifecycle_drift"))


def medians(df: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Exact medians of several columns per group, one output column each."""
    long = unpivot(df, list(by), list(columns), "_c", "_x").where("_x is not null")
    q = exact_quantiles(long, "_x", {"m": 0.5}, [*by, "_c"])
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == c, F.col("m"))).alias(n) for c, n in columns.items()])


def trajectory_metrics(active: DataFrame, features: Sequence[str], keys: Sequence[str], min_n: int = 30) -> DataFrame:
    """Drift, adaptation time, oscillation and period of the evasion index per agent."""
    keys = list(keys)
    active = materialize(active.where(F.col("n") >= min_n))
    long = active.select(*keys, "i", F.col("evasion_index").alias("value"))
    drift = lifecycle_drift(active, global_scaler(active, features), features, keys, min_n=min_n)
    arrays = materialize(I.series_arrays(long, keys))
    return drift.join(I.autocorr_time_of(arrays, keys).drop("n"), keys).join(I.periodicity_of(arrays, keys), keys)


def trajectory_summary(metrics: DataFrame, group: str) -> DataFrame:
    m = materialize(metrics)
    med = medians(m, [group], {"lifecycle_drift": "median_drift", "adaptation_time": "median_adaptation_time", "osc_period": "median_osc_period"})
    n = m.groupBy(group).agg(F.count(F.lit(1)).alias("n_agents"), (100 * F.avg((F.col("oscillation") > 0.25).cast("double"))).alias("pct_oscillatory"))
    return n.join(med, group)


def agent_profile(active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ten-feature profile; activity rate is active days over the spanned days."""
    means = [f for f in PROFILE if f not in ("log_hits", "activity_rate")]
    span = F.greatest(F.lit(1), F.max("day") - F.min("day") + 1)
    return active.groupBy(*keys).agg(
        F.log1p(F.avg("hits")).alias("log_hits"), *[F.avg(f).alias(f) for f in means],
        (F.count(F.lit(1)) / span).alias("activity_rate"), F.count(F.lit(1)).alias("n_active"))


def standardise(profiles: DataFrame, features: Sequence[str] = PROFILE) -> DataFrame:
    """Population-sd scaling by hand: the ML scaler divides by the sample sd."""
    return _scaled(profiles, global_scaler(profiles, features), features)


def _scaled(profiles: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    return profiles.crossJoin(F.broadcast(scaler)).withColumns(
        {f"z_{f}": (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for f in features}).drop(*[f"{a}_{f}" for a in "ms" for f in features])


def strategy_mixture(profiles: DataFrame, k: int = 3, seed: int = 42, features: Sequence[str] = PROFILE, starts: int = 5):
    """Full-covariance Gaussian mixture on standardised profiles: (model, profiles with component). Fitting begins at
    random, so the likeliest of ``starts`` models counts."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    z = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_vec").transform(materialize(standardise(profiles, features)))
    z = materialize(z, "vectors")
    fitted = [GaussianMixture(featuresCol="_vec", k=k, seed=seed + s, predictionCol="component", probabilityCol="_prob").fit(z) for s in range(starts)]
    model = max(fitted, key=lambda m: m.summary.logLikelihood)
    return model, model.transform(z).drop("_vec", "_prob")


def name_components(profiles: DataFrame) -> DataFrame:
    """(component, strategy): evasive claims its best component first, then visible, then mimicry.
    Everything after the centroids is a table of at most a few components."""
    c = profiles.groupBy("component").agg(*[F.avg(f).alias(f) for f in PROFILE])
    w = Window.partitionBy()
    z = c.select("component", *[((F.col(f) - F.avg(f).over(w)) / (F.stddev_pop(f).over(w) + 1e-9)).alias(f) for f in PROFILE])
    z = z.select("component", (F.col("evasion_index") + F.col("ip_ent") + F.col("url_ent")).alias("evasive"),
                 (F.col("log_hits") + F.col("p200") - F.col("evasion_index")).alias("visible"),
                 (-F.col("log_hits") + F.col("husource") - F.col("p200")).alias("mimicry"))
    free = F.lit(True)
    taken = []
    for s in STRATEGIES:
        score = F.when(free, F.struct(F.col(s).alias("s"), (-F.col("component")).alias("c")))
        z = z.withColumn(f"_b_{s}", -F.max(score).over(w)["c"])
        taken.append(F.col("component") == F.col(f"_b_{s}"))
        free = free & ~taken[-1]
    name = F.when(taken[0], "evasive").when(taken[1], "visible").when(taken[2], "mimicry").otherwise("visible")
    return z.select("component", name.alias("strategy"))


def strategy_mix(profiles: DataFrame, names: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each strategy per class; strategies nobody follows are 0."""
    d = profiles.join(F.broadcast(names), "component")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col("strategy") == s).cast("double")).alias(s) for s in ("visible", "evasive", "mimicry")])


def lifecycle_thirds(active: DataFrame) -> DataFrame:
    """Adds stage early / mid / late by row order."""
    n, i = F.col("n"), F.col("i")
    return active.withColumn("stage", F.when(i < F.floor(n / 3), "early").when(i < F.floor(2 * n / 3), "mid").otherwise("late"))


def stage_components(model, profiles: DataFrame, stages: DataFrame, min_days: int = 60, features: Sequence[str] = PROFILE) -> DataFrame:
    """``stages`` (profiles per agent and stage) with the component that the mixture of the whole ``profiles`` gives
    them, on that mixture's scale. Agents with fewer active days than ``min_days`` over all stages have no stages worth comparing."""
    from pyspark.ml.feature import VectorAssembler
    w = Window.partitionBy("a_id", "label")
    d = stages.withColumn("_days", F.sum("n_active").over(w)).where(F.col("_days") >= min_days).drop("_days")
    d = _scaled(d, global_scaler(profiles, features), features)
    return model.transform(VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_vec").transform(d)).drop("_vec", "_prob")


def volume_volatility(active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CV, burst share and decorrelation time of log volume per agent."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    d = active.withColumns({"_m": F.avg("hits").over(w), "_s": F.stddev_pop("hits").over(w)})
    a = d.groupBy(*keys).agg((F.max("_s") / (F.max("_m") + 1e-9)).alias("volume_cv"),
                             F.avg((F.col("hits") > F.col("_m") + 2 * F.col("_s")).cast("double")).alias("burst_frac"))
    t = I.autocorr_time(active.select(*keys, "i", F.log1p("hits").alias("value")), keys).drop("n")
    return a.join(t.withColumnsRenamed({"adaptation_time": "volume_autocorr_time", "censored": "volume_autocorr_censored"}), keys)


def nonstationarity(active: DataFrame, features: Sequence[str] = TEST_FEATURES, keys: Sequence[str] = ("a_id", "label")) -> DataFrame:
    """Per agent and feature: trend direction, tau, change point, effect and place in life."""
    keys = [*keys, "feature"]
    long = materialize(unpivot(active, [k for k in keys if k != "feature"] + ["i"], list(features)))
    return I.mann_kendall(long, keys).join(_changepoints(long, keys), keys)


def _changepoints(long: DataFrame, keys: list[str]) -> DataFrame:
    return I.changepoint_effect(long, materialize(I.pettitt(long, keys)), keys)


def changepoints(active: DataFrame, features: Sequence[str] = TEST_FEATURES, keys: Sequence[str] = ("a_id", "label")) -> DataFrame:
    """The change-point half of ``nonstationarity``, without trends."""
    keys = [*keys, "feature"]
    return _changepoints(materialize(unpivot(active, [k for k in keys if k != "feature"] + ["i"], list(features))), keys)


def nonstationarity_summary(per_agent: DataFrame, group: str = "label") -> DataFrame:
    p = materialize(per_agent.withColumn("abs_tau", F.abs("tau")))
    by = [group, "feature"]
    def pct(cond):
        return 100 * F.avg(cond.cast("double"))
    t = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_agents"), pct(F.col("direction") == 1).alias("pct_trend_up"),
                           pct(F.col("direction") == -1).alias("pct_trend_down"), pct(F.col("direction") != 0).alias("pct_any_trend"),
                           pct(F.col("significant")).alias("pct_changepoint"))
    med = medians(p, by, {"abs_tau": "median_abs_tau", "cp_effect": "median_cp_effect"})
    return t.join(med, by, "left")


def trend_fingerprint(summary: DataFrame, a: str = "bot", b: str = "human", k: int = 4) -> DataFrame:
    """Features by difference in % trending up (and net up - down); flags the k at each end. The
    table has one row per feature."""
    def of(label, c):
        return F.max(F.when(F.col("label") == label, F.col(c)))
    d = summary.groupBy("feature").agg((of(a, "pct_trend_up") - of(b, "pct_trend_up")).alias("diff_up"),
                                       ((of(a, "pct_trend_up") - of(a, "pct_trend_down"))
                                        - (of(b, "pct_trend_up") - of(b, "pct_trend_down"))).alias("diff_net")).where("diff_up is not null")
    w = Window.partitionBy()
    top = F.row_number().over(w.orderBy(F.desc("diff_up"), "feature"))
    low = F.row_number().over(w.orderBy("diff_up", "feature"))
    return d.withColumns({"in_top": top <= k, "in_bottom": low <= k})


def any_trend_rate(per_agent: DataFrame, keys: Sequence[str] = ("a_id", "label"), group: str = "label") -> DataFrame:
    a = per_agent.groupBy(*keys).agg(F.max((F.col("direction") != 0).cast("double")).alias("_any"))
    return a.groupBy(group).agg((100 * F.avg("_any")).alias("pct_with_any_trend"), F.count(F.lit(1)).alias("n_agents"))


def changepoint_timing(per_agent: DataFrame, feature: str = "evasion_index", bins: int = 20, group: str = "label") -> DataFrame:
    """Histogram of significant change points over life, per class."""
    d = per_agent.where((F.col("feature") == feature) & F.col("significant") & F.col("cp_frac").isNotNull())
    return d.groupBy(group, F.least(F.floor(F.col("cp_frac") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sequence_windows(series: DataFrame, features: Sequence[str], length: int = 30) -> DataFrame:
    """Sliding windows of the feature vector, one row per complete window, for downstream scoring."""
    w = Window.partitionBy("a_id").orderBy("day").rowsBetween(0, length - 1)
    vec = F.array(*[F.col(f).cast("double") for f in features])
    d = series.withColumns({"_v": F.collect_list(vec).over(w), "last_day": F.max("day").over(w)})
    return d.where(F.size("_v") == length).select("a_id", F.col("day").alias("w"), "last_day", F.flatten("_v").alias("sequence"))
