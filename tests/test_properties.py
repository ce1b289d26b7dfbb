"""Planted fixtures and brute-force checks."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebuff.functions.distributed import exact_quantiles, number_units, ranked_values
from rebuff.functions.resample import mean_difference, multiplicities
from rebuff.operators import bridges as B, contract as Q, events as E, inference as I, leadlag as L, windows as W

DAY0 = dt.date(2020, 1, 1)


def test_thinning_is_greedy(spark):
    got = spark.createDataFrame([([0, 4, 5, 9, 10, 15],)], "c array<long>").select(E.thin_indices(F.col("c"), 5)).first()[0]
    assert got == [0, 5, 10, 15]


def test_quantiles_and_ranks_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(400, 3.0), rng.normal(size=800)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v)) for v in x[:7]], "g string, x double")
    got = {r.g: r for r in exact_quantiles(df, "x", {"p10": 0.1, "m": 0.5, "p97": 0.975}, ["g"]).collect()}
    for g, v in (("a", x), ("b", x[:7])):
        assert np.allclose([got[g].p10, got[g].m, got[g].p97], np.quantile(v, [0.1, 0.5, 0.975]))
        assert got[g].n == len(v)
    before = {(r.g, r.x): r.n_before for r in ranked_values(df, "x", ["g"]).collect()}
    assert all(before["a", v] == (x < v).sum() for v in x)


def test_units_are_numbered_densely(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"))
    rows = number_units(df, "k", ["g"]).collect()
    for g in "012":
        part = sorted(r.idx for r in rows if r.g == g)
        assert part == list(range(len(part)))


def test_replicate_weights_are_poisson_and_follow_the_cluster(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("k"), F.lit("g").alias("g"), F.col("id").alias("row"))
    w = multiplicities(df, "k", ["g"], reps=10).toPandas()
    assert set(w.rep) == set(range(1, 11))
    assert w.groupby(["rep", "k"])._w.nunique().max() == 1 and w.groupby(["rep", "k"]).size().eq(2).all()
    counts = w._w.value_counts() / 40_000
    for k, p in ((1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert abs(counts[k] - p) < 0.01
    assert abs(w._w.sum() / 40_000 - 1) < 0.02


def test_did_needs_five_per_arm_and_is_antisymmetric(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 7)) for i in range(40)]
    u = spark.createDataFrame(rows, "a_id long, arm string, x double")
    one, two = (mean_difference(u, "a_id", "x", "arm", p, q, reps=50).first() for p, q in (("a", "b"), ("b", "a")))
    assert one.did == pytest.approx(-two.did) and one.ci_lo == pytest.approx(-two.ci_hi)
    few = mean_difference(u.where("a_id < 8"), "a_id", "x", "arm", "a", "b", reps=10).first()
    assert few.did is None and few.sig is False


def test_kendall_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    series = {k: rng.integers(0, 3 + 5 * k, size=40 + k) for k in range(4)}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k long, i long, value double")
    for r in I.mann_kendall(df, ["k"]).collect():
        x = series[r.k]
        s = sum(np.sign(x[j] - x[i]) for i in range(len(x)) for j in range(i + 1, len(x)))
        t = np.unique(x, return_counts=True)[1]
        n0 = len(x) * (len(x) - 1) / 2
        assert r.tau == pytest.approx(s / np.sqrt(n0 * (n0 - (t * (t - 1) / 2).sum())))


def test_step_is_found(spark):
    df = spark.createDataFrame([(1, i, float(i >= 20)) for i in range(40)], "k long, i long, value double")
    r = I.pettitt(df, ["k"]).first()
    assert r.location == 19 and r.significant


def test_lag_three_is_found(spark):
    rng = np.random.default_rng(3)
    f = rng.random(303)
    rows = [(1, i, float(f[i]), float(f[i + 3])) for i in range(300)]
    p = L.peaks(L.ccf(spark.createDataFrame(rows, "a_id long, i long, r double, f double"))).first()
    assert p.post_lag == 3 and p.responder


def test_kaplan_meier_is_monotone_and_censors_the_boundary(spark):
    lags = [("g", t) for t in range(1, 14)] + [("g", 14)] * 13
    km = I.kaplan_meier(spark.createDataFrame(lags, "g string, lag long"), "g").orderBy("t").collect()
    s = [r.s for r in km]
    assert len(km) == 13 and all(a >= b for a, b in zip(s, s[1:])) and min(s) >= 0.5 - 1e-12


def test_caliper_match_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 300
    rows = [(i, "x", i, float(rng.random()), float(rng.normal() * (0.01 if i % 3 else 1)), float(rng.normal()), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "a_id long, arm string, i long, intensity double, pre_o double, pre_logvol double, d_o double")
    got = I.caliper_match(df).first()
    a = np.array([r[3:] for r in rows])
    heavy = a[:, 0] > np.median(a[:, 0])
    z = a[:, 1:3] / np.sqrt((a[heavy, 1:3].var(0, ddof=1) + a[~heavy, 1:3].var(0, ddof=1)) / 2)
    d = np.linalg.norm(z[heavy][:, None] - z[~heavy][None], axis=2)
    keep = d.min(1) <= 0.2
    want = a[heavy, 3][keep].mean() - a[~heavy, 3][d.argmin(1)[keep]].mean()
    assert got.n_matched == keep.sum() and got.matched_gap == pytest.approx(want)


def test_bins_partition(spark):
    df = spark.createDataFrame([(v,) for v in (5, 6, 25, 26, 100, 101)], "v long")
    r = Q.partition_check(df, "v", B.BINS).first()
    assert r.is_partition and r.exactly_one == 6


def test_block_rule_is_strict_and_counts_rate_limits(spark):
    rows = [(1, DAY0 + dt.timedelta(i), 10, 5 if i == 3 else 0, 1 if i == 7 else 0) for i in range(10)]
    rows += [(2, DAY0 + dt.timedelta(i), 10, 2, 0) for i in range(10)]
    idx = W.index_days(spark.createDataFrame(rows, "a_id long, date date, hits long, cblock long, c429 long"))
    assert [(r.a_id, r.i) for r in E.block_candidates(idx).orderBy("i").collect()] == [(1, 3), (1, 7)]


def test_bad_ids_are_refused(spark):
    df = spark.createDataFrame([(x,) for x in (None, "1.5", "0", "7", "7", "true")], "id_text string")
    assert {r.reason: r.n for r in Q.id_list_check(df).collect()} == {"null": 1, "fractional": 1, "non_positive": 1, "boolean": 1, "duplicate": 1}
