"""Planted structure that the estimators must find, and registries that two writers publish to."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebuff.operators import bridges as B, contract as Q, inference as I, panel as P, trajectory as C
from rebuff.session import materialize, scratch_path
from rebuff.sources import files

#: Where the three planted strategies lie.
CENTRES = {"visible": {"log_hits": 6.0, "p200": 0.9}, "evasive": {"evasion_index": 0.9, "ip_ent": 0.9, "url_ent": 0.9, "log_hits": 3.0, "p200": 0.5},
           "mimicry": {"husource": 0.9, "p200": 0.2, "log_hits": 1.0}}


def planted_profiles(spark, n=80):
    rng = np.random.default_rng(1)
    rows = []
    for k, (name, centre) in enumerate(CENTRES.items()):
        for a in range(n):
            rows.append((1000 * k + a, "bot" if a % 2 else "human", name, *[float(centre.get(f, 0.1) + rng.normal(0, 0.05)) for f in C.PROFILE], 90))
    return spark.createDataFrame(rows, "a_id long, label string, planted string, " + ", ".join(f"{f} double" for f in C.PROFILE) + ", n_active long")


def test_mixture_recovers_three_strategies(spark):
    prof = materialize(planted_profiles(spark))
    model, comp = C.strategy_mixture(prof)
    comp = materialize(comp)
    names = C.name_components(comp)
    found = {(r.planted, r.strategy): r["count"] for r in comp.join(F.broadcast(names), "component").groupBy("planted", "strategy").count().collect()}
    assert found == {(s, s): 80 for s in CENTRES}
    mix = C.strategy_mix(comp, names, ["label"]).collect()
    assert all(r.visible + r.evasive + r.mimicry == pytest.approx(1) and r.visible == pytest.approx(1 / 3) for r in mix)
    # Stages keep to the whole profiles' scale and components; agents with too few days have none.
    stages = prof.drop("n_active").crossJoin(spark.createDataFrame([("early", 30), ("mid", 30), ("late", 30)], "stage string, n_active long"))
    stages = stages.withColumn("n_active", F.when(F.col("a_id") % 10 == 0, 5).otherwise(F.col("n_active")))
    staged = C.stage_components(model, prof, stages).join(F.broadcast(names), "component")
    assert staged.where("planted <> strategy").count() == 0
    assert staged.count() == 3 * 3 * 72
    by_stage = C.strategy_mix(staged.drop("strategy"), names, ["stage"]).collect()
    assert len(by_stage) == 3 and all(r.evasive == pytest.approx(1 / 3) for r in by_stage)


def test_planted_handoff(spark):
    rng = np.random.default_rng(2)
    day0 = dt.date(2024, 1, 1)
    rows = [(a, day0 + dt.timedelta(k), int(rng.integers(5, 50)), float(a) / 10 + rng.normal(0, 0.01)) for a in range(8) for k in range(160)]
    series = spark.createDataFrame(rows, "a_id long, date date, hits long, b double")
    r = B.planted_handoff(series, F.col("a_id") >= 0).first()
    assert r.n_planted == 8 and r.dA_v_mean < -3 and r.dB_v_mean > 3 and r.dB_v_placebo_mean == 0
    assert r.frac_ramp == 1 and r.b_corr > 0.9 and abs(r.b_transfer_bias) < 0.02


def test_autocorrelation_that_never_falls_is_marked(spark):
    slow = [(1, i, float(np.sin(i / 400))) for i in range(500)]
    fast = [(2, i, float(i % 2)) for i in range(500)]
    got = {r.k: r for r in I.autocorr_time(spark.createDataFrame(slow + fast, "k long, i long, value double"), ["k"]).collect()}
    assert (got[1].adaptation_time, got[1].censored) == (100, True) and (got[2].adaptation_time, got[2].censored) == (1, False)


def test_sketches_have_names_of_their_own(spark):
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 200, 5, 1, 1, "HU")], "h_a_id long, h_ts timestamp, h_status int, h_u_id long, h_i_id long, h_d_id long, h_ccode string")
    assert {"approx_n_ip", "approx_n_url"} <= set(P.daily_rollup_spread(log, approx=True).columns)
    assert "n_ip" in P.daily_rollup_spread(log).columns


def pins(spark, **kv):
    return spark.createDataFrame([(k, d, n) for k, (d, n) in kv.items()], "key string, digest string, n long")


def test_registry_refuses_the_second_writer(spark):
    path = scratch_path(spark, "registry")
    assert files.read_registry(spark, path) == (None, 0)
    assert files.publish_registry(spark, pins(spark, a=("x", 1)), path, 0) == 1
    mine, seen = files.read_registry(spark, path)
    theirs, also = files.read_registry(spark, path)
    plan = Q.planned_registry(pins(spark, a=("y", 1), b=("z", 2)), mine)
    assert files.publish_registry(spark, plan, path, seen) == 2
    with pytest.raises(files.RegistryChanged):
        files.publish_registry(spark, theirs, path, also)
    now, version = files.read_registry(spark, path)
    assert version == 2 and {tuple(r) for r in now.collect()} == {("a", "x", 1), ("b", "z", 2)}
    replaced = Q.planned_registry(pins(spark, a=("y", 3)), now, replace=True)
    assert files.publish_registry(spark, replaced, path, version) == 3
    assert {tuple(r) for r in files.read_registry(spark, path)[0].collect()} == {("a", "y", 3), ("b", "z", 2)}


def test_registry_claim_is_exclusive(spark):
    """Both writers pass the check of the version; the claim decides."""
    path = scratch_path(spark, "registry")
    files.publish_registry(spark, pins(spark, a=("x", 1)), path, 0)
    fs, at = files._file_system(spark, path)
    fs.create(at(f"{path}/_claim-v2"), False).close()
    with pytest.raises(files.RegistryChanged):
        files.publish_registry(spark, pins(spark, a=("y", 1)), path, 1)
    assert files.read_registry(spark, path)[1] == 1
