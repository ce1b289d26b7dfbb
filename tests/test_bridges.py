"""Bridges without caps, with heavy keys dealt out in slices, against brute force; nothing dropped on the way."""
from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rebuff.operators import bridges as B, populations as R
from rebuff.sources import files

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(5)
    rows = [(a, 0) for a in range(0, 120, 3)] + [(a, u) for a in range(120) for u in rng.sample(range(1, 30), 3)]
    return sorted(set(rows) | {(7, 0), (7, 1)})


@pytest.mark.parametrize("heavy", [5, 1000])
def test_decoy_bridge_without_cap(spark, edges, monkeypatch, heavy):
    monkeypatch.setattr(B, "HEAVY", heavy)
    decoy = spark.createDataFrame([(a, u, 1) for a, u in edges] + [(200, 0, 0), (201, 5, None)], "uh_a_id long, uh_u_id long, uh_total long")
    deaths = spark.createDataFrame([(7, DAY), (3, DAY), (500, DAY)], "a_id long, t_death date")
    of, pop = defaultdict(set), defaultdict(int)
    for a, u in edges:
        of[a].add(u)
        pop[u] += 1
    got = {(r.a_death, r.a_succ): r for r in B.decoy_bridge(decoy, deaths, cap=None).collect()}
    want = {(d, a): of[d] & of[a] for d in (7, 3) for a in of if a != d and of[d] & of[a]}
    assert set(got) == set(want)
    for key, shared in want.items():
        r = got[key]
        assert (r.shared_hp, r.min_pop) == (len(shared), min(pop[u] for u in shared))
        assert r.rare_score == pytest.approx(sum(1 / pop[u] for u in shared))
        assert r.jaccard == pytest.approx(len(shared) / len(of[key[0]] | of[key[1]]))
    for d in (7, 3):
        order = sorted((k for k in want if k[0] == d), key=lambda k: (-round(got[k].rare_score, 9), k[1]))
        assert [got[k].rank for k in order] == list(range(1, len(order) + 1))
    capped = {(r.a_death, r.a_succ) for r in B.decoy_bridge(decoy, deaths, cap=30).collect()}
    assert capped == {k for k, shared in want.items() if any(pop[u] <= 30 for u in shared)}


def test_heavy_key_is_dealt_out(spark, monkeypatch):
    """One URL on a third of all agents: no slice of its links holds twice the median."""
    monkeypatch.setattr(B, "HEAVY", 100)
    n = 6000
    e = spark.range(n).select(F.col("id").alias("a_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("u"))
    e = B._sliced(e, "u", "a_id").where("u = 0")
    sizes = sorted(r["count"] for r in e.groupBy("slice").count().collect())
    assert sum(sizes) == n // 3 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("heavy", [5, 1000])
def test_ip_bridge_ranks_all(spark, edges, monkeypatch, heavy):
    monkeypatch.setattr(B, "HEAVY", heavy)
    ip = spark.createDataFrame([(u, a, 2024, 1, int(u == 2)) for a, u in edges] * 2, "i_name long, i_agent long, i_year int, i_month int, i_proxy int")
    deaths = spark.createDataFrame([(7, DAY)], "a_id long, t_death date")
    of = defaultdict(set)
    for a, u in edges:
        of[a].add(u)
    clean = of[7] - {2}
    got = {r.a_succ: r for r in B.ip_bridge(ip, deaths, k=2).collect()}
    want = {a: len(clean & of[a]) for a in of if a != 7 and clean & of[a]}
    assert {a: r.shared_ips for a, r in got.items()} == want
    shared = sorted(want, key=lambda a: (-want[a], a))
    assert [got[a].rank_shared for a in shared] == list(range(1, len(shared) + 1))
    core = {a: want[a] >= 3 and want[a] / len(clean) >= 0.5 for a in want}
    order = sorted(want, key=lambda a: (shared.index(a) >= 8, not core[a], -want[a], a))
    assert [got[a].rank for a in order] == list(range(1, len(order) + 1))


def test_register_names_deaths_without_candidates(spark):
    candidates = spark.createDataFrame([(1, 2)], "a_death long, a_succ long")
    deaths = spark.createDataFrame([(1, DAY), (9, DAY)], "a_id long, t_death date")
    series = spark.createDataFrame([(2, DAY + dt.timedelta(k), 1, 0.1) for k in range(20)], "a_id long, date date, hits long, b double")
    assert {tuple(r) for r in B.coverage_register(candidates, deaths, series).collect()} == {(1, 2, "evaluated"), (9, None, "no_candidate")}


def test_ids_beyond_the_limit_stay(spark):
    big = 2_147_483_648
    labels = spark.createDataFrame([(big, "human"), (5, "bot"), (5, "pothuman")], "a_id long, label string")
    arm = spark.createDataFrame([(big, 10, 20, 0.5), (5, 10, 20, 0.5)], "a_id long, decoy_hits long, a_totalhit long, share double")
    assert [r.a_id for r in R.arm_of_record(arm, labels).collect()] == [5]
    assert {(r.a_id, r.role, r.over_limit) for r in R.roster_v2(labels, arm).collect()} == {(big, "verified_human", True), (5, "abusive_share", False)}
    assert {(r.a_id, r.over_limit) for r in R.curated_labels(labels).collect()} == {(big, True), (5, False)}


def test_missing_ids_are_an_error(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "a_id long")
    none = spark.createDataFrame([], "a_id long, reason string")
    with pytest.raises(ValueError, match="3, 4$"):
        files.require_extracted(ids(1, 2, 3, 4), ids(1), ids(2), none)
    with pytest.raises(ValueError, match="4$"):
        files.require_extracted(ids(1, 4), ids(1), ids(2), spark.createDataFrame([(4, None)], "a_id long, reason string"))
    done = files.require_extracted(ids(1, 2, 3), ids(1), ids(2), spark.createDataFrame([(3, "timed out")], "a_id long, reason string"))
    assert {r.outcome: r.n_ids for r in done.collect()} == {"cached": 1, "fetched": 1, "empty": 1}


def test_samples_are_filters_on_a_rank(spark):
    df = spark.range(50).withColumnRenamed("id", "a_id").withColumn("g", F.col("a_id") % 2)
    order = {r.a_id: r.draw for r in R.draw_order(df).collect()}
    assert sorted(order.values()) == list(range(1, 51))
    assert {r.a_id for r in R.seeded_sample(df, 7).collect()} == {a for a, k in order.items() if k <= 7}
    assert {r.g: r["count"] for r in R.stratified_sample(df, "g", 4).groupBy("g").count().collect()} == {0: 4, 1: 4}


def test_window_stats_against_sums(spark):
    rng = random.Random(8)
    rows = sorted({(a, rng.randrange(60)): None for a in (1, 2, 3) for _ in range(30)})
    rows = [(a, DAY + dt.timedelta(d), rng.randrange(9), rng.choice([None, rng.random()])) for a, d in rows]
    series = spark.createDataFrame(rows + [(9, DAY, 1, 0.5)], "a_id long, date date, hits long, b double")
    wanted = [(a, DAY + dt.timedelta(d)) for a in (1, 2, 3, 4) for d in (-20, 0, 5, 14, 30, 59, 90)]
    got = {(r.a_id, r.t): r for r in B.date_window_stats(series, spark.createDataFrame(wanted * 2, "a_id long, t date")).collect()}
    assert set(got) == set(wanted)
    for (a, t), r in got.items():
        for tag, lo, hi in (("pre", -14, 0), ("post", 0, 14)):
            own = [x for x in rows if x[0] == a and lo <= (x[1] - t).days < hi]
            b = [x[3] for x in own if x[3] is not None]
            assert r[f"n_{tag}"] == len(own) and r[f"v_{tag}"] == pytest.approx(math.log1p(sum(x[2] for x in own)))
            assert r[f"b_{tag}"] is None if not b else r[f"b_{tag}"] == pytest.approx(sum(b) / len(b))
