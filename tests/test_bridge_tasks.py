"""Links and pairs of the bridges: more rows make more tasks, not larger ones, and the pairs are those of both bridges."""
from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from rebuff.operators import bridges as B
from rebuff.sources.views import Views


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 100, raising=False)
    pairs = spark.range(4000).select((F.col("id") % 50).alias("a_death"), F.col("id").alias("a_succ"), F.lit("ip").alias("bridge"))
    got = B.pair_dedup(pairs.union(pairs.withColumn("bridge", F.lit("decoy"))), [F.asc("bridge")])
    assert {(r.a_death, r.a_succ, r.bridge) for r in got.collect()} == {(k % 50, k, "decoy") for k in range(4000)}
    assert max(sizes(got)) < 200


def test_tasks_grow_with_the_links(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(B, "TASK_ROWS", 100, raising=False)
    rng = random.Random(3)
    spark.createDataFrame([(a, u) for a in range(400) for u in rng.sample(range(1000), 10)], "a_id long, u long").write.parquet(str(tmp_path / "e"))
    e = B._sliced(spark.read.parquet(str(tmp_path / "e")), "u", "a_id")
    assert sum(sizes(e)) == 4000 and max(sizes(e)) < 400
    dead = e.where("a_id < 100").withColumnRenamed("a_id", "a_death")
    linked = B._linked(dead.select("a_death", "u", "pop", "slice"), e, "u")
    assert sum(sizes(linked)) > 3000 and max(sizes(linked)) < 400


@pytest.mark.parametrize("heavy", [5, 1000])
def test_candidates_are_those_of_both_bridges(spark, monkeypatch, heavy):
    monkeypatch.setattr(B, "HEAVY", heavy)
    rng = random.Random(4)
    rows = [(a, 0) for a in range(0, 90, 3)] + [(a, u) for a in range(90) for u in rng.sample(range(1, 60), 2)]
    decoy = spark.createDataFrame([(a, u, int(u != 4)) for a, u in rows] + [(3, None, 1), (5, None, 1), (None, 0, 1)], "uh_a_id long, uh_u_id long, uh_total long")
    ip = spark.createDataFrame([(f"i{u % 50}", a, int(u % 7 == 0)) for a, u in rows] * 2 + [(None, 3, 0), (None, 8, 0), ("i1", None, 0)], "i_name string, i_agent long, i_proxy int")
    deaths = spark.createDataFrame([(a, date(2024, 1, 1)) for a in (0, 3, 7, 500)], "a_id long, t_death date")
    want = {(r.a_death, r.a_succ, name) for name, d in (("decoy", B.decoy_bridge(decoy, deaths, 20)), ("ip", B.ip_bridge(ip, deaths))) for r in d.collect()}
    got = [tuple(r) for r in B.candidate_pairs(decoy, ip, deaths, 20).collect()]
    of = lambda key: {a: {v for v, b in key if b == a} for _, a in key}
    urls, pop = of([(u, a) for a, u in rows if u != 4]), {}
    for have in urls.values():
        for u in have:
            pop[u] = pop.get(u, 0) + 1
    pop[0] += 1         # the agent without an id
    ips, clean = of([(u % 50, a) for a, u in rows]), of([(u % 50, a) for a, u in rows if u % 7 != 0])
    unclean = lambda a: {n for n in ips[a] if all(u % 7 == 0 for x, u in rows if x == a and u % 50 == n)}
    brute = {(d, a, "decoy") for d in (0, 3, 7) for a in urls if a != d and any(pop[u] <= 20 for u in urls.get(d, set()) & urls[a])}
    brute |= {(d, a, "ip") for d in (0, 3, 7) for a in ips if a != d and (ips[d] - unclean(d)) & ips[a]}
    assert set(got) == want == brute and len(got) == len(want) > 40


def test_bot_deaths_without_the_stored_panel(spark, monkeypatch):
    """The same deaths, and the agents' days in as many tasks as the line items need."""
    monkeypatch.setattr(B, "TASK_ROWS", 1000, raising=False)
    v = Views(spark, "/root/testdata/sf0.01")
    got = v.lone_bot_deaths
    assert "sidx" not in v.__dict__ and "hashpartitioning(a_id" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert ", 60), REPARTITION_BY_NUM" in plan
    want = {tuple(r) for r in v.bot_deaths.collect()}
    assert {tuple(r) for r in got.collect()} == want and want
