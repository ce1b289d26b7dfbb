"""Both ranks of the address bridge from one sort."""
from datetime import date

import numpy as np
from pyspark.sql import Window, functions as F

from rebuff.operators import bridges as B


def test_ranks_and_footprint(spark):
    rng = np.random.default_rng(2)
    rows = [(int(n), int(a), int(n % 10 == 0)) for a in range(90) for n in rng.choice(40, rng.integers(2, 38), replace=False)]
    ip = spark.createDataFrame(rows + [(None, 0, 0), (None, 3, 0), (10, 0, 0)], "i_name long, i_agent long, i_proxy int").cache()
    deaths = spark.createDataFrame([(a, date(2024, 1, 1)) for a in (0, 7, 50)], "a_id long, t_death date")
    for k in (1, 2, 12, 30):
        got = B.ip_bridge(ip, deaths, k).cache()
        by = Window.partitionBy("a_death")
        again = got.withColumns({
            "s": F.row_number().over(by.orderBy(F.desc("shared_ips"), F.asc("a_succ"))),
            "r": F.row_number().over(by.orderBy(F.desc(F.col("rank_shared") <= 4 * k), F.desc("in_core"), F.desc("shared_ips"), F.asc("a_succ")))})
        assert again.where("s <> rank_shared or r <> rank").count() == 0 and got.count() > 100
        assert 0 < got.where("in_core = 1").count() < got.count()
        size = {r.a_id: r.n_ip for r in B.ip_footprint(ip).collect()}
        assert all(abs(r.overlap_frac - r.shared_ips / size[r.a_death]) < 1e-12 for r in got.collect())


def test_one_sort_serves_both_ranks(spark):
    ip = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "i_name long, i_agent long, i_proxy int")
    deaths = spark.createDataFrame([(1,)], "a_id long")
    plan = B.ip_bridge(ip, deaths)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "DESC" in x]
    assert len({x[x.index("], ["):] for x in windows}) == 1
