"""The pool of unrelated dates holds one row per successor, whatever the number of dates."""
import datetime as dt

import numpy as np

from rebuff.operators import bridges as B

D0 = dt.date(2024, 1, 1)


def test_one_row_per_successor(spark):
    day = lambda k: D0 + dt.timedelta(days=k)
    days = {1: list(range(40, 60)), 2: list(range(0, 5))}
    series = spark.createDataFrame([(a, day(k), 1 + k % 7, 0.5) for a, ks in days.items() for k in ks], "a_id long, date date, hits long, b double")
    died = [(100 + k, day(t)) for k, t in enumerate((0, 30, 45, 45, 50, 58, 90))]
    deaths = spark.createDataFrame(died, "a_id long, t_death date")
    pairs = spark.createDataFrame([(102, 1, day(45), 1), (100, 2, day(0), 0), (106, 3, day(90), 0)], "a_death long, a_succ long, t_A date, in_core int")
    pool = B.null_pool(pairs, deaths, series)
    got = {r.a_succ: r for r in pool.collect()}
    assert pool.count() == len(got) == 3
    for a, linked in ((1, 45), (2, 0), (3, 90)):
        c = d = 0
        dv, upto = [], []
        for t, n in ((0, 1), (30, 1), (45, 2), (50, 1), (58, 1), (90, 1)):
            if t == linked:
                continue
            v = [sum(1 + k % 7 for k in days.get(a, []) if lo <= k < lo + 14) for lo in (t - 14, t)]
            c += n
            if not any(t - 14 <= k < t + 14 for k in days.get(a, [])):
                d += n
            else:
                dv.append(np.log1p(v[1]) - np.log1p(v[0]))
                upto.append(n + (upto[-1] if upto else 0))
        r = got[a]
        assert (r.c, r.d, r.ok, r.upto) == (c, d, len(dv), upto)
        assert np.allclose(r.dv, dv)
    null = {(r.stratum, r.dates): r for r in B.link_permutation_null(pool, pairs, 50).collect()}
    assert set(null) == {(s, d) for s in ("core", "envelope") for d in ("records", "unique")}
    assert null["core", "unique"].n_pairs_evaluated == 1 and null["envelope", "records"].n_pairs_evaluated == 1 and null["envelope", "records"].n_pairs == 3
    values = got[1].dv
    assert min(values) <= null["core", "records"].null_mean <= max(values) and null["core", "records"].n_draws == 50
