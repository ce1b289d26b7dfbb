"""Kendall scores by merging and exact rank distributions against counting and known values."""
from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from rebuff.functions import ranks as R
from rebuff.operators import inference as I


def pairs(x):
    return int(sum(np.sign(x[j] - x[i]) for i in range(len(x)) for j in range(i + 1, len(x))))


def test_scores_of_many_series():
    rng = np.random.default_rng(1)
    series = [rng.integers(0, 1 + k, size=n).astype(float) for k, n in enumerate((0, 1, 2, 7, 8, 9, 40, 0, 65, 3))]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in series])))
    assert R.kendall_scores(np.concatenate(series), bounds).tolist() == [pairs(s) for s in series]
    t1, t2 = R.tie_sums(np.concatenate(series), bounds)
    for k, s in enumerate(series):
        t = np.unique(s, return_counts=True)[1] if len(s) else np.zeros(0, int)
        assert (t1[k], t2[k]) == ((t * (t - 1)).sum(), (t * (t - 1) * (2 * t + 5)).sum())


def test_exact_kendall():
    counts = np.bincount([sum(p[i] > p[j] for i, j in itertools.combinations(range(6), 2)) for p in itertools.permutations(range(6))])
    assert R.inversion_shares(6) == pytest.approx(counts / math.factorial(6))
    # Of 8: two permutations are perfect; 1 + 7 + 27 + 76 + 174 + 343 + 602 have at most six inversions.
    assert R.kendall_p(8, 28, 0, 0) == pytest.approx(2 / math.factorial(8))
    assert R.kendall_p(8, 16, 0, 0) == pytest.approx(2 * 1230 / math.factorial(8))
    assert R.kendall_p(8, 0, 0, 0) == 1
    # Of 25: at most two inversions have 1 + 24 + 299 permutations.
    assert R.kendall_p(25, 300, 0, 0) == pytest.approx(2 / math.factorial(25))
    assert R.kendall_p(25, -296, 0, 0) == pytest.approx(2 * 324 / math.factorial(25))
    assert R.kendall_p(33, 176, 0, 0) == pytest.approx(R.kendall_p(33, 176, 1e-9, 0), abs=2e-3)
    assert R.kendall_p(40, 780, 0, 0) == pytest.approx(2 / math.factorial(40))
    assert R.kendall_p(40, 778, 0, 0) == pytest.approx(2 * 40 / math.factorial(40))


def test_exact_u():
    for n1, n0 in ((3, 4), (5, 2), (1, 6)):
        u = [sum(a > b for a in pick for b in set(range(n1 + n0)) - set(pick)) for pick in itertools.combinations(range(n1 + n0), n1)]
        want = np.bincount(u, minlength=n1 * n0 + 1) / len(u)
        assert R.u_shares(n1, n0) == pytest.approx(want)
        for x in set(u):
            assert R.u_p(x, n1, n0, 0) == pytest.approx(min(1, 2 * want[max(x, n1 * n0 - x):].sum()))
    assert R.u_p(0, 8, 30, 0) == pytest.approx(2 / math.comb(38, 8))
    assert R.u_p(60, 8, 30, 0) == pytest.approx(R.u_p(60, 8, 30, 1e-9), abs=5e-3)
    assert math.isnan(R.u_p(0, 0, 5, 0))


def test_mann_kendall_rows(spark):
    short = [(1, i, float(i)) for i in range(8)] + [(2, i, float((i * 5) % 9)) for i in range(9)]
    other = [(3, i, 1.0) for i in range(20)] + [(4, i, float(i)) for i in range(7)] + [(5, i, float(i // 2)) for i in range(12)] + [(5, 12, None), (5, 13, float("nan"))]
    df = spark.createDataFrame(short + other, "k long, i long, value double")
    got = {r.k: r for r in I.mann_kendall(df, ["k"]).collect()}
    assert (got[1].n, got[1].tau, got[1].direction) == (8, 1.0, 1) and got[1].p_value == pytest.approx(2 / math.factorial(8))
    assert got[2].p_value == pytest.approx(R.kendall_p(9, pairs([x[2] for x in short[8:]]), 0, 0))
    assert (got[3].tau, got[3].p_value, got[3].direction) == (0.0, 1.0, 0) == (got[4].tau, got[4].p_value, got[4].direction)
    assert got[5].n == 12 and got[5].direction == 1 and got[5].tau < 1
    assert I.mann_kendall(df.limit(0), ["k"]).count() == 0
