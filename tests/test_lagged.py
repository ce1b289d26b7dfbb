"""Lag kernels and the shift null against sums written out by hand."""
from __future__ import annotations

import numpy as np
import pytest

from rebuff.functions.lagged import lag_curve, masked_curve, rotation_peaks, standardized
from rebuff.operators import leadlag as L


def linear(r, f, k):
    return sum(r[i] * f[i - k] for i in range(len(r)) if 0 <= i - k < len(r)) / len(r)


@pytest.mark.parametrize("n", [30, 31, 97])
def test_kernels(n):
    rng = np.random.default_rng(n)
    r, f = rng.random(n), rng.random(n) * (rng.random(n) < .3)
    zr, zf = standardized(r), standardized(f)
    lags = range(-14, 15)
    assert lag_curve(r, f, 14) == pytest.approx([linear(zr, zf, k) for k in lags])
    got = rotation_peaks(zr, zf, 14)
    for off in range(n):
        c = np.abs([linear(zr, np.roll(zf, off), k) for k in lags])
        assert (got[0][off], got[2][off]) == (c[15:].argmax() + 1, c[:14].argmax() - 14)
        assert (got[1][off], got[3][off]) == (pytest.approx(c[15:].max()), pytest.approx(c[:14].max()))
    seen = rng.random(n) < .6
    curve = masked_curve(np.where(seen, r, np.nan), np.where(seen, f, np.nan), 14, 10)
    for k, c in zip(lags, curve):
        at = [i for i in range(n) if 0 <= i - k < n and seen[i] and seen[i - k]]
        x, y = r[at], f[[i - k for i in at]]
        assert np.isnan(c) if len(at) < 10 or min(x.std(), y.std()) < 1e-9 else c == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_series_without_variation():
    flat = np.ones(40)
    assert standardized(flat) is None and lag_curve(flat, np.arange(40.0), 14) is None
    assert np.isnan(masked_curve(flat, np.arange(40.0), 14, 10)).all()
    assert np.isnan(lag_curve(np.arange(5.0), np.arange(5.0), 14)[[0, 9, 19, 28]]).all()


def test_shift_null_fills_the_calendar_and_draws_in_range(spark):
    rng = np.random.default_rng(7)
    days = sorted(rng.choice(90, 50, replace=False).tolist() + [0, 89])
    days = sorted(set(days))
    rows = [(a, d + 1000, float(rng.random()), float(rng.random())) for a in (1, 2) for d in days] + [(3, d, 0.5, float(d)) for d in range(40)]
    series = spark.createDataFrame(rows, "a_id long, i long, r double, f double")
    members = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.5), (3, "y", 1.0)], "a_id long, pop string, density double")
    got = L.shift_null(series, members, 200).collect()
    assert {(r.a_id, r.rep) for r in got} == {(a, k) for a in (1, 2) for k in range(1, 201)}
    for a in (1, 2):
        r, f = np.zeros(90), np.zeros(90)
        for x in rows:
            if x[0] == a:
                r[x[1] - 1000], f[x[1] - 1000] = x[2:]
        post_lag, post, pre_lag, pre = rotation_peaks(standardized(r), standardized(f), 14)
        possible = {(round(post[o], 9), int(post_lag[o]) if post[o] > pre[o] else None, None if post[o] > pre[o] else int(-pre_lag[o])) for o in range(15, 76)}
        seen = {(round(x.abs_ccf, 9), x.resp_lag, x.lead_lag) for x in got if x.a_id == a}
        assert seen <= possible and len(seen) > 20
    assert L.shift_null(series, members, 1200).groupBy("a_id").count().collect()[0]["count"] == 1200
