"""Statistics of one array per series, and the feature series that feeds them."""
import numpy as np

from rebuff.functions import ranks
from rebuff.operators import inference as I
from rebuff.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_short_and_merged_kendall_scores_are_alike():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 9, 255, 256, 257, 600, ranks.SHORT, ranks.SHORT + 1, 3000]
    values = np.concatenate([rng.integers(0, 50, n) if k % 2 else rng.normal(size=n) for k, n in enumerate(sizes)])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    assert ranks.kendall_scores(values, bounds).tolist() == ranks.merged_scores(values, bounds).tolist()
    assert ranks.kendall_score(np.arange(2000)) == 2000 * 1999 // 2


def test_autocorrelation_and_period_of_planted_series(spark):
    day = np.arange(64)
    planted = {1: np.sin(2 * np.pi * day / 16) + 0.01 * day, 2: np.full(64, 0.5), 3: (day % 2) * 1.0, 4: day[:5] * 1.0}
    rows = [(k, int(i), float(v)) for k, x in planted.items() for i, v in zip(day, x)]
    long = spark.createDataFrame(rows, "k long, i long, value double").repartition(5)
    lags = {r.k: (r.n, r.adaptation_time, r.censored) for r in I.autocorr_time(long, ["k"]).collect()}
    assert lags[2] == (64, None, False) and lags[3] == (64, 1.0, False) and lags[4] == (5, None, False) and lags[1][1] == 4.0
    found = {r.k: (r.oscillation, r.osc_period) for r in I.periodicity(long, ["k"]).collect()}
    assert found[1][1] == 16.0 and found[1][0] > 0.9 and found[2] == (0.0, None) and found[3][1] == 2.0 and found[4] == (0.0, None)


def _joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_feature_series_takes_its_counts_from_one_pass(spark):
    v = Views(spark, SF)
    assert _joins(v.sfeat) == 0
    assert v.sfeat.where("date is null").count() == 0
    old = v.sidx.select("a_id", "date", "i", "n", "hits", "p404").collect()
    assert sorted(old) == sorted(v.sfeat.select("a_id", "date", "i", "n", "hits", "p404").collect())
