"""Medians and rank correlations of replicates against the same weights as rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rebuff.functions.distributed import average_ranks, exact_quantiles
from rebuff.functions.resample import multiplicities, replicate_medians
from rebuff.operators import inference as I

REPS = 260


def _units(spark, n=700):
    rng = np.random.default_rng(5)
    x = np.where(np.arange(n) % 3 == 0, 0.5, rng.normal(size=n))        # a third of the units tie
    y = np.round(x + rng.normal(size=n), 1)
    return spark.createDataFrame([(int(k), "ab"[k % 2], float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "a_id long, arm string, x double, y double").cache()


@pytest.mark.parametrize("by", [[], ["arm"]])
def test_medians_and_halves(spark, by):
    u = _units(spark)
    got, halves = replicate_medians(u, "a_id", "x", by, REPS, columns=["y"])
    rows = multiplicities(u, "a_id", by, REPS).cache()
    want = exact_quantiles(rows, "x", {"median": 0.5}, [*by, "rep"], weight="_w")
    key = lambda r: (r[by[0]] if by else "", r["rep"])
    want = {key(r): r["median"] for r in want.collect()}
    assert {key(r): r["median"] for r in got.collect()} == want
    sides = {}
    for r in rows.collect():
        side = sides.setdefault((*key(r), r["x"] > want[key(r)]), [0.0, 0.0])
        side[0] += r["_w"]
        side[1] += r["_w"] * r["y"]
    found = {(*key(r), r["above"]): (r["_n"], r["y"]) for r in halves.collect()}
    assert found.keys() == sides.keys()
    assert all(found[k] == pytest.approx(v) for k, v in sides.items())


def test_rank_correlation_of_replicates(spark):
    u = _units(spark).select("a_id", "x", "y")
    copies = multiplicities(u, "a_id", (), REPS).select("rep", "x", "y", F.explode(F.sequence(F.lit(1), "_w")))
    r = [average_ranks(copies, c, ["rep"]).select("rep", c, F.col("avg_rank").alias(f"r{c}")) for c in "xy"]
    want = {r.rep: r.stat for r in copies.join(r[0], ["rep", "x"]).join(r[1], ["rep", "y"]).groupBy("rep").agg(F.corr("rx", "ry").alias("stat")).collect()}
    got = {r.rep: r.stat for r in I.replicate_spearman(u, "a_id", REPS, held=50, together=128).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
