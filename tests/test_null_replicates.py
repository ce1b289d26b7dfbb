"""Statistics of shift-null replicates from one row per agent against those from one row per replicate."""
import numpy as np
from pyspark.sql import functions as F

from rebuff.functions.distributed import exact_quantiles
from rebuff.operators import leadlag as L

REPS = 60


def test_replicates_by_counts_and_by_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(a, "pq"[a % 2], a / 300, rng.choice([-3, -1, 2, 14], REPS).tolist(), np.round(rng.beta(2, 30, REPS), 3).tolist()) for a in range(301)]
    null = spark.createDataFrame(rows, "a_id long, pop string, density double, lag array<tinyint>, abs_ccf array<double>").repartition(4)
    long = null.select("pop", F.posexplode(F.arrays_zip("lag", "abs_ccf")).alias("k", "x")).select("pop", (F.col("k") + 1).alias("rep"), "x.lag", "x.abs_ccf").cache()
    want = {(r["pop"], r["rep"]): r["m"] for r in exact_quantiles(long, "abs_ccf", {"m": 0.5}, ["pop", "rep"]).collect()}
    shares = {(r["pop"], r["rep"]): (r["s"], r["n"], r["up"], r["down"]) for r in long.groupBy("pop", "rep").agg(
        F.avg((F.col("lag") > 0).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("lag") > 0, F.col("lag")), F.lit(0.5)).alias("up"),
        F.percentile(F.when(F.col("lag") < 0, -F.col("lag")), F.lit(0.5)).alias("down")).collect()}
    got = L.null_replicates(null, ["pop"]).collect()
    assert len(got) == 2 * REPS
    assert {(r["pop"], r["rep"]): r["m_abs_ccf"] for r in got} == want
    assert all(abs(r["share"] - shares[r["pop"], r["rep"]][0]) < 1e-12 for r in got)
    assert {(r["pop"], r["rep"]): (r["n_h"], r["m_resp_lag"], r["m_lead_lag"]) for r in got} == {k: v[1:] for k, v in shares.items()}
