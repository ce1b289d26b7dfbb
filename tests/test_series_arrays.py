"""Change points work on one row per series: no window, and no task that sorts all days again and again."""
from rebuff.operators import inference as I


def test_change_points_on_arrays(spark):
    rows = [(1, k, float(k >= 12) + (k % 3) * 0.01) for k in range(30)] + [(2, k, 5.0) for k in range(30)] + [(3, k, float(k)) for k in range(4)]
    long = spark.createDataFrame(rows, "a_id long, i long, value double")
    p = I.pettitt(long, ["a_id"])
    got = {r.a_id: r for r in p.collect()}
    assert (got[1].location, got[1].significant, got[1].n) == (11, True, 30)
    assert (got[2].location, got[2].k, got[2].p_value, got[3].location) == (-1, None, 1.0, -1)
    e = {r.a_id: r for r in I.changepoint_effect(long, p, ["a_id"]).collect()}
    x = [v for a, _, v in rows if a == 1]
    assert abs(e[1].cp_effect - abs(sum(x[11:]) / 19 - sum(x[:11]) / 11)) < 1e-12 and e[1].cp_frac == 11 / 30 and e[2].cp_effect is None
    assert "Window" not in p._jdf.queryExecution().executedPlan().toString()
