"""The check's curves are the arrays' curves, and only observed days move for them."""
import random

from rebuff.operators import leadlag as L


def test_curves_over_windows(spark):
    rng = random.Random(3)
    rows = [(a, 9000 + k, rng.random(), float(rng.randrange(3)) if a != 3 else 1.0) for a in (1, 2, 3, 4) for k in range(0, 90 if a != 4 else 6) if rng.random() < 0.4]
    s = spark.createDataFrame(rows, "a_id long, i long, r double, f double")
    s = s.where("a_id <> 3 or i > 0")
    a, b = ({(r.a_id, r.lag): r.ccf for r in d.collect()} for d in (L.ccf(s), L.windowed_curves(s)))
    assert set(a) == set(b) and {1, 2} <= {x for x, _ in a}
    assert all((x is None) == (b[k] is None) and (x is None or abs(x - b[k]) < 1e-12) for k, x in a.items())
    plan = L.windowed_curves(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
