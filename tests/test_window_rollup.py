"""The date range of the wanted spans reaches the scan."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.operators import panel as P
from rebuff.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_range_is_pushed_into_the_scan(spark):
    v = Views(spark, SF)
    spans = v.panel.groupBy("a_id").agg(F.date_add(F.min("date"), 5).alias("lo"), F.date_add(F.min("date"), 9).alias("hi"))
    d = P.daily_rollup_window(v.hits, spans)
    plan = d._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line and "ts" in line)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    want = v.panel.join(spans, "a_id").where("date >= lo and date < hi").drop("lo", "hi")
    assert sorted(map(tuple, d.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert P.daily_rollup_window(v.hits, spans.limit(0)).count() == 0
