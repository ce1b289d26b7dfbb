"""Registered queries: streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rebuff.plans.registry import query
from rebuff.session import scratch_path
from rebuff.sources.views import Views
from rebuff.streaming import streams as S


class StreamViews(Views):
    """The same views with a streaming request log."""

    def table(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        # A file source reads folders; the glob keeps it to the one table.
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def stream_log(v) -> DataFrame:
    return StreamViews(v.spark, v.sf_dir).hits.withColumn("h_ts", F.col("h_ts").cast("timestamp"))


@query("stream_daily_rollup", """SELECT *, CASE WHEN (date+1)::TIMESTAMP <= (SELECT max(ts) FROM events)-INTERVAL 1 DAY THEN 'closed' ELSE 'open' END AS state, 0::BIGINT AS late FROM panel""")
def _(v):
    return S.settled_rollup(S.drain(S.daily_rollup(stream_log(v)), "rollup"), v.hits)


@query("stream_rate_limit_alerts", "SELECT DISTINCT h_a_id AS a_id, date FROM hits WHERE h_status=429")
def _(v):
    return S.drain(S.rate_limit_alerts(stream_log(v)), "alerts")


@query("stream_spike_alerts", """SELECT a_id, date, cblock FROM (SELECT *, count(*) OVER w AS k, sum(cblock::DOUBLE) OVER w AS s, sum(cblock::DOUBLE*cblock) OVER w AS ss FROM panel WINDOW w AS (PARTITION BY a_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE k>=3 AND ss/k-(s/k)*(s/k)>0 AND cblock>s/k+1.5*sqrt(ss/k-(s/k)*(s/k)) AND date+2<=(SELECT max(date) FROM panel)""")
def _(v):
    path = scratch_path(v.spark, "days")
    v.panel.select("a_id", "date", "cblock").write.parquet(path)
    days = v.spark.readStream.schema("a_id long, date date, cblock long").parquet(path)
    return S.drain(S.spike_alerts(days), "spikes")


@query("stream_quiet_sessions", """SELECT a_id, min(date) AS first_date, max(date)+5 AS end_date, sum(c)::BIGINT AS n FROM (SELECT *, sum(b) OVER (PARTITION BY a_id ORDER BY date) AS g FROM (SELECT l_suppkey AS a_id, CAST(l_shipdate AS DATE) AS date, count(*) AS c,
  CASE WHEN CAST(l_shipdate AS DATE)-lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE))<=5 THEN 0 ELSE 1 END AS b FROM lineitem GROUP BY 1,2)) GROUP BY a_id, g
  HAVING (max(date)+5)::TIMESTAMP <= (SELECT max(l_shipdate) FROM lineitem)-INTERVAL 1 DAY""")
def _(v):
    li = StreamViews(v.spark, v.sf_dir).table("lineitem")
    log = li.select(F.col("l_suppkey").alias("a_id"), F.col("l_shipdate").cast("timestamp").alias("h_ts"))
    return S.drain(S.quiet_sessions(log), "sessions")
