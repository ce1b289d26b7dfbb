"""Registered queries: data contract."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.functions.expressions import wilson
from rebuff.operators import contract as Q, populations as R
from rebuff.operators.bridges import BINS
from rebuff.plans.registry import query

COLS = ["hits", "c200", "c404", "cblock", "c429", "robots"]
ROW = "concat_ws(',', date::VARCHAR, " + ", ".join(f"{c}::VARCHAR" for c in COLS) + ")"
DG = {"dgs": f"SELECT a_id, sha256(string_agg({ROW}, '|' ORDER BY {ROW})) AS digest, count(*) AS n_rows FROM panel GROUP BY 1",
      "cur": "SELECT CASE WHEN a_id%9=0 THEN 'axis:' ELSE 'agent:' END||a_id AS key, digest, n_rows AS n FROM dgs",
      "reg": """SELECT key, CASE WHEN n%5=0 THEN upper(digest) ELSE digest END AS digest, CASE WHEN n%7=0 THEN n-100 ELSE n END AS n FROM cur WHERE n%11<>0""",
      "pcm": """SELECT key, c.n, CASE WHEN r.digest IS NULL THEN 'unpinned' WHEN c.n<>r.n THEN 'changed_set' WHEN c.digest<>r.digest THEN 'changed_content' ELSE 'match' END AS status FROM cur c LEFT JOIN reg r USING (key)"""}


def declared(v):
    return v.table("labels").select(F.col("doc_id").alias("a_id"))


def current(v):
    d = Q.agent_digests(v.panel, COLS)
    return d.select(F.concat(F.when(F.col("a_id") % 9 == 0, "axis:").otherwise("agent:"), F.col("a_id")).alias("key"), "digest", F.col("n_rows").alias("n"))


def registry(v):
    c = current(v).where("n % 11 <> 0")
    return c.select("key", F.when(F.col("n") % 5 == 0, F.upper("digest")).otherwise(F.col("digest")).alias("digest"),
                    F.when(F.col("n") % 7 == 0, F.col("n") - 100).otherwise(F.col("n")).alias("n"))


@query("presence_check", "SELECT a_id, present, count(*) OVER () AS n_declared, count(*) FILTER (present) OVER () AS n_present FROM (SELECT DISTINCT doc_id AS a_id, doc_id IN (SELECT a_id FROM panel) AS present FROM labels)")
def _(v):
    return Q.presence_check(declared(v), v.panel)


@query("schema_check", "SELECT unnest(['date','hits','cblock','p404']) AS column, unnest([true,true,true,false]) AS exists, unnest([false,true,true,false]) AS numeric, count(*) AS n_rows FROM panel".replace("AS column", 'AS "column"').replace("AS exists", 'AS "exists"').replace("AS numeric", 'AS "numeric"'))
def _(v):
    return Q.schema_check(v.panel, ["date", "hits", "cblock", "p404"])


@query("date_check", """SELECT a_id, count(*) FILTER (d IS NULL) AS unparseable, count(d)-count(DISTINCT d) AS duplicated, count(*) FILTER (d<p) AS non_monotone FROM (SELECT *, lag(d) OVER (PARTITION BY a_id ORDER BY date) AS p FROM
  (SELECT a_id, date, CASE WHEN hits=6 THEN NULL WHEN hits=5 THEN date-2 WHEN hits=4 THEN date-1 ELSE date END AS d FROM panel)) GROUP BY 1""")
def _(v):
    text = (F.when(F.col("hits") == 6, "not-a-date").when(F.col("hits") == 5, F.date_sub("date", 2).cast("string"))
            .when(F.col("hits") == 4, F.date_sub("date", 1).cast("string")).otherwise(F.col("date").cast("string")))
    return Q.date_check(v.panel.select("a_id", F.col("date").alias("ord"), text.alias("date_text")))


@query("exclusion_report", """SELECT CASE WHEN k IS NULL THEN 'no_rows' WHEN k<27 THEN 'below_min_days' ELSE 'admitted' END AS reason, count(*) AS n_agents, sum(coalesce(k,0))::BIGINT AS n_rows FROM (SELECT DISTINCT doc_id FROM labels)
  LEFT JOIN (SELECT a_id, count(*) AS k FROM panel GROUP BY 1) ON a_id=doc_id GROUP BY 1""")
def _(v):
    return Q.exclusion_report(declared(v), v.panel, 27)


@query("content_digest", """SELECT sha256(string_agg(k||':'||d, '|' ORDER BY k||':'||d)) AS content_digest, sum(c)::BIGINT AS n_declared FROM (SELECT substr(md5(a_id::VARCHAR),1,3) AS k, count(*) AS c,
  sha256(string_agg(lpad(a_id::VARCHAR,20,'0')||':'||digest||':'||n_rows, '|' ORDER BY lpad(a_id::VARCHAR,20,'0')||':'||digest||':'||n_rows)) AS d FROM dgs GROUP BY 1)""", ctes=DG)
def _(v):
    return Q.cohort_digest(Q.agent_digests(v.panel, COLS))


@query("pin_compare", "SELECT * FROM pcm", ctes=DG)
def _(v):
    return Q.pin_compare(current(v), registry(v))


ID_TEXT = "CASE doc_id%10 WHEN 1 THEN NULL WHEN 2 THEN doc_id||'.5' WHEN 3 THEN '-'||doc_id WHEN 4 THEN 'true' WHEN 5 THEN '5' WHEN 6 THEN 'x'||doc_id ELSE (doc_id+1)::VARCHAR END"


@query("id_list_check", f"""SELECT CASE m WHEN 1 THEN 'null' WHEN 2 THEN 'fractional' WHEN 3 THEN 'non_positive' WHEN 4 THEN 'boolean' ELSE 'not_a_number' END AS reason, count(*) AS n FROM (SELECT doc_id%10 AS m FROM labels) WHERE m IN (1,2,3,4,6) GROUP BY 1
  UNION ALL SELECT 'duplicate', sum(c-1)::BIGINT FROM (SELECT t, count(*) AS c FROM (SELECT {ID_TEXT} AS t FROM labels WHERE doc_id%10 NOT IN (1,2,3,4,6)) GROUP BY 1 HAVING count(*)>1)""")
def _(v):
    d, m = F.col("doc_id"), F.col("doc_id") % 10
    s = d.cast("string")
    text = (F.when(m == 2, F.concat(s, F.lit(".5"))).when(m == 3, F.concat(F.lit("-"), s)).when(m == 4, "true").when(m == 5, "5")
            .when(m == 6, F.concat(F.lit("x"), s)).when(m != 1, (d + 1).cast("string")))
    return Q.id_list_check(v.table("labels").select(text.alias("id_text")))


@query("set_reconcile", """SELECT a_id, 'left_only' AS side FROM abusive WHERE a_id NOT IN (SELECT a_id FROM roster2 WHERE role='abusive_share') UNION ALL SELECT a_id, 'right_only' FROM roster2 WHERE role='abusive_share' AND a_id NOT IN (SELECT a_id FROM abusive)""")
def _(v):
    return Q.set_reconcile(R.abusive_arm(v.honeypot, v.agent), v.roster.where("role = 'abusive_share'"))


@query("registry_check", """SELECT CASE WHEN key LIKE 'axis%' THEN 'axis' ELSE 'cohort' END AS kind, CASE WHEN NOT regexp_full_match(digest,'[0-9a-f]{64}') THEN 'bad_digest' WHEN n<0 THEN 'bad_count' ELSE 'ok' END AS problem, count(*) AS n_rows FROM reg GROUP BY 1,2""", ctes=DG)
def _(v):
    return Q.registry_check(registry(v))


@query("pin_plan", "SELECT CASE status WHEN 'match' THEN 'keep' WHEN 'unpinned' THEN 'add' ELSE 'replace' END AS action, status, count(*) AS n_keys FROM pcm GROUP BY 1,2", ctes=DG)
def _(v):
    return Q.pin_plan(current(v), registry(v))


IV = {"iv": """SELECT a_id, 100*k/n AS est, CASE WHEN a_id%10=0 THEN hi ELSE lo END AS lo, CASE WHEN a_id%10=0 THEN lo ELSE hi END AS hi FROM (SELECT *, greatest(0.0,100*(c-h)) AS lo, least(100.0,100*(c+h)) AS hi FROM
  (SELECT *, (k/n+1.96*1.96/(2*n))/(1+1.96*1.96/n) AS c, 1.96*sqrt(k/n*(1-k/n)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n) AS h FROM (SELECT a_id, count(*) FILTER (cblock>0) AS k, count(*) AS n FROM sidx GROUP BY 1)))"""}


@query("interval_sanity", "SELECT count(*) AS n_rows, count(*) FILTER (lo>hi) AS inverted, count(*) FILTER (est<lo OR est>hi) AS outside, count(*) FILTER ((lo IS NULL)<>(hi IS NULL)) AS half_missing FROM iv", ctes=IV)
def _(v):
    t = v.spanel.groupBy("a_id").agg(F.count_if(F.col("cblock") > 0).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    swap = F.col("a_id") % 10 == 0
    t = t.select((100 * F.col("k") / F.col("n")).alias("est"), F.when(swap, hi).otherwise(lo).alias("lo"), F.when(swap, lo).otherwise(hi).alias("hi"))
    return Q.interval_sanity(t, "lo", "hi", "est")


@query("value_reconcile", """SELECT key, claimed, CASE WHEN a_id%7=0 THEN 'no_metric' WHEN a_id%5=0 THEN 'differs' ELSE 'agrees' END AS status FROM (SELECT a_id, 'mean_hits:'||a_id AS key, floor(avg(hits)*100+0.5)/100+CASE WHEN a_id%5=0 THEN 1.0 ELSE 0.0 END AS claimed
  FROM spanel GROUP BY 1)""", "claimed")
def _(v):
    m = v.spanel.groupBy("a_id").agg(F.avg("hits").alias("metric")).withColumn("key", F.concat(F.lit("mean_hits:"), "a_id"))
    claims = m.select("key", (F.floor(F.col("metric") * 100 + 0.5) / 100 + F.when(F.col("a_id") % 5 == 0, 1.0).otherwise(0.0)).alias("claimed"), F.lit(2).alias("digits"))
    return Q.value_reconcile(claims, m.where("a_id % 7 <> 0").select("key", "metric"))


@query("partition_check", """SELECT count(*) FILTER (h=1) AS exactly_one, count(*) FILTER (h=0) AS "none", count(*) FILTER (h>1) AS several, min(h)=1 AND max(h)=1 AS is_partition FROM
  (SELECT (hits BETWEEN 0 AND 5)::INT+(hits BETWEEN 6 AND 25)::INT+(hits BETWEEN 26 AND 100)::INT+(hits BETWEEN 101 AND 1000000000)::INT AS h FROM spanel)""")
def _(v):
    return Q.partition_check(v.spanel, "hits", BINS)


@query("hollow_result_guard", "SELECT a_id, n_draws, n_pairs, n_draws=0 AND n_pairs>0 AS hollow FROM (SELECT a_id, count(*) FILTER (c429>0) AS n_draws, count(*) FILTER (cblock>0) AS n_pairs FROM spanel GROUP BY 1)")
def _(v):
    return Q.hollow_result_guard(v.spanel.groupBy("a_id").agg(F.count_if(F.col("c429") > 0).alias("n_draws"), F.count_if(F.col("cblock") > 0).alias("n_pairs")))
