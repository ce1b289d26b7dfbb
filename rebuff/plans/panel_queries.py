"""Registered queries: scans, sinks, panel construction."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.operators import panel as P
from rebuff.plans.registry import query
from rebuff.session import scratch_path
from rebuff.sources import files

RATES = "p200 p404 p_block p_429 robots_rate resistance"
FEATS = " ".join(P.FEATURES)
PANEL = "a_id, date, hits, c200, c404, cblock, c429, robots"


@query("scan_requests", "SELECT h_a_id, h_status, h_u_id FROM hits WHERE h_ts>='2024-01-01' AND h_ts<'2024-02-01'")
def _(v):
    return files.scan_requests(v.hits, ["h_status", "h_u_id"], "2024-01-01", "2024-02-01", v.agent)


@query("agent_dimension", "SELECT a_id, a_name, a_start, a_last, a_totalhit, min(a_start) OVER () AS date_floor, max(a_last) OVER () AS date_ceiling FROM agent")
def _(v):
    return files.agent_dimension(v.agent)


@query("read_labelled_series", f"SELECT a_id, label, day, hits, {', '.join(P.FEATURES)} FROM series", FEATS)
def _(v):
    path = scratch_path(v.spark, "series")
    files.write_labelled_series(v.series, path)
    return files.read_labelled_series(v.spark, path)


@query("panel_store", f"SELECT {PANEL} FROM panel")
def _(v):
    path = scratch_path(v.spark, "panel")
    files.write_panel(v.panel, path)
    return files.read_panel(v.spark, path).select(*PANEL.split(", "))


@query("downtime_days", f"SELECT {PANEL} FROM panel WHERE date NOT IN (SELECT e_day FROM emptydays)")
def _(v):
    return P.drop_downtime(v.panel, v.emptydays).select(*PANEL.split(", "))


@query("read_id_list", """SELECT DISTINCT a_id, a_id>2147483647 AS over_limit FROM (SELECT doc_id AS a_id FROM labels UNION ALL SELECT doc_id+2147483000 FROM labels) WHERE a_id>0""")
def _(v):
    path = scratch_path(v.spark, "ids")
    ids = v.table("labels").select(F.col("doc_id").cast("string").alias("a_id"))
    bad = v.table("labels").select(F.concat("doc_id", F.lit(".5")).alias("a_id"))
    long = v.table("labels").select((F.col("doc_id") + 2147483000).cast("string").alias("a_id"))
    ids.unionByName(bad).unionByName(long).write.csv(path, header=True)
    return files.read_id_list(v.spark, path)


@query("write_result", "SELECT date, sum(hits)::BIGINT AS hits, count(*) AS agents, 5::BIGINT AS spacing FROM panel GROUP BY 1")
def _(v):
    path = scratch_path(v.spark, "result")
    files.write_result(v.panel.groupBy("date").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("agents")), path, spacing=5)
    return v.spark.read.schema("date date, hits long, agents long, spacing long").json(path)


@query("write_feature_series", """SELECT label, count(*) AS n_rows, count(DISTINCT a_id) AS n_agents, sum(hits)::BIGINT AS hits,
  sum(cblock)::BIGINT AS cblock, avg(p404) AS p404 FROM series GROUP BY 1""", "p404")
def _(v):
    tab, pq = scratch_path(v.spark, "tab"), scratch_path(v.spark, "pq")
    files.write_feature_series(v.series, tab, pq)
    t = v.spark.read.csv(tab, sep="\t", header=True, schema="a_id long, " + ", ".join(f"{c} double" for c in P.SERIES_COLUMNS) + ", label string")
    a = t.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("a_id").alias("n_agents"), F.avg("p404").alias("p404"))
    b = v.spark.read.parquet(pq).groupBy("label").agg(F.sum("hits").alias("hits"), F.sum("cblock").alias("cblock"))
    return a.join(b, "label")


@query("incremental_extract", f"SELECT {PANEL} FROM panel")
def _(v):
    path = scratch_path(v.spark, "store")
    files.write_panel(v.panel.where("a_id % 2 = 0"), path)
    for _again in range(2):
        files.incremental_extract(v.spark, v.panel, path)
    return files.read_panel(v.spark, path).select(*PANEL.split(", "))


@query("extract_outcomes", """SELECT CASE WHEN a_id>2147483647 THEN 'over_max_id' WHEN a_id IN (SELECT a_id FROM panel WHERE a_id%2=0) THEN 'cached'
  WHEN a_id IN (SELECT a_id FROM panel) THEN 'fetched' ELSE 'empty' END AS outcome, count(*) AS n_ids FROM
  (SELECT doc_id AS a_id FROM labels UNION ALL SELECT doc_id+2147483647 FROM labels WHERE doc_id%5=1) GROUP BY 1""")
def _(v):
    ids = v.table("labels").select(F.col("doc_id").alias("a_id"))
    over = ids.where("a_id % 5 = 1").select((F.col("a_id") + P.MAX_ID).alias("a_id"))
    return files.extract_outcomes(ids.unionByName(over), v.panel.where("a_id % 2 = 0"), v.panel)


@query("profile_log", """SELECT unnest(['rows','robots_hits','agents']) AS metric, NULL::VARCHAR AS item, unnest([count(*), count(*) FILTER (h_u_id=64), count(DISTINCT h_a_id)])::BIGINT AS value, NULL::VARCHAR AS at FROM hits
  UNION ALL SELECT unnest(['first_time','last_time']), NULL, NULL, strftime(unnest([min(h_ts), max(h_ts)])::TIMESTAMP, '%Y-%m-%d %H:%M:%S') FROM hits UNION ALL SELECT 'status', h_status::VARCHAR, count(*), NULL FROM hits GROUP BY 2
  UNION ALL SELECT 'method', h_mode, count(*), NULL FROM hits GROUP BY 2""")
def _(v):
    return files.profile_log(v.hits, P.ROBOTS_URL).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("daily_rollup", f"SELECT {PANEL} FROM panel")
def _(v):
    return v.panel


@query("daily_rollup_spread", f"""SELECT {PANEL}, n_ip, n_dom, n_ctry, n_url FROM panel JOIN (SELECT h_a_id AS a_id, date, count(DISTINCT h_i_id) AS n_ip,
  count(DISTINCT h_d_id) AS n_dom, count(DISTINCT h_ccode) AS n_ctry, count(DISTINCT h_u_id) AS n_url FROM hits GROUP BY 1,2) USING (a_id, date)""")
def _(v):
    return P.daily_rollup_spread(v.hits)


@query("daily_rollup_window", f"SELECT {', '.join('p.'+c for c in PANEL.split(', '))} FROM panel p JOIN agent a ON a.a_id=p.a_id WHERE p.date>=a_start+5 AND p.date<a_start+20")
def _(v):
    spans = v.agent.select("a_id", F.date_add("a_start", 5).alias("lo"), F.date_add("a_start", 20).alias("hi"))
    return P.daily_rollup_window(v.hits, spans)


@query("rotation_rollup", """SELECT h.a_id, h.date, h.hits, coalesce(f.c404,0) AS c404, coalesce(r.robots,0) AS robots, NULL::BIGINT AS c200, NULL::BIGINT AS cblock,
  NULL::BIGINT AS c429, NULL::BIGINT AS n_ip, NULL::BIGINT AS n_dom, NULL::BIGINT AS n_ctry, NULL::BIGINT AS n_url, true AS rotation_minimal FROM
  (SELECT h_a_id AS a_id, date, count(*) AS hits FROM hits GROUP BY 1,2) h
  LEFT JOIN (SELECT h_a_id AS a_id, date, count(*) AS c404 FROM hits WHERE h_status=404 GROUP BY 1,2) f ON f.a_id=h.a_id AND f.date=h.date
  LEFT JOIN (SELECT h_a_id AS a_id, date, count(*) AS robots FROM hits WHERE h_u_id=64 GROUP BY 1,2) r ON r.a_id=h.a_id AND r.date=h.date""")
def _(v):
    return P.rotation_rollup(v.hits)


@query("derived_rates", """SELECT a_id, date, hits, c200/greatest(hits,1) AS p200, c404/greatest(hits,1) AS p404, cblock/greatest(hits,1) AS p_block,
  c429/greatest(hits,1) AS p_429, robots/greatest(hits,1) AS robots_rate, greatest(0.0,1-c200/greatest(hits,1)) AS resistance, n_ip AS spread_ip, n_dom AS spread_dom,
  n_ctry AS spread_ctry, (n_ip+n_dom+n_ctry)/3 AS evasion_index FROM panel JOIN (SELECT h_a_id AS a_id, date, count(DISTINCT h_i_id) AS n_ip,
  count(DISTINCT h_d_id) AS n_dom, count(DISTINCT h_ccode) AS n_ctry FROM hits GROUP BY 1,2) USING (a_id, date)""", RATES + " evasion_index")
def _(v):
    return P.derived_rates(P.daily_rollup_spread(v.hits)).select(
        "a_id", "date", "hits", *RATES.split(), "spread_ip", "spread_dom", "spread_ctry", "evasion_index")


@query("day_index", "SELECT a_id, date, (date-min(date) OVER (PARTITION BY a_id))::INTEGER AS day_index FROM panel")
def _(v):
    return P.day_index(v.panel).select("a_id", "date", "day_index")


@query("drop_downtime", """SELECT a_id, date, row_number() OVER (PARTITION BY a_id ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY a_id) AS n, hits
  FROM panel WHERE date NOT IN (SELECT e_day FROM emptydays)""")
def _(v):
    from rebuff.operators.windows import index_days
    return index_days(P.drop_downtime(v.panel, v.emptydays)).select("a_id", "date", "i", "n", "hits")


@query("id_guard", "SELECT a_id*20000000 AS a_id, a_id*20000000>2147483647 AS over_limit FROM agent")
def _(v):
    return P.id_guard(v.agent.select((F.col("a_id") * 20000000).alias("a_id")))


@query("distinct_ratio_features", "SELECT a_id, date, n_ip/hits AS ip_ent, n_dom/hits AS dom_ent, n_ctry/hits AS ctry_ent, n_url/hits AS url_ent FROM perday",
       "ip_ent dom_ent ctry_ent url_ent")
def _(v):
    return P.distinct_ratios(v.hits)


@query("extension_shares", "SELECT a_id, date, html/hits AS html, php/hits AS php, folder/hits AS folder FROM perday", "html php folder")
def _(v):
    return P.extension_shares(v.hits, v.url)


@query("country_share", "SELECT a_id, date, hu/hits AS husource FROM perday", "husource")
def _(v):
    return P.country_share(v.hits)


@query("densify_calendar", "SELECT a_id, date, coalesce(hits,0) AS hits, coalesce(cblock,0) AS cblock, coalesce(c429,0) AS c429 FROM dense LEFT JOIN panel USING (a_id,date)")
def _(v):
    return P.densify_calendar(v.panel, ["hits", "cblock", "c429"])


@query("panel_zero_days", """SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM panel)
  WHERE CAST(d AS DATE) IN (SELECT e_day FROM emptydays)""")
def _(v):
    return P.panel_zero_days(P.drop_downtime(v.panel, v.emptydays))


@query("feature_series", f"SELECT a_id, date, day, hits, {', '.join(P.FEATURES)}, cblock, c429 FROM seq14", FEATS)
def _(v):
    return P.feature_series(v.hits, v.url)


PARITY = " UNION ALL ".join(f"SELECT a_id, day, '{f}' AS feature, {f}::DOUBLE AS x, {f}" + {"php": "+CASE WHEN a_id%7=0 THEN 0.001 ELSE 0 END", "html": "+1e-7"}.get(f, "") + " AS y FROM seq14" for f in P.FEATURES)


@query("column_parity", f"""SELECT feature, max(abs(x-y)) AS max_abs_diff, count(*) FILTER (x IS NULL OR y IS NULL) AS unmatched,
  CASE WHEN count(*) FILTER (x IS NULL OR y IS NULL)=0 AND max(abs(x-y))<=2e-6 THEN 'EXACT' ELSE 'DIFF' END AS verdict FROM ({PARITY}) GROUP BY 1""", "max_abs_diff")
def _(v):
    right = v.seq14.withColumns({"php": F.col("php") + F.when(F.col("a_id") % 7 == 0, 0.001).otherwise(0.0),
                                 "html": F.col("html") + 1e-7})
    return P.column_parity(v.seq14, right, P.FEATURES)


@query("activity_summary", """SELECT a_id, label, count(*) AS n_active, min(day) AS first_day, max(day) AS last_day, max(day)-min(day)+1 AS lifespan_days
  FROM series WHERE hits>0 GROUP BY 1,2""")
def _(v):
    return P.activity_summary(v.series, ["a_id", "label"])


@query("p404_coordinates", """SELECT a_id, date, p404 AS baseline, p404_bi AS nonblocked, CASE WHEN c404+c200>0 THEN c404/(c404+c200) END AS vs200 FROM sidx""",
       "baseline nonblocked vs200")
def _(v):
    d = P.derived_rates(v.spanel)
    return d.select("a_id", "date", *[P.p404(c).alias(c) for c in ("baseline", "nonblocked", "vs200")])


@query("build_tally", """SELECT status, count(*) AS n_agents FROM (SELECT doc_id, CASE WHEN k IS NULL THEN 'fail' WHEN k<30 THEN 'short' ELSE 'ok' END AS status
  FROM labels LEFT JOIN (SELECT a_id, count(*) AS k FROM seq14 GROUP BY 1) ON a_id=doc_id) GROUP BY 1""")
def _(v):
    return P.build_tally(v.seq14, v.table("labels").select(F.col("doc_id").alias("a_id")))


@query("status_histogram", """SELECT h_status, n, hits, blocks, c429, 100*blocks/greatest(hits,1) AS block_share_pct, b3/greatest(b1,1) AS ratio_403_401 FROM
  (SELECT h_status, count(*) AS n FROM hits WHERE h_a_id IN (SELECT a_id FROM alabels) GROUP BY 1),
  (SELECT count(*) AS hits, count(*) FILTER (h_status IN (401,403)) AS blocks, count(*) FILTER (h_status=429) AS c429, count(*) FILTER (h_status=403) AS b3,
   count(*) FILTER (h_status=401) AS b1 FROM hits WHERE h_a_id IN (SELECT a_id FROM alabels))""", "block_share_pct ratio_403_401")
def _(v):
    return P.status_histogram(v.hits, v.labels)


@query("agent_block_profile", """SELECT count(*) FILTER (b>0) AS agents_with_blocks, 100*avg(CASE WHEN b>0 THEN (c3/b>0.5)::INT::DOUBLE END) AS pct_403_majority,
  100*max(b)/greatest(sum(b),1) AS largest_agent_share_pct, quantile_cont(CASE WHEN b>0 THEN c3/b END, 0.5) AS median_403_share FROM
  (SELECT h_a_id, count(*) FILTER (h_status=403) AS c3, count(*) FILTER (h_status IN (401,403)) AS b FROM hits GROUP BY 1)""",
       "pct_403_majority largest_agent_share_pct median_403_share")
def _(v):
    return P.agent_block_profile(v.hits)


@query("monthly_coevolution", """SELECT arm AS grp, strftime(date,'%Y-%m') AS month, count(DISTINCT a_id) AS agent_months, count(*) AS active_days, sum(hits)::BIGINT AS hits,
  sum(cblock)/sum(hits) AS block_rate, sum(robots)/sum(hits) AS robots_rate, sum(c200)/sum(hits) AS success_rate FROM sidx GROUP BY 1,2""",
       "block_rate robots_rate success_rate")
def _(v):
    return P.monthly_coevolution(v.spanel.withColumn("arm", v.arm()), "arm")


@query("derived_signals", "SELECT a_id, day, evasion_index, resistance, compliance, request_diversity FROM (SELECT s.*, (ip_ent+dom_ent+ctry_ent)/3 AS evasion_index, greatest(1.0-p200,0.0) AS resistance, robots AS compliance, url_ent AS request_diversity FROM seq14 s)",
       "evasion_index resistance compliance request_diversity")
def _(v):
    return P.derived_signals(v.seq14).select("a_id", "day", "evasion_index", "resistance", "compliance", "request_diversity")


@query("extraction_check", """SELECT a_id, count(*) AS days, sum(hits)::BIGINT AS hits, sum(cblock)::BIGINT AS blocks, sum(c429)::BIGINT AS rate_limited, sum(robots)::BIGINT AS robots,
  max(n_ip) AS max_ip_per_day, min(date) AS first_date, max(date) AS last_date FROM panel JOIN (SELECT h_a_id AS a_id, date, count(DISTINCT h_i_id) AS n_ip FROM hits GROUP BY 1,2)
  USING (a_id,date) GROUP BY 1""")
def _(v):
    return P.extraction_check(P.daily_rollup_spread(v.hits))
