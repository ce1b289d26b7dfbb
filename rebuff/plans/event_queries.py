"""Registered queries: event detection and window estimators."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.functions.resample import mean_difference
from rebuff.operators import events as E, windows as W
from rebuff.oracle.ctes import ALL_DEATHS, DID_DOUBLES, boot, did
from rebuff.plans.registry import query
from rebuff.session import materialize



def is_arm(name):
    return F.col("arm") == name


def two_arms(units, value, **kw):
    return mean_difference(units, "a_id", value, "arm", "abusive", "verified", **kw)


@query("block_candidates", "SELECT a_id, i, date FROM sidx JOIN scand USING (a_id, i)")
def _(v):
    return E.block_candidates(v.sidx).select("a_id", "i", "date")


@query("block_events", "SELECT a_id, i, date, cblock, c429 FROM sidx JOIN sev5 USING (a_id, i)")
def _(v):
    return E.block_events(v.sidx, 5).select("a_id", "i", "date", "cblock", "c429")


@query("pressure_events", "SELECT a_id, label, i, day, resistance FROM active JOIN rev5 USING (a_id, label, i)", "resistance")
def _(v):
    return E.flag_pressure_events(v.active).where("kept").select("a_id", "label", "i", "day", "resistance")


@query("eligible_events", "SELECT a_id, i, n FROM sidx JOIN sev16 USING (a_id, i) WHERE i>=10 AND i+5<n")
def _(v):
    return E.block_events(v.sidx, 16).where(E.eligible(10, 5)).select("a_id", "i", "n")


BR = {"br": """SELECT a_id, sum(robots) AS robots, count(*) AS days, count(*) FILTER (sp AND c429<=0) AS s, count(*) FILTER (NOT sp AND c429>0) AS q,
  count(*) FILTER (sp AND c429>0) AS b, sum(c429) AS c429, sum(cblock) AS cblock, sum(hits) AS hits FROM (SELECT *, cblock>avg(cblock) OVER (PARTITION BY a_id)
  +1.5*stddev_pop(cblock) OVER (PARTITION BY a_id) AS sp FROM sidx) GROUP BY 1"""}


@query("event_branches", """SELECT count(*) AS agents, count(*) FILTER (robots>0) AS ever_robots, count(*) FILTER (days>=20) AS agents_with_min_days,
  sum(s)::BIGINT AS events_block_only, sum(q)::BIGINT AS events_429_only, sum(b)::BIGINT AS events_both, sum(c429)::BIGINT AS responses_429, sum(cblock)::BIGINT AS responses_block,
  sum(hits)::BIGINT AS hits, count(*) FILTER (cblock>0) AS agents_ever_blocked, max(cblock)::BIGINT AS largest_agent_block, 100*count(*) FILTER (robots>0)/count(*) AS ever_robots_pct,
  100*sum(q)/sum(s+q+b) AS pct_429_only, 100*sum(q+b)/sum(s+q+b) AS pct_touching_429, 100*count(*) FILTER (cblock>0)/count(*) AS pct_ever_blocked,
  100*max(cblock)/sum(cblock) AS largest_agent_share_pct FROM br""", "ever_robots_pct pct_429_only pct_touching_429 pct_ever_blocked largest_agent_share_pct", ctes=BR)
def _(v):
    return E.event_branches(v.sidx)


@query("spacing_cost", """SELECT 5::BIGINT AS spacing_from, 11::BIGINT AS spacing_to, a AS events_from, b AS events_to, a-b AS events_dropped, 100*(a-b)/a AS pct_dropped
  FROM (SELECT (SELECT count(*) FROM sev5) AS a, (SELECT count(*) FROM sev11) AS b)""", "pct_dropped")
def _(v):
    return E.spacing_cost(v.sidx)


@query("persistent_deaths", "SELECT a_id, t_death, pre_vol, tail_vol, tail_vol/pre_vol AS drop_ratio FROM deaths", "pre_vol tail_vol drop_ratio", ctes=ALL_DEATHS)
def _(v):
    return v.deaths


PD = {"pdeaths": """SELECT a_id, min(date) AS t_death, arg_min(pre,date) AS pre_vol, arg_min(tail,date) AS tail_vol FROM (SELECT s.*,
  avg(hits) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre, avg(hits) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tail,
  max(hits) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS look, sum(cblock) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near
  FROM sidx s) WHERE arm='abusive' AND n>=25 AND i>=5 AND i+1<n AND pre>=5 AND tail<0.5*pre AND look<pre AND near<=0 AND (a_id,i) NOT IN (SELECT (a_id,i) FROM scand) GROUP BY a_id"""}


@query("placebo_deaths", "SELECT a_id, t_death, pre_vol, tail_vol, row_number() OVER (ORDER BY md5('42:'||a_id), a_id) AS draw FROM pdeaths", "pre_vol tail_vol", ctes=PD)
def _(v):
    from rebuff.operators.populations import draw_order
    return draw_order(E.placebo_deaths(v.sidx.where("arm = 'abusive'")))


PRES = {"pres": """SELECT a_id, arm, date AS event_date, date+5>pe AS censored, nx IS NULL AS gone, nx IS NULL OR nx>date+5 AS quiet5, nx IS NOT NULL AND nx>date+5 AS returned_after_quiet,
  (pe-date)::BIGINT AS followup_days, (last-date)::BIGINT AS days_to_last_seen FROM (SELECT *, lead(date) OVER (PARTITION BY a_id ORDER BY i) AS nx, max(date) OVER (PARTITION BY a_id) AS last,
  (SELECT panel_end FROM panel_end) AS pe FROM sidx) JOIN sev16 USING (a_id,i) WHERE i>=5 AND n>=20""",
        "presa": """SELECT arm, m AS min_days, a_id, count(*) AS n, count(*) FILTER (gone) AS k, count(*) FILTER (quiet5) AS q, count(*) FILTER (returned_after_quiet) AS r
  FROM pres, (SELECT unnest([0,5,30,90,180,365,730])::BIGINT AS m) WHERE NOT censored AND followup_days>=m GROUP BY 1,2,3""",
        "prest": """SELECT arm, min_days, sum(n)::BIGINT AS n, sum(k)::BIGINT AS gone, sum(q)::BIGINT AS quiet5, sum(r)::BIGINT AS returned, count(*) AS agents_with_events, count(*) FILTER (k>0) AS agents_that_vanish,
  100*sum(k)/sum(n) AS pct FROM presa GROUP BY 1,2"""}


@query("post_event_presence", "SELECT * FROM pres", ctes=PRES)
def _(v):
    return E.post_event_presence(v.sidx, v.panel_end)


@query("disappearance_rates", """SELECT *, greatest(0.0, 100*((gone/n+1.96*1.96/(2*n))/(1+1.96*1.96/n)-1.96*sqrt(gone/n*(1-gone/n)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n))) AS wilson_lo,
  least(100.0, 100*((gone/n+1.96*1.96/(2*n))/(1+1.96*1.96/n)+1.96*sqrt(gone/n*(1-gone/n)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n))) AS wilson_hi FROM prest""", "pct wilson_lo wilson_hi", ctes=PRES)
def _(v):
    return E.disappearance_rates(E.post_event_presence(v.sidx, v.panel_end))


# ---- window estimators ----------------------------------------------------------------------------
@query("window_mean", """SELECT a_id, i, avg(p404) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre,
  avg(p404) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS post FROM sidx""", "pre post")
def _(v):
    return v.sidx.select("a_id", "i", W.window_mean("p404", "pre").alias("pre"), W.window_mean("p404", "post").alias("post"))


def _deltas_sql():
    fs = W.RESPONSE_FEATURES
    pre = ", ".join(f"{f}-lag({f}) OVER (PARTITION BY a_id,label ORDER BY i) AS s_{f}, avg({f}) OVER q - avg({f}) OVER p AS d_{f}" for f in fs)
    vol = ", ".join(f"stddev_pop(s_{f}) OVER (PARTITION BY a_id,label) AS v_{f}" for f in fs)
    out = ", ".join(f"avg(d_{f}) AS d_{f}, avg(abs(d_{f})/(v_{f}+1e-9)) AS z_{f}" for f in fs)
    return {"ed1": f"SELECT *, {pre} FROM active WINDOW p AS (PARTITION BY a_id,label ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY a_id,label ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)",
            "ed2": f"SELECT *, {vol} FROM ed1",
            "edelta": f"SELECT a_id, label, count(*) AS n_events, {out} FROM ed2 JOIN rev5 USING (a_id,label,i) WHERE i>=5 AND i+5<n GROUP BY 1,2"}


DELTAS = _deltas_sql()
DELTA_COLS = " ".join(f"{k}_{f}" for f in W.RESPONSE_FEATURES for k in "dz")


@query("event_deltas", "SELECT * FROM edelta", DELTA_COLS, ctes=DELTAS)
def _(v):
    return W.event_deltas(v.active)


CURVE_F = ["evasion_index", "ip_ent", "compliance"]
CURVES = {"ecv": " UNION ALL ".join(f"""SELECT e.a_id, e.label, e.i, '{f}' AS feature, t::BIGINT AS t, s.{f}-b.pre AS value FROM rev5 e CROSS JOIN off11 JOIN active s ON s.a_id=e.a_id AND s.label=e.label AND s.i=e.i+t
  JOIN (SELECT a_id, label, i, avg({f}) OVER (PARTITION BY a_id,label ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre FROM active) b ON b.a_id=e.a_id AND b.label=e.label AND b.i=e.i
  WHERE e.i>=5 AND e.i+5<s.n""" for f in CURVE_F)}


@query("event_curves", "SELECT label, feature, t, avg(value) AS mean, stddev_pop(value)/sqrt(count(value)) AS sem, count(value) AS n FROM ecv GROUP BY 1,2,3", "mean sem", ctes=CURVES)
def _(v):
    d = E.flag_pressure_events(v.active).withColumn("full", F.col("kept") & E.eligible(5, 5))
    return W.curve_summary(W.event_curves(d, "full", CURVE_F, ["a_id", "label"]), "label")


@query("aligned_profile", """SELECT pop AS grp, t, avg(v) AS mean, stddev_pop(v)/sqrt(count(v)) AS sem, count(v) AS n_agents FROM (SELECT e.a_id, s.pop, t::BIGINT AS t, avg(s.robots_rate-b.pre) AS v
  FROM sev11 e CROSS JOIN off11 JOIN sidx s ON s.a_id=e.a_id AND s.i=e.i+t JOIN (SELECT a_id, i, avg(robots_rate) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre FROM sidx) b
  ON b.a_id=e.a_id AND b.i=e.i WHERE e.i>=5 AND e.i+5<s.n AND s.n>=20 GROUP BY 1,2,3) GROUP BY 1,2""", "mean sem")
def _(v):
    return W.aligned_profile(v.sidx, "pop")


@query("reference_frame", "SELECT * FROM sframe", "u1 s1 u2 s2 u3 s3")
def _(v):
    return v.sframe


@query("observability", "SELECT a_id, date, o FROM sobs", "o")
def _(v):
    return v.sobs.select("a_id", "date", "o")


_sql, _c = did("w7", "sunit", "d_o")


@query("observability_did", _sql, DID_DOUBLES, ctes=_c)
def _(v):
    return two_arms(W.agent_did_units(W.event_outcomes(v.sobs)), "d_o")


_sql, _c = did("w8", "sunit", "d_o_stealth")


@query("stealth_did", _sql, DID_DOUBLES, ctes=_c)
def _(v):
    return two_arms(W.agent_did_units(W.event_outcomes(v.sobs)), "d_o_stealth")


CAL = {"calev": """SELECT a_id, arm, date, CASE WHEN date+5>pe THEN 'censored' WHEN date=first THEN 'no_baseline' WHEN date+5>last AND post=0 THEN 'disappeared' WHEN post<0.5*pre THEN 'retreated' ELSE 'persisted' END AS outcome
  FROM (SELECT e.a_id, s.arm, s.date, min(f.first) AS first, min(f.last) AS last, (SELECT panel_end FROM panel_end) AS pe,
   coalesce(sum(x.hits) FILTER (x.date>=s.date-5 AND x.date<s.date),0)/least(5, s.date-min(f.first)) AS pre,
   CASE WHEN min(f.last)>s.date THEN coalesce(sum(x.hits) FILTER (x.date>s.date AND x.date<=s.date+5),0)/least(5, min(f.last)-s.date) ELSE 0.0 END AS post
   FROM sev16 e JOIN sidx s ON s.a_id=e.a_id AND s.i=e.i JOIN (SELECT a_id, min(date) AS first, max(date) AS last FROM sidx GROUP BY 1) f ON f.a_id=e.a_id
   JOIN sidx x ON x.a_id=e.a_id AND x.date BETWEEN s.date-5 AND s.date+5 WHERE e.i>=5 AND s.n>=20 GROUP BY 1,2,3)"""}


@query("calendar_retreat", """SELECT *, n_disappear/evaluable AS disappear_share, n_retreat/evaluable AS retreat_share, (n_disappear+n_retreat)/evaluable AS exit_share FROM
  (SELECT arm, count(DISTINCT a_id) AS n_agents, count(*) AS n_events_all, count(*) FILTER (outcome='censored') AS n_censored, count(*) FILTER (outcome='disappeared') AS n_disappear,
  count(*) FILTER (outcome='retreated') AS n_retreat, count(*) FILTER (outcome='persisted') AS n_persist, count(*) FILTER (outcome<>'censored') AS evaluable FROM calev GROUP BY 1)""",
       "disappear_share retreat_share exit_share", ctes=CAL)
def _(v):
    return W.retreat_summary(W.calendar_retreat(v.sidx, v.panel_end))


@query("retreat_by_cut", """SELECT arm AS grp, cut, count(*) AS n_events, count(*) FILTER (r<1-cut) AS n_retreat, avg((r<1-cut)::INT::DOUBLE) AS share FROM
  (SELECT arm, (exp(post_lv)-1)/greatest(exp(pre_lv)-1,1e-9) AS r FROM swin JOIN sev11 USING (a_id,i) WHERE i>=5 AND i+5<n), (SELECT unnest([0.3,0.5,0.7])::DOUBLE AS cut) GROUP BY 1,2""", "cut share")
def _(v):
    return W.retreat_by_cut(v.sidx, "arm")


CH = {"ch1": """SELECT *, robots_rate-lag(robots_rate) OVER (PARTITION BY a_id ORDER BY i) AS s, avg(p404) OVER q-avg(p404) OVER p AS d_p404, avg(robots_rate) OVER q-avg(robots_rate) OVER p AS d_robots,
  avg(loghits) OVER q-avg(loghits) OVER p AS d_loghits FROM sidx WINDOW p AS (PARTITION BY a_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""",
      "ch2": "SELECT *, coalesce(stddev_pop(s) OVER (PARTITION BY a_id),0) AS vol FROM ch1",
      "ch3": """SELECT a_id, pop, avg(d_p404) AS d_p404, avg(d_robots) AS d_robots, avg(d_loghits) AS d_loghits, avg(abs(d_robots)/(vol+1e-9)) AS z_robots FROM ch2 JOIN sev11 USING (a_id,i)
  WHERE n>=20 AND i>=5 AND i+5<n GROUP BY 1,2""",
      "ch4": "SELECT a_id, pop, channel, value FROM ch3 UNPIVOT (value FOR channel IN (d_p404, d_robots, d_loghits, z_robots))",
      "ch5": " UNION ALL ".join(f"SELECT a_id, '{a}_vs_{b}' AS pair, CASE WHEN pop='{a}' THEN 'a' ELSE 'b' END AS side, channel, value FROM ch4 WHERE pop IN ('{a}','{b}')" for a, b in W.PAIRINGS)}
_sql, _c = did("w11", "ch5", "value", "a", "b", "side", "pair, channel")


@query("response_channels", _sql, DID_DOUBLES, ctes=CH | _c)
def _(v):
    return mean_difference(W.pair_sides(W.response_channels(v.sidx)), "a_id", "value", "side", "a", "b", ["pair", "channel"])


TR = {"tru": "SELECT DISTINCT a_id, arm FROM traj11"} | boot("trb", "tru", "a_id", "arm") | {
    "trm": "SELECT d.rep, d.arm, t, avg(v) AS m FROM trb_d d JOIN traj11 j ON j.a_id=d.a_id GROUP BY 1,2,3",
    "trd": "SELECT rep, t, max(m) FILTER (arm='abusive')-max(m) FILTER (arm='verified') AS d FROM trm GROUP BY 1,2",
    "tro": "SELECT t, avg(v) FILTER (arm='abusive') AS ma, avg(v) FILTER (arm='verified') AS mb FROM traj11 GROUP BY 1",
    "trq": "SELECT t, quantile_cont(d,0.025) AS lo, quantile_cont(d,0.975) AS hi FROM trd GROUP BY 1",
    "spans": "SELECT 'near' AS span, -5 AS a, -1 AS b UNION ALL SELECT 'far', -10, -6"}


@query("event_time_study", "SELECT t::BIGINT AS t, ma AS mean_abusive, mb AS mean_verified, ma-mb AS diff, lo AS diff_lo, hi AS diff_hi FROM tro JOIN trq USING (t)",
       "mean_abusive mean_verified diff diff_lo diff_hi", ctes=TR)
def _(v):
    d = E.flag_block_events(v.sobs, {"kept": 11})
    return W.event_time_study(W.agent_trajectories(d, "kept"))


@query("pretrend_test", """SELECT span, slope, slope_lo, slope_hi, n_excluding_zero FROM (SELECT span, regr_slope(ma-mb,t) AS slope FROM tro JOIN spans ON t BETWEEN a AND b GROUP BY 1)
  JOIN (SELECT span, quantile_cont(s,0.025) AS slope_lo, quantile_cont(s,0.975) AS slope_hi FROM (SELECT span, rep, regr_slope(d,t) AS s FROM trd JOIN spans ON t BETWEEN a AND b GROUP BY 1,2) GROUP BY 1) USING (span)
  JOIN (SELECT span, count(*) FILTER (lo>0 OR hi<0) AS n_excluding_zero FROM trq JOIN spans ON t BETWEEN a AND b GROUP BY 1) USING (span)""", "slope slope_lo slope_hi", ctes=TR)
def _(v):
    d = E.flag_block_events(v.sobs, {"kept": 11})
    return W.pretrend_test(W.agent_trajectories(d, "kept"))


SG = {"sgx": """SELECT a_id, arm, i, n, coord, x, robots_rate, loghits FROM (SELECT *, p404 AS baseline, p404_bi AS nonblocked, CASE WHEN c404+c200>0 THEN c404/(c404+c200) END AS vs200 FROM sidx WHERE n>=20)
        UNPIVOT INCLUDE NULLS (x FOR coord IN (baseline, nonblocked, vs200))""",
      "sgf": """SELECT coord, avg(m1) AS u1, stddev_pop(m1)+1e-9 AS s1, avg(m2) AS u2, stddev_pop(m2)+1e-9 AS s2, avg(m3) AS u3, stddev_pop(m3)+1e-9 AS s3 FROM
        (SELECT coord, a_id, avg(x) AS m1, avg(robots_rate) AS m2, avg(loghits) AS m3 FROM sgx WHERE arm='verified' GROUP BY 1,2) GROUP BY 1""",
      "sgo": "SELECT a_id, arm, i, n, g.coord, sqrt(pow((x-u1)/s1,2)+pow((robots_rate-u2)/s2,2)+pow((loghits-u3)/s3,2)) AS o FROM sgx g JOIN sgf f ON f.coord=g.coord",
      "sge": " UNION ALL ".join(f"SELECT {g}::BIGINT AS spacing, a_id, i FROM sev{g}" for g in (5, 11, 15, 16, 21)),
      "sgt": "SELECT e.spacing, s.coord, e.a_id, s.arm, t, avg(o) AS v FROM sge e CROSS JOIN off21 JOIN sgo s ON s.a_id=e.a_id AND s.i=e.i+t WHERE e.i>=10 AND e.i+10<s.n GROUP BY 1,2,3,4,5",
      "sgc": "SELECT w::BIGINT AS w, gap::BIGINT AS gap FROM (SELECT unnest([3,5,7]) AS w), (SELECT unnest([0,1,3,5]) AS gap)",
      "sgu": """SELECT spacing, coord, w, gap, a_id, arm, avg(v) FILTER (t BETWEEN 1 AND w)-avg(v) FILTER (t BETWEEN -(gap+w) AND -(gap+1)) AS d FROM sgt, sgc GROUP BY 1,2,3,4,5,6""",
      "sgd": "SELECT coord, spacing, w, gap, avg(d) FILTER (arm='abusive')-avg(d) FILTER (arm='verified') AS did FROM sgu GROUP BY 1,2,3,4"}
_sql, _c = did("w14", "sgu", "d", by="coord, spacing, w, gap")


@query("spec_grid", _sql, DID_DOUBLES, ctes=SG | _c)
def _(v):
    return two_arms(W.spec_units(v.sidx, is_arm("verified")), "d", by=["coord", "spacing", "w", "gap"])


@query("grid_rank", """SELECT coord, spacing, w, gap, did, (SELECT 100*avg((g.did<=c.did)::INT::DOUBLE) FROM sgd g) AS percentile FROM sgd c WHERE coord='nonblocked' AND spacing=16 AND w=5 AND gap=5""",
       "did percentile", ctes=SG)
def _(v):
    u = W.spec_units(v.sidx, is_arm("verified"))
    grid = materialize(u.groupBy("coord", "spacing", "w", "gap").agg(
        (F.avg(F.when(is_arm("abusive"), F.col("d"))) - F.avg(F.when(is_arm("verified"), F.col("d")))).alias("did")))
    mine = grid.where("coord = 'nonblocked' and spacing = 16 and w = 5 and gap = 5")
    rank = grid.select(F.col("did").alias("_d")).crossJoin(F.broadcast(mine.select(F.col("did").alias("_x")))).agg(
        (100 * F.avg((F.col("_d") <= F.col("_x")).cast("double"))).alias("percentile"))
    return mine.crossJoin(F.broadcast(rank))


FPL = {"fpl": """SELECT a_id, arm, avg(v) FILTER (t>=1)-regr_intercept(v,t) FILTER (t<=-1)-regr_slope(v,t) FILTER (t<=-1)*avg(t) FILTER (t>=1 AND v IS NOT NULL) AS d
  FROM traj16 GROUP BY 1,2 HAVING count(v) FILTER (t<=-1)>=4""",
       "seg1": "SELECT a_id, arm, t, v, (t>0)::INT::DOUBLE AS p FROM traj16 WHERE t<>0 AND v IS NOT NULL",
       "seg2": "SELECT a_id, arm, regr_slope(p,t) AS b, regr_intercept(p,t) AS a FROM seg1 GROUP BY 1,2 HAVING count(*)>=6",
       "segs": "SELECT s.a_id, s.arm, sum((p-a-b*t)*v)/sum((p-a-b*t)*(p-a-b*t)) AS d FROM seg1 s JOIN seg2 r ON r.a_id=s.a_id GROUP BY 1,2"}
_sql, _c = did("w15", "fpl", "d")


@query("full_pre_linear", _sql, DID_DOUBLES, ctes=FPL | _c)
def _(v):
    t = W.agent_trajectories(E.flag_block_events(v.sobs, {"kept": 16}), "kept", ref=None)
    return two_arms(W.full_pre_linear(W.long_trajectories(t)), "d")


_sql, _c = did("w16", "segs", "d")


@query("segmented_level_shift", _sql, DID_DOUBLES, ctes=FPL | _c)
def _(v):
    t = W.agent_trajectories(E.flag_block_events(v.sobs, {"kept": 16}), "kept", ref=None)
    return two_arms(W.segmented_level_shift(W.long_trajectories(t)), "d")


SC = {"sr": "SELECT s.*, label AS arm, score FROM active s LEFT JOIN scores c ON c.a_id=s.a_id AND c.date=s.date WHERE label IN ('bot','human')",
      "sre": """SELECT * FROM (SELECT a_id, arm, label, i, n, avg(score) OVER q-avg(score) OVER p AS d_score, avg(resistance) OVER q-avg(resistance) OVER p AS d_resistance, avg(hits) OVER q/avg(hits) OVER p AS vol_ratio FROM sr
        WINDOW p AS (PARTITION BY a_id,label ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY a_id,label ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) JOIN rev5 USING (a_id,label,i)
        WHERE i>=5 AND i+5<n AND d_score IS NOT NULL""",
      "sru": """SELECT 'score' AS outcome, a_id, arm, sum(d_score) AS s, count(d_score) AS k FROM sre GROUP BY a_id, arm UNION ALL
        SELECT 'score_stealth', a_id, arm, sum(CASE WHEN vol_ratio>=0.5 THEN d_score END), count(CASE WHEN vol_ratio>=0.5 THEN d_score END) FROM sre GROUP BY a_id, arm UNION ALL
        SELECT 'resistance', a_id, arm, sum(d_resistance), count(d_resistance) FROM sre GROUP BY a_id, arm"""} | boot("srb", "sru", "a_id", "outcome, arm", 4000) | {
      "srr": "SELECT outcome, rep, sum(s) FILTER (arm='bot')/sum(k) FILTER (arm='bot')-sum(s) FILTER (arm='human')/sum(k) FILTER (arm='human') AS stat FROM srb_d GROUP BY 1,2"}


@query("score_event_study", """SELECT outcome, mean_a, mean_b, mean_a-mean_b AS did, n_a, n_b, ci_lo, ci_hi FROM (SELECT outcome, sum(s) FILTER (arm='bot')/sum(k) FILTER (arm='bot') AS mean_a,
  sum(s) FILTER (arm='human')/sum(k) FILTER (arm='human') AS mean_b, (sum(k) FILTER (arm='bot'))::BIGINT AS n_a, (sum(k) FILTER (arm='human'))::BIGINT AS n_b FROM sru GROUP BY 1)
  JOIN (SELECT outcome, quantile_cont(stat,0.025) AS ci_lo, quantile_cont(stat,0.975) AS ci_hi FROM srr GROUP BY 1) USING (outcome)""", DID_DOUBLES, ctes=SC)
def _(v):
    d = v.active.where(F.col("label").isin("bot", "human")).withColumn("arm", F.col("label"))
    return W.pooled_difference(W.pooled_units(W.score_events(d, v.scores)), "bot", "human", reps=4000)


@query("align_window_scores", """SELECT a_id, i, CASE WHEN i>=29 THEN avg(score) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS score
  FROM sidx s JOIN sscores c ON c.a_id=s.a_id AND c.date=s.date""".replace("SELECT a_id", "SELECT s.a_id").replace("PARTITION BY a_id", "PARTITION BY s.a_id"), "score")
def _(v):
    d = v.sidx.join(v.sscores, ["a_id", "date"]).withColumn("m", W.frame_mean("score", 0, 29))
    windows = d.where("i + 29 < n").select("a_id", F.col("i").alias("w"), F.col("m").alias("score"))
    return W.align_window_scores(v.sidx, windows).select("a_id", "i", "score")


MO = {"mo": "SELECT arm AS grp, strftime(date,'%Y-%m') AS month, avg(o) AS mean_o, count(DISTINCT a_id) AS n_agents FROM sobs GROUP BY 1,2",
      "mox": "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY month)-1 AS x, count(*) OVER (PARTITION BY grp) AS k FROM mo"}


@query("monthly_observability", "SELECT * FROM mo", "mean_o", ctes=MO)
def _(v):
    return W.monthly_observability(v.sobs, "arm")


@query("monthly_slope", """SELECT *, sign(slope)<>sign(slope_excluding_last) AS sign_reverses FROM (SELECT grp, count(*) AS n_months, regr_slope(mean_o,x) AS slope,
  regr_slope(mean_o,x) FILTER (x<k-1) AS slope_excluding_last, max(month) AS last_month FROM mox GROUP BY 1)""", "slope slope_excluding_last", ctes=MO, digits=6)
def _(v):
    return W.monthly_slope(W.monthly_observability(v.sobs, "arm"))


OV = {"ovf": """SELECT *, (c22*c33-c23*c23) AS a11, (c13*c23-c12*c33) AS a12, (c12*c23-c13*c22) AS a13, (c11*c33-c13*c13) AS a22, (c12*c13-c11*c23) AS a23, (c11*c22-c12*c12) AS a33,
        c11*(c22*c33-c23*c23)-c12*(c12*c33-c23*c13)+c13*(c12*c23-c22*c13) AS dt FROM (SELECT covar_samp(m1,m1) AS c11, covar_samp(m1,m2) AS c12, covar_samp(m1,m3) AS c13, covar_samp(m2,m2) AS c22,
        covar_samp(m2,m3) AS c23, covar_samp(m3,m3) AS c33 FROM sprof WHERE arm='verified'), sframe""",
      "ovs": "SELECT avg(m1) AS x1, stddev_pop(m1)+1e-9 AS y1, avg(m2) AS x2, stddev_pop(m2)+1e-9 AS y2, avg(m3) AS x3, stddev_pop(m3)+1e-9 AS y3 FROM sprof WHERE pop='verified'",
      "ovo": """SELECT a_id, arm, i, n, sqrt(pow(e1/s1,2)+pow(e2/s2,2)+pow(e3/s3,2)) AS base, sqrt(pow(e1/s1,2)+pow(e2/s2,2)) AS novol,
        sqrt(greatest((a11*e1*e1+a22*e2*e2+a33*e3*e3+2*(a12*e1*e2+a13*e1*e3+a23*e2*e3))/dt,0)) AS maha, sqrt(pow((p404_bi-x1)/y1,2)+pow((robots_rate-x2)/y2,2)+pow((loghits-x3)/y3,2)) AS strict_centroid
        FROM (SELECT s.*, p404_bi-u1 AS e1, robots_rate-u2 AS e2, loghits-u3 AS e3, f.* FROM sidx s, ovf f WHERE n>=20), ovs""",
      "ovu": " UNION ALL ".join(f"""SELECT a_id, arm, '{x}' AS variant, avg(d) AS d_o FROM (SELECT a_id, arm, i, n, avg({x}) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)
        -avg({x}) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING) AS d FROM ovo) JOIN sev16 USING (a_id,i) WHERE i>=10 AND i+5<n GROUP BY a_id, arm"""
                                for x in ("base", "maha", "novol", "strict_centroid"))}
_sql, _c = did("w22", "ovu", "d_o", by="variant")


@query("observability_variants", _sql, DID_DOUBLES, ctes=OV | _c)
def _(v):
    return two_arms(W.variant_units(v.sidx, is_arm("verified"), F.col("pop") == "verified"), "d_o", by=["variant"])


@query("agent_observability", """SELECT a_id, arm, count(*) AS n_days, sqrt(pow((avg(p404_bi)-max(u1))/max(s1),2)+pow((avg(robots_rate)-max(u2))/max(s2),2)+pow((avg(loghits)-max(u3))/max(s3),2)) AS o_meanvec,
  avg(o) AS o_dailymean FROM sobs, sframe GROUP BY 1,2""", "o_meanvec o_dailymean")
def _(v):
    return W.agent_observability(v.sidx, v.sframe)


BX = {"bxp": "SELECT a_id, arm, avg(p404) AS m1, avg(robots_rate) AS m2, avg(loghits) AS m3 FROM sidx WHERE n>=20 GROUP BY 1,2",
      "bxf": "SELECT avg(m1) AS u1, stddev_pop(m1)+1e-9 AS s1, avg(m2) AS u2, stddev_pop(m2)+1e-9 AS s2, avg(m3) AS u3, stddev_pop(m3)+1e-9 AS s3 FROM bxp WHERE arm='verified'",
      "bxb": "SELECT avg(m1) AS b1, avg(m2) AS b2, avg(m3) AS b3 FROM bxp WHERE arm='abusive'",
      "bxz": "SELECT f.*, (b1-u1)/s1 AS z1, (b2-u2)/s2 AS z2, (b3-u3)/s3 AS z3 FROM bxb, bxf f",
      "axis": "SELECT u1,s1,u2,s2,u3,s3, z1/(b+1e-9) AS axis1, z2/(b+1e-9) AS axis2, z3/(b+1e-9) AS axis3, b AS bot_centroid_b FROM (SELECT *, sqrt(z1*z1+z2*z2+z3*z3) AS b FROM bxz)",
      "sbot": "SELECT s.*, (p404-u1)/s1*axis1+(robots_rate-u2)/s2*axis2+(loghits-u3)/s3*axis3 AS b FROM sidx s, axis"}


@query("botness_axis", "SELECT * FROM axis", "u1 s1 u2 s2 u3 s3 axis1 axis2 axis3 bot_centroid_b", ctes=BX)
def _(v):
    return W.botness_axis(v.sidx, is_arm("abusive"), is_arm("verified"))


@query("botness_series", "SELECT a_id, date, b FROM sbot", "b", ctes=BX)
def _(v):
    return W.botness_series(v.sidx, W.botness_axis(v.sidx, is_arm("abusive"), is_arm("verified"))).select("a_id", "date", "b")


@query("robots_engagement", """SELECT *, max(pct_ever_robots) FILTER (grp='declared') OVER ()/max(pct_ever_robots) FILTER (grp='abusive') OVER () AS declared_over_abusive FROM
  (SELECT grp, count(*) AS n_declared, count(*) FILTER (days>=20) AS n_qualifying, count(*) FILTER (days>=20 AND top>0) AS n_ever_robots,
  100*count(*) FILTER (days>=20 AND top>0)/greatest(count(*) FILTER (days>=20),1) AS pct_ever_robots FROM (SELECT a_id, pop AS grp, count(*) AS days, max(robots_rate) AS top FROM sidx GROUP BY 1,2) GROUP BY 1)""",
       "pct_ever_robots declared_over_abusive")
def _(v):
    return W.robots_engagement(v.sidx, "pop")
