"""Registered queries: trajectories, mixtures, calibration."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.functions.resample import mean_difference
from rebuff.operators import panel as P, trajectory as C, windows as W
from rebuff.oracle.ctes import DID_DOUBLES, did
from rebuff.plans.event_queries import DELTAS
from rebuff.plans.inference_queries import AC, TREND, autocorr_sql, kendall_sql, pettitt_sql
from rebuff.plans.registry import query
from rebuff.session import materialize

SF = ("p404", "p200", "robots", "ip_ent", "dom_ent", "ctry_ent")
GS = {"gs": "SELECT " + ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f})=0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}" for f in SF) + " FROM sfeat",
      "gsd": f"SELECT a_id, arm, sqrt({'+'.join(f'pow((avg({f}) FILTER (i>=n-greatest(1,floor(0.2*n)))-avg({f}) FILTER (i<greatest(1,floor(0.2*n))))/max(s_{f}),2)' for f in SF)}) AS lifecycle_drift FROM sfeat, gs WHERE n>=30 GROUP BY 1,2"}


@query("global_scaler", "SELECT * FROM gs", " ".join(f"m_{f} s_{f}" for f in SF), ctes=GS)
def _(v):
    return C.global_scaler(v.sfeat, SF)


@query("lifecycle_drift", "SELECT * FROM gsd", "lifecycle_drift", ctes=GS)
def _(v):
    d = materialize(v.sfeat)
    return C.lifecycle_drift(d, C.global_scaler(d, SF), SF, ["a_id", "arm"])


@query("trajectory_summary", """SELECT arm, count(*) AS n_agents, 100*avg((oscillation>0.25)::INT) AS pct_oscillatory, quantile_cont(lifecycle_drift,0.5) AS median_drift,
  quantile_cont(adaptation_time,0.5) AS median_adaptation_time, quantile_cont(osc_period,0.5) AS median_osc_period FROM gsd JOIN sv_a USING (a_id,arm) JOIN sv_q USING (a_id,arm) GROUP BY 1""",
       "pct_oscillatory median_drift median_adaptation_time median_osc_period", ctes=GS | AC)
def _(v):
    return C.trajectory_summary(C.trajectory_metrics(v.sfeat, SF, ["a_id", "arm"]), "arm")


MEANS = ", ".join(f"avg({f}) AS {f}" for f in C.PROFILE if f not in ("log_hits", "activity_rate"))
PROF = {"prof": f"SELECT a_id, label, ln(1+avg(hits)) AS log_hits, {MEANS}, count(*)/(max(day)-min(day)+1) AS activity_rate, count(*) AS n_active FROM active GROUP BY 1,2"}
PCOLS = " ".join(C.PROFILE)


@query("agent_profile", "SELECT * FROM prof", PCOLS, ctes=PROF)
def _(v):
    return C.agent_profile(v.active, ["a_id", "label"])


@query("strategy_mixture")
def _(v):
    prof = materialize(C.agent_profile(v.active, ["a_id", "label"]))
    _model, comp = C.strategy_mixture(prof)
    return C.strategy_mix(comp, C.name_components(comp), ["label"])


NC = PROF | {"pc": "SELECT *, (a_id%3)::INTEGER AS component FROM prof", "pcc": f"SELECT component, {', '.join(f'avg({f}) AS {f}' for f in C.PROFILE)} FROM pc GROUP BY 1",
             "pz": "SELECT component, " + ", ".join(f"({f}-avg({f}) OVER ())/(stddev_pop({f}) OVER ()+1e-9) AS {f}" for f in C.PROFILE) + " FROM pcc",
             "ps": "SELECT component, evasion_index+ip_ent+url_ent AS e, log_hits+p200-evasion_index AS v, husource-log_hits-p200 AS m FROM pz",
             "pe": "SELECT component FROM ps ORDER BY e DESC, component LIMIT 1", "pv": "SELECT component FROM ps WHERE component NOT IN (SELECT component FROM pe) ORDER BY v DESC, component LIMIT 1",
             "pn": "SELECT component, CASE WHEN component IN (SELECT component FROM pe) THEN 'evasive' WHEN component IN (SELECT component FROM pv) THEN 'visible' ELSE 'mimicry' END AS strategy FROM ps"}


def fixed_components(v):
    return C.agent_profile(v.active, ["a_id", "label"]).withColumn("component", (F.col("a_id") % 3).cast("int"))


@query("name_components", "SELECT * FROM pn", ctes=NC)
def _(v):
    return C.name_components(fixed_components(v))


@query("strategy_mix", """SELECT label, count(*) AS n, avg((strategy='visible')::INT) AS visible, avg((strategy='evasive')::INT) AS evasive, avg((strategy='mimicry')::INT) AS mimicry
  FROM pc JOIN pn USING (component) GROUP BY 1""", "visible evasive mimicry", ctes=NC)
def _(v):
    d = materialize(fixed_components(v))
    return C.strategy_mix(d, C.name_components(d), ["label"])


@query("lifecycle_thirds", f"""SELECT a_id, label, stage, ln(1+avg(hits)) AS log_hits, {MEANS}, count(*)/(max(day)-min(day)+1) AS activity_rate, count(*) AS n_active FROM
  (SELECT *, CASE WHEN i<n//3 THEN 'early' WHEN i<(2*n)//3 THEN 'mid' ELSE 'late' END AS stage FROM active) GROUP BY 1,2,3""", PCOLS)
def _(v):
    return C.agent_profile(C.lifecycle_thirds(v.active), ["a_id", "label", "stage"])


STG = NC | {"sg": """SELECT *, ((a_id+CASE stage WHEN 'early' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END)%3)::INTEGER AS component FROM (SELECT DISTINCT a_id, label, stage FROM
  (SELECT *, CASE WHEN i<n//3 THEN 'early' WHEN i<(2*n)//3 THEN 'mid' ELSE 'late' END AS stage FROM active))"""}


@query("lifecycle_mix", """SELECT label, stage, count(*) AS n, avg((strategy='visible')::INT) AS visible, avg((strategy='evasive')::INT) AS evasive, avg((strategy='mimicry')::INT) AS mimicry
  FROM sg JOIN pn USING (component) GROUP BY 1,2""", "visible evasive mimicry", ctes=STG)
def _(v):
    d = materialize(fixed_components(v))
    turn = F.when(F.col("stage") == "early", 0).when(F.col("stage") == "mid", 1).otherwise(2)
    stages = C.agent_profile(C.lifecycle_thirds(v.active), ["a_id", "label", "stage"]).withColumn("component", ((F.col("a_id") + turn) % 3).cast("int"))
    return C.strategy_mix(stages, C.name_components(d), ["label", "stage"])


VV = {"vl": "SELECT a_id, label, i, log_hits AS value FROM active"} | {k: x for k, x in kendall_sql("vl", "a_id,label").items() if k == "vl_f"} | autocorr_sql("vl", "a_id,label") | {
    "vv": """SELECT a_id, label, max(s)/(max(m)+1e-9) AS volume_cv, avg((hits>m+2*s)::INT) AS burst_frac FROM (SELECT *, avg(hits) OVER (PARTITION BY a_id,label) AS m, stddev_pop(hits) OVER (PARTITION BY a_id,label) AS s FROM active) GROUP BY 1,2"""}


@query("volume_volatility", """SELECT label, quantile_cont(volume_cv,0.5) AS median_volume_cv, quantile_cont(burst_frac,0.5) AS median_burst_frac, quantile_cont(adaptation_time,0.5) AS median_volume_autocorr_time
  FROM vv JOIN vl_a USING (a_id,label) GROUP BY 1""", "median_volume_cv median_burst_frac median_volume_autocorr_time", ctes=VV)
def _(v):
    d = materialize(C.volume_volatility(v.active, ["a_id", "label"]))
    return C.medians(d, ["label"], {c: f"median_{c}" for c in ("volume_cv", "burst_frac", "volume_autocorr_time")})


NS = {"nl": "SELECT a_id, label, feature, i, value FROM (SELECT a_id, label, i, " + ", ".join(f"{f}::DOUBLE AS {f}" for f in C.TEST_FEATURES) + f" FROM active) UNPIVOT (value FOR feature IN ({', '.join(C.TEST_FEATURES)}))"} | kendall_sql("nl", "a_id,label,feature") | pettitt_sql("nl", "a_id,label,feature") | {
    "ns": "SELECT * FROM nl_k JOIN nl_e USING (a_id,label,feature)",
    "nss": """SELECT label, feature, count(*) AS n_agents, 100*avg((direction=1)::INT) AS pct_trend_up, 100*avg((direction=-1)::INT) AS pct_trend_down, 100*avg((direction<>0)::INT) AS pct_any_trend,
      100*avg(significant::INT) AS pct_changepoint, quantile_cont(abs(tau),0.5) AS median_abs_tau, quantile_cont(cp_effect,0.5) AS median_cp_effect FROM ns GROUP BY 1,2""",
    "nsf": """SELECT feature, max(pct_trend_up) FILTER (label='bot')-max(pct_trend_up) FILTER (label='human') AS diff_up, max(pct_trend_up-pct_trend_down) FILTER (label='bot')
      -max(pct_trend_up-pct_trend_down) FILTER (label='human') AS diff_net FROM nss GROUP BY 1"""}


@query("nonstationarity", "SELECT * FROM nss", "pct_trend_up pct_trend_down pct_any_trend pct_changepoint median_abs_tau median_cp_effect", ctes=NS)
def _(v):
    return C.nonstationarity_summary(C.nonstationarity(v.active))


@query("trend_fingerprint", """SELECT *, row_number() OVER (ORDER BY diff_up DESC, feature)<=4 AS in_top, row_number() OVER (ORDER BY diff_up, feature)<=4 AS in_bottom FROM nsf WHERE diff_up IS NOT NULL""", "diff_up diff_net", ctes=NS)
def _(v):
    return C.trend_fingerprint(C.nonstationarity_summary(C.nonstationarity(v.active)))


@query("any_trend_rate", "SELECT label, 100*avg(x) AS pct_with_any_trend, count(*) AS n_agents FROM (SELECT a_id, label, max((direction<>0)::INT::DOUBLE) AS x FROM ns GROUP BY 1,2) GROUP BY 1", "pct_with_any_trend", ctes=NS)
def _(v):
    return C.any_trend_rate(C.nonstationarity(v.active))


@query("changepoint_timing", """SELECT CASE WHEN a_id%2=1 THEN 'abusive' ELSE 'verified' END AS arm, least(floor(cp_frac*20),19)::BIGINT AS bin, count(*) AS n FROM sl_e
  WHERE feature='evasion_index' AND significant AND cp_frac IS NOT NULL GROUP BY 1,2""", ctes=TREND)
def _(v):
    return C.changepoint_timing(C.changepoints(v.sfeat, ["evasion_index"], ["a_id", "arm"]), group="arm")


CR_COLS = [f"{k}_{f}" for k in "dz" for f in W.RESPONSE_FEATURES]
CR = DELTAS | {"crl": f"SELECT a_id, label, measure, value FROM edelta UNPIVOT (value FOR measure IN ({', '.join(CR_COLS)}))"}
_sql, _c = did("c13", "crl", "value", "bot", "human", "label", "measure")
_sql = _sql.replace("n_a>=5 AND n_b>=5", "n_a>=1 AND n_b>=1")


@query("class_response", _sql, DID_DOUBLES, ctes=CR | _c)
def _(v):
    long = W.event_deltas(v.active).unpivot(["a_id", "label"], CR_COLS, "measure", "value")
    return mean_difference(long, "a_id", "value", "label", "bot", "human", ["measure"], min_n=1)


SW_F = ["hits", *P.FEATURES]


@query("sequence_windows", f"SELECT a_id, w, last_day, (30*{len(SW_F)})::INTEGER AS n_values, total FROM (SELECT a_id, day AS w, max(day) OVER x AS last_day, count(*) OVER x AS k, sum({'+'.join(SW_F)}) OVER x AS total FROM seq14 WINDOW x AS (PARTITION BY a_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) WHERE k=30",
       "total")
def _(v):
    d = C.sequence_windows(v.seq14, SW_F)
    return d.select("a_id", "w", "last_day", F.size("sequence").alias("n_values"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total"))
