"""Registered queries: lead-lag."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.operators import inference as I, leadlag as L, populations as R
from rebuff.oracle.ctes import draw_sql
from rebuff.plans.registry import query
from rebuff.session import materialize, scratch_path

REPS = 999
SUMMARY = "n, n_responders, n_leaders, n_responders/n AS responder_share, tau_a, tau_d, tau_a+tau_d AS loop, median_abs_ccf"


def summary_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, {SUMMARY} FROM (SELECT {by}, count(*) AS n, count(*) FILTER (responder) AS n_responders, count(*) FILTER (NOT responder) AS n_leaders,
      CASE WHEN count(*) FILTER (responder)>=5 THEN quantile_cont(post_lag,0.5) FILTER (responder) END AS tau_a,
      CASE WHEN count(*) FILTER (NOT responder)>=5 THEN quantile_cont(abs(pre_lag),0.5) FILTER (NOT responder) END AS tau_d, quantile_cont(abs(post_ccf),0.5) AS median_abs_ccf FROM {src} GROUP BY {by}) WHERE n>=5"""


def ccf_sql(name: str, src: str) -> dict[str, str]:
    """src: a_id, i, r, f."""
    return {f"{name}_z": f"""SELECT a_id, i, n, (r-mr)/(sr+1e-9) AS zr, (f-mf)/(sf+1e-9) AS zf FROM (SELECT *, avg(r) OVER w AS mr, avg(f) OVER w AS mf, stddev_pop(r) OVER w AS sr, stddev_pop(f) OVER w AS sf,
              count(*) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY a_id)) WHERE sr>=1e-9 AND sf>=1e-9""",
            f"{name}_v": f"SELECT a_id, max(n) AS n, list(zr ORDER BY i) AS x, list(zf ORDER BY i) AS y FROM {name}_z GROUP BY a_id",
            name: f"SELECT a_id, lag::BIGINT AS lag, {DOT} AS ccf FROM {name}_v CROSS JOIN lags"} | peaks_sql(f"{name}_p", name)


DOT = """CASE WHEN lag>=0 THEN list_inner_product(x[lag+1:n], y[1:n-lag]) ELSE list_inner_product(x[1:n+lag], y[1-lag:n]) END/n"""


def peaks_sql(name: str, src: str, keys: str = "a_id") -> dict[str, str]:
    on = " AND ".join(f"q.{k}=p.{k}" for k in keys.split(","))
    return {f"{name}_s": f"SELECT *, row_number() OVER (PARTITION BY {keys}, lag>0 ORDER BY abs(ccf) DESC, lag) AS rn FROM {src} WHERE lag<>0 AND ccf IS NOT NULL",
            name: f"""SELECT {', '.join('q.'+k for k in keys.split(','))}, q.lag AS post_lag, q.ccf AS post_ccf, p.lag AS pre_lag, p.ccf AS pre_ccf, abs(q.ccf)>abs(p.ccf) AS responder
              FROM {name}_s q JOIN {name}_s p ON {on} AND q.lag>0 AND p.lag<0 AND q.rn=1 AND p.rn=1"""}


LL = {"lags": "SELECT unnest(generate_series(-14,14)) AS lag",
      "coh": """SELECT a_id, pop, arm, n_active, block_days, n_calendar, n_active/n_calendar AS density FROM (SELECT a_id, pop, arm, count(*) AS n_active, count(*) FILTER (cblock>0) AS block_days, stddev_pop(p_block) AS sd,
        (max(date)-min(date)+1)::BIGINT AS n_calendar FROM sidx GROUP BY 1,2,3) WHERE n_active>=30 AND block_days>=3 AND sd>=1e-9""",
      "lact": "SELECT a_id, i, p404 AS r, p_block AS f FROM sidx WHERE a_id IN (SELECT a_id FROM coh)",
      "lcald": "SELECT a_id, CAST(d AS DATE) AS date FROM (SELECT a_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM sidx WHERE a_id IN (SELECT a_id FROM coh) GROUP BY 1)",
      "lcal": "SELECT a_id, row_number() OVER (PARTITION BY a_id ORDER BY date)-1 AS i, coalesce(c404/hits,0.0) AS r, coalesce(cblock/hits,0.0) AS f FROM lcald LEFT JOIN spanel USING (a_id,date)"}
LL |= ccf_sql("cca", "lact") | ccf_sql("ccc", "lcal") | {
    "lpk": """SELECT c.*, post_lag, post_ccf, pre_lag, pre_ccf, responder, 'active' AS indexing FROM coh c LEFT JOIN cca_p USING (a_id) UNION ALL
      SELECT c.*, post_lag, post_ccf, pre_lag, pre_ccf, responder, 'calendar' AS indexing FROM coh c LEFT JOIN ccc_p USING (a_id)""",
    "lpc": "SELECT * FROM lpk WHERE indexing='calendar'",
    "msk": """SELECT a_id, lag, CASE WHEN k>=10 AND sr>=1e-9 AND sf>=1e-9 THEN cv/(sr*sf) END AS ccf FROM (SELECT a.a_id, lag::BIGINT AS lag, count(*) AS k, covar_pop(a.p404,b.p_block) AS cv, stddev_pop(a.p404) AS sr, stddev_pop(b.p_block) AS sf
      FROM sidx a CROSS JOIN lags JOIN sidx b ON b.a_id=a.a_id AND b.date=a.date-lag::INTEGER WHERE a.a_id IN (SELECT a_id FROM coh) GROUP BY 1,2)""",
    "nrep": f"SELECT unnest(generate_series(1,{REPS})) AS rep",
    "nsz": "SELECT a_id, n, 15+" + draw_sql("n-29", "a_id", "rep") + " AS off, rep FROM (SELECT a_id, max(n) AS n FROM ccc_z GROUP BY 1 HAVING max(n)>=30), nrep",
    # Circular sums at every offset from pairs of days with values, then the pairs that reach around the end off again, lag by lag.
    "nst": "SELECT a_id, n, mr, mf, (sr+1e-9)*(sf+1e-9) AS q FROM (SELECT a_id, count(*) AS n, avg(r) AS mr, avg(f) AS mf, stddev_pop(r) AS sr, stddev_pop(f) AS sf FROM lcal GROUP BY 1) WHERE n>=30 AND sr>=1e-9 AND sf>=1e-9",
    "npr": "SELECT x.a_id, (x.i-y.i+n)%n AS s, sum(x.r*y.f) AS rf FROM lcal x JOIN lcal y ON y.a_id=x.a_id AND x.r<>0 AND y.f<>0 JOIN nst ON nst.a_id=x.a_id GROUP BY 1,2",
    "nci": "SELECT a_id, s, n, (coalesce(rf,0)-n*mr*mf)/q AS c FROM (SELECT *, unnest(range(n)) AS s FROM nst) LEFT JOIN npr USING (a_id,s)",
    "ned": """SELECT x.a_id, x.n, (x.i-y.i+x.n)%x.n AS s, CASE WHEN x.i<14 THEN x.i+1 ELSE x.i-x.n END AS lag, x.zr*y.zf AS v FROM ccc_z x JOIN ccc_z y ON y.a_id=x.a_id WHERE x.n>=30 AND (x.i<14 OR x.i>=x.n-14)""",
    "new": "SELECT a_id, n, s, lag, sum(v) OVER (PARTITION BY a_id, s, lag>0 ORDER BY abs(lag)) AS w FROM ned",
    "ncc": "SELECT w.a_id, (w.s-lag+w.n)%w.n AS off, lag::BIGINT AS lag, (c-w)/w.n AS ccf FROM new w JOIN nci ON nci.a_id=w.a_id AND nci.s=w.s WHERE EXISTS (FROM nsz z WHERE z.a_id=w.a_id AND z.off=(w.s-lag+w.n)%w.n)"} | peaks_sql("nco", "ncc", "a_id,off") | {
    "ncp": "SELECT nco.*, rep FROM nsz JOIN nco ON nco.a_id=nsz.a_id AND nco.off=nsz.off",
    "lnull": """SELECT p.a_id, pop, density, rep::INTEGER AS rep, responder, CASE WHEN responder THEN post_lag END AS resp_lag, CASE WHEN NOT responder THEN abs(pre_lag) END AS lead_lag, abs(post_ccf) AS abs_ccf
      FROM ncp p JOIN coh c ON c.a_id=p.a_id"""}


def null_sql(src: str, peaks: str, by: str) -> tuple[str, dict[str, str]]:
    c = {"nr": f"SELECT {by}, rep, avg(responder::INT) AS share, quantile_cont(resp_lag,0.5) AS ma, quantile_cont(lead_lag,0.5) AS md, quantile_cont(abs_ccf,0.5) AS mc FROM {src} GROUP BY {by}, rep",
         "no": summary_sql(peaks, by),
         "nh": f"SELECT {by}, avg(coalesce(responder,false)::INT) AS share_obs, count(*) AS n_null_eligible FROM {peaks} WHERE a_id IN (SELECT a_id FROM lnull) GROUP BY {by}",
         "nj": f"SELECT * FROM nr JOIN no USING ({by}) JOIN nh USING ({by})"}
    def p(stat, obs, op):
        return f"CASE WHEN max({obs}) IS NOT NULL AND count({stat})>0 THEN (count(*) FILTER ({stat}{op}{obs})+1)/(count({stat})+1) END"
    sql = f"""SELECT {by}, max(n) AS n_all, max(n_null_eligible) AS n_null_eligible, max(responder_share) AS share_all, max(share_obs) AS share_obs, avg(share) AS share_null_mean, max(share) AS share_null_max,
      {p('share', 'share_obs', '>=')} AS p_share, max(tau_a) AS tau_a, quantile_cont(ma,0.5) AS tau_a_null_median, quantile_cont(ma,0.025) AS tau_a_null_lo, quantile_cont(ma,0.975) AS tau_a_null_hi, {p('ma', 'tau_a', '<=')} AS p_tau_a,
      max(tau_d) AS tau_d, quantile_cont(md,0.5) AS tau_d_null_median, {p('md', 'tau_d', '<=')} AS p_tau_d, max(median_abs_ccf) AS ccf_obs, avg(mc) AS ccf_null_mean, max(mc) AS ccf_null_max, {p('mc', 'median_abs_ccf', '>=')} AS p_ccf
      FROM nj GROUP BY {by}"""
    return sql, c


NULL_D = "share_all share_obs share_null_mean share_null_max p_share tau_a tau_a_null_median tau_a_null_lo tau_a_null_hi p_tau_a tau_d tau_d_null_median p_tau_d ccf_obs ccf_null_mean ccf_null_max p_ccf"


def members(v):
    return materialize(L.cohort(v.sidx))


def calendar(v):
    m = members(v)
    s = materialize(L.calendar_series(v.sidx, m))
    return m, s, m.join(L.peaks(L.ccf(s)), "a_id", "left")


@query("leadlag_cohort", "SELECT * FROM coh", "density", ctes=LL)
def _(v):
    return L.cohort(v.sidx)


@query("ccf_active", "SELECT * FROM cca", "ccf", ctes=LL)
def _(v):
    return L.ccf(L.active_series(v.sidx, members(v)))


@query("ccf_calendar", "SELECT * FROM ccc", "ccf", ctes=LL)
def _(v):
    return L.ccf(L.calendar_series(v.sidx, members(v)))


@query("ccf_masked", "SELECT c.a_id, lags.lag::BIGINT AS lag, ccf FROM coh c CROSS JOIN lags LEFT JOIN msk m ON m.a_id=c.a_id AND m.lag=lags.lag", "ccf", ctes=LL)
def _(v):
    return L.ccf_masked(v.sidx, members(v))


@query("ccf_peaks", "SELECT a_id, pop, post_lag, post_ccf, pre_lag, pre_ccf, responder FROM lpc", "post_ccf pre_ccf", ctes=LL)
def _(v):
    return calendar(v)[2].select("a_id", "pop", "post_lag", "post_ccf", "pre_lag", "pre_ccf", "responder")


@query("leadlag_summary", summary_sql("lpk", "pop, indexing"), "responder_share tau_a tau_d loop median_abs_ccf", ctes=LL)
def _(v):
    return L.leadlag_summary(L.agent_peaks(v.sidx, members(v)))


@query("circular_shift_null", "SELECT * FROM lnull", "density abs_ccf", ctes=LL)
def _(v):
    m = members(v)
    return L.shift_null(L.calendar_series(v.sidx, m), m, REPS)


_sql, _c = null_sql("lnull", "lpc", "pop")


@query("null_summary", _sql, NULL_D, ctes=LL | _c)
def _(v):
    m, s, p = calendar(v)
    return L.null_summary(materialize(L.shift_peaks(s, m, REPS), "null"), p)


BAND = {"lnb": "SELECT *, unnest([CASE WHEN density>=0.5 THEN 'dense' WHEN density>=0.25 THEN 'mid' ELSE 'sparse' END, 'ALL']) AS band FROM lnull",
        "lpb": "SELECT *, unnest([CASE WHEN density>=0.5 THEN 'dense' WHEN density>=0.25 THEN 'mid' ELSE 'sparse' END, 'ALL']) AS band FROM lpc"}
_sql, _c = null_sql("lnb", "lpb", "band")


@query("leadlag_by_density", _sql, NULL_D, ctes=LL | BAND | _c)
def _(v):
    m, s, p = calendar(v)
    return L.null_summary(L.with_bands(materialize(L.shift_peaks(s, m, REPS), "null")), L.with_bands(p), ["band"])


KM = {"kml": "SELECT pop, post_lag AS t, count(*) AS d FROM lpc WHERE responder GROUP BY 1,2",
      "kmr": "SELECT *, sum(d) OVER (PARTITION BY pop ORDER BY t DESC) AS n_risk FROM kml",
      "kms": """SELECT pop, t, n_risk::BIGINT AS n_risk, d, product(1-d/n_risk) OVER (PARTITION BY pop ORDER BY t) AS s, sum(CASE WHEN n_risk>d THEN d/(n_risk*(n_risk-d)) END) OVER (PARTITION BY pop ORDER BY t) AS g,
        min((n_risk>d)::INT) OVER (PARTITION BY pop ORDER BY t) AS fin FROM kmr WHERE t<14""",
      "kmv": "SELECT *, CASE WHEN fin=1 THEN s*s*g END AS var_greenwood, sqrt(s*s*g)/(abs(s*ln(CASE WHEN s>0 THEN s ELSE 1 END))+1e-300) AS se FROM kms",
      "km": """SELECT pop, t, n_risk, d, s, var_greenwood, CASE WHEN s>0 AND s<1 AND fin=1 THEN pow(s,exp(1.959964*se)) ELSE greatest(s-1.959964*sqrt(coalesce(var_greenwood,0)),0) END AS lo,
        CASE WHEN s>0 AND s<1 AND fin=1 THEN pow(s,exp(-1.959964*se)) ELSE least(s+1.959964*sqrt(coalesce(var_greenwood,0)),1) END AS hi FROM kmv"""}


def responder_lags(v):
    return calendar(v)[2].where("responder").select("pop", F.col("post_lag").alias("lag"))


@query("kaplan_meier", "SELECT * FROM km", "s var_greenwood lo hi", ctes=LL | KM)
def _(v):
    return I.kaplan_meier(responder_lags(v), "pop")


@query("km_median_ci", "SELECT pop, min(t) FILTER (s<=0.5) AS median, min(t) FILTER (lo<=0.5) AS ci_lo, min(t) FILTER (hi<0.5) AS ci_hi FROM km GROUP BY 1", ctes=LL | KM)
def _(v):
    return I.km_median(I.kaplan_meier(responder_lags(v), "pop"), "pop")


@query("lag_censoring", """SELECT pop, n_responders, n_boundary, 100*n_boundary/n_responders AS boundary_share_pct, median_naive, median_km FROM (SELECT pop, count(*) AS n_responders, count(*) FILTER (post_lag>=14) AS n_boundary,
  quantile_cont(post_lag,0.5) AS median_naive FROM lpc WHERE responder GROUP BY 1) LEFT JOIN (SELECT pop, min(t) FILTER (s<=0.5) AS median_km FROM km GROUP BY 1) USING (pop)""", "boundary_share_pct median_naive", ctes=LL | KM)
def _(v):
    return L.lag_censoring(calendar(v)[2])


@query("leadlag_sample", "SELECT a_id, pop, row_number() OVER (PARTITION BY pop ORDER BY md5('42:'||a_id), a_id) AS draw FROM coh", ctes=LL)
def _(v):
    return R.draw_order(members(v).select("a_id", "pop"), ["pop"])


AGAIN = {"rmx": "SELECT a_id, n, zr, lag, i-lag AS j FROM (SELECT *, unnest(generate_series(-14,14)) AS lag FROM ccc_z)",
         "rmc": "SELECT x.a_id, lag::BIGINT AS lag, sum(x.zr*y.zf)/max(x.n) AS ccf FROM rmx x JOIN ccc_z y ON y.a_id=x.a_id AND y.i=x.j GROUP BY 1,2"} | peaks_sql("rmp", "rmc")


@query("recompute_match", """SELECT count(*) AS n, avg((abs(p.post_ccf-q.post_ccf)<1e-9)::INT) AS ccf_match, avg((p.responder=q.responder)::INT) AS responder_match
  FROM ccc_p p JOIN rmp q ON q.a_id=p.a_id""", ctes=LL | AGAIN)
def _(v):
    m, s, p = calendar(v)
    path = scratch_path(v.spark, "peaks")
    p.where("post_ccf is not null").write.parquet(path)
    # The check goes another way: days looked up over windows instead of arrays.
    curves = L.windowed_curves(s)
    return L.recompute_match(v.spark.read.parquet(path), L.peaks(curves))


@query("top_ccf_curves", """SELECT c.a_id, pop, rank::INTEGER AS rank, lag, ccf FROM ccc c JOIN (SELECT a_id, pop, row_number() OVER (PARTITION BY pop ORDER BY round(abs(post_ccf),9) DESC, a_id) AS rank FROM lpc WHERE responder) t
  ON t.a_id=c.a_id""", "ccf", ctes=LL)
def _(v):
    _m, s, p = calendar(v)
    return L.ranked_curves(p, L.ccf(s)).select("a_id", "pop", "rank", "lag", "ccf")


@query("tau_distribution", "SELECT pop, indexing, post_lag, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY pop, indexing) AS density FROM lpk WHERE responder GROUP BY 1,2,3", "density", ctes=LL)
def _(v):
    return L.tau_distribution(L.agent_peaks(v.sidx, members(v)))


NS = {"nss": "SELECT pop, rep, avg(responder::INT) AS stat FROM lnull GROUP BY 1,2",
      "nso": "SELECT pop, avg(coalesce(responder,false)::INT) AS obs FROM lpc WHERE a_id IN (SELECT a_id FROM lnull) GROUP BY 1"}


def share_null(v):
    m, s, p = calendar(v)
    null = materialize(L.shift_null(s, m, REPS))
    stat = null.groupBy("pop", "rep").agg(F.avg(F.col("responder").cast("double")).alias("stat"))
    obs = p.join(null.select("a_id").distinct(), "a_id", "left_semi").groupBy("pop").agg(
        F.avg(F.coalesce(F.col("responder"), F.lit(False)).cast("double")).alias("obs"))
    return stat, obs


@query("null_percentile", "SELECT pop, obs, 100*avg((stat<obs)::INT+0.5*(stat=obs)::INT) AS percentile, count(*) AS n_null FROM nss JOIN nso USING (pop) GROUP BY 1,2", "obs percentile", ctes=LL | NS)
def _(v):
    return I.null_percentile(*share_null(v), ["pop"])


@query("permutation_p", "SELECT pop, obs, (count(*) FILTER (stat>=obs)+1)/(count(*)+1) AS p_upper, (count(*) FILTER (stat<=obs)+1)/(count(*)+1) AS p_lower FROM nss JOIN nso USING (pop) GROUP BY 1,2", "obs p_upper p_lower", ctes=LL | NS)
def _(v):
    return I.permutation_p(*share_null(v), ["pop"])
