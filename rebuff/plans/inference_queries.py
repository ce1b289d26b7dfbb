"""Registered queries: statistics and inference."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.functions.distributed import exact_quantiles
from rebuff.functions.expressions import steady, unpivot, wilson
from rebuff.functions.resample import mean_difference, mean_intervals, median_intervals
from rebuff.operators import events as E, inference as I, trajectory as C, windows as W
from rebuff.oracle.ctes import BASE as CTES, DID_DOUBLES, boot, did, mean_ci
from rebuff.plans.registry import query
from rebuff.session import materialize

LOGV = {"lvu": "SELECT a_id, arm, avg(loghits) AS lv FROM sidx GROUP BY 1,2"}


def volumes(v):
    return v.sidx.groupBy("a_id", "arm").agg(F.avg(F.log1p("hits")).alias("lv"))


_sql, _c = mean_ci("i1", "lvu", "lv", "arm")


@query("bootstrap_mean_ci", _sql, "mean ci_lo ci_hi", ctes=LOGV | _c)
def _(v):
    return mean_intervals(volumes(v), "a_id", "lv", ["arm"])


_sql, _c = did("i2", "lvu", "lv")


@query("bootstrap_did", f"""SELECT * FROM ({_sql}), (SELECT quantile_cont(lv,0.5) FILTER (arm='abusive') AS median_a, quantile_cont(lv,0.5) FILTER (arm='verified') AS median_b FROM lvu)""",
       DID_DOUBLES + " median_a median_b", ctes=LOGV | _c)
def _(v):
    u = materialize(volumes(v))
    med = exact_quantiles(u, "lv", {"m": 0.5}, ["arm"]).agg(*[F.max(F.when(F.col("arm") == a, F.col("m"))).alias(n)
                                                              for a, n in (("abusive", "median_a"), ("verified", "median_b"))])
    return mean_difference(u, "a_id", "lv", "arm", "abusive", "verified").crossJoin(F.broadcast(med))


#: The dose queries run on the panel by periods of 28 days, whose block rates vary from event to event.
DOSE = {"sdays": CTES["spanel"], "spanel": """SELECT a_id, DATE '1970-01-01'+(28*((date-DATE '1970-01-01')//28))::INTEGER AS date, sum(hits)::BIGINT AS hits, sum(c200)::BIGINT AS c200, sum(c404)::BIGINT AS c404,
  sum(cblock)::BIGINT AS cblock, sum(c429)::BIGINT AS c429, sum(robots)::BIGINT AS robots FROM sdays GROUP BY 1,2""",
        "dev": """SELECT a_id, arm, i, p_block::DOUBLE AS intensity, pre_o, d_o, clean_lv AS pre_logvol, post_lv-clean_lv AS dvol, exp(post_lv)-1<0.5*(exp(clean_lv)-1) AS retreat FROM sout""",
        "dmed": "SELECT arm, quantile_cont(intensity,0.5) AS med FROM dev GROUP BY 1",
        "dz": "SELECT d.*, intensity>med AS heavy FROM dev d JOIN dmed m ON m.arm=d.arm"}
DG = DOSE | {"dga": "SELECT DISTINCT a_id, arm FROM dev"} | boot("dgb", "dga", "a_id", "arm") | {
    "dgr": "SELECT b.rep, d.* FROM dgb_d b JOIN dev d ON d.a_id=b.a_id AND d.arm=b.arm",
    "dgm": "SELECT arm, rep, quantile_cont(intensity,0.5) AS med FROM dgr GROUP BY 1,2",
    "dgs": """SELECT r.arm, r.rep, CASE WHEN count(*) FILTER (intensity>med)>=5 AND count(*) FILTER (intensity<=med)>=5 THEN avg(d_o) FILTER (intensity>med)-avg(d_o) FILTER (intensity<=med) END AS stat
  FROM dgr r JOIN dgm m ON m.arm=r.arm AND m.rep=r.rep GROUP BY 1,2"""}


@query("cluster_bootstrap", """SELECT arm, n_events, gap, ci_lo, ci_hi FROM (SELECT arm, count(*) AS n_events, CASE WHEN count(*) FILTER (heavy)>=5 AND count(*) FILTER (NOT heavy)>=5 THEN avg(d_o) FILTER (heavy)-avg(d_o) FILTER (NOT heavy) END AS gap FROM dz GROUP BY 1)
  JOIN (SELECT arm, quantile_cont(stat,0.025) AS ci_lo, quantile_cont(stat,0.975) AS ci_hi FROM dgs GROUP BY 1) USING (arm)""", "gap ci_lo ci_hi", ctes=DG)
def _(v):
    return I.dose_gap_bootstrap(I.dose_events(v.by_period().sobs))


DC = {"dcs": "SELECT arm, date, sum(d_o) AS s, count(d_o) AS m FROM sout GROUP BY 1,2"} | boot("dcb", "dcs", "date", "arm") | {
    "dcr": "SELECT arm, rep, sum(s)/sum(m) AS stat FROM dcb_d GROUP BY 1,2"}


@query("date_cluster_bootstrap", """SELECT arm, mean, n_rows, n_clusters, largest_cluster_share, ci_lo, ci_hi FROM (SELECT arm, sum(s)/sum(m) AS mean, sum(m)::BIGINT AS n_rows, count(*) AS n_clusters, max(m)/sum(m) AS largest_cluster_share FROM dcs GROUP BY 1)
  JOIN (SELECT arm, quantile_cont(stat,0.025) AS ci_lo, quantile_cont(stat,0.975) AS ci_hi FROM dcr GROUP BY 1) USING (arm)""", "mean largest_cluster_share ci_lo ci_hi", ctes=DC)
def _(v):
    return I.cluster_mean_intervals(W.event_outcomes(v.sobs), "date", "d_o", ["arm"])


_sql, _c = mean_ci("i5", "lvu", "lv", "arm", stat="quantile_cont(x,0.5)")


@query("bootstrap_median_ci", _sql.replace("mean,", "mean AS median,", 1), "median ci_lo ci_hi", ctes=LOGV | _c)
def _(v):
    return median_intervals(volumes(v), "a_id", "lv", ["arm"])


@query("wilson_interval", """SELECT a_id, k, n, greatest(0.0, 100*(c-h)) AS lo, least(100.0, 100*(c+h)) AS hi FROM (SELECT *, (k/n+1.96*1.96/(2*n))/(1+1.96*1.96/n) AS c,
  1.96*sqrt(k/n*(1-k/n)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n) AS h FROM (SELECT a_id, count(*) FILTER (cblock>0) AS k, count(*) AS n FROM sidx GROUP BY 1))""", "lo hi")
def _(v):
    t = v.spanel.groupBy("a_id").agg(F.count_if(F.col("cblock") > 0).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return t.select("a_id", "k", "n", lo.alias("lo"), hi.alias("hi"))


def tail_sql(z: str) -> str:
    """Two-sided normal tail: the error function's series of positive terms."""
    x = f"abs({z})/sqrt(2)"
    terms = f"list_sum(list_transform(range(200), lambda k: exp(k*ln(2*pow({x},2)+1e-300)-lgamma(2*k+2)+k*ln(2)+lgamma(k+1))))"
    return f"CASE WHEN abs({z})>8 THEN 0.0 ELSE 1-2/sqrt(pi())*exp(-pow({x},2))*({x})*{terms} END"


#: Shares of the permutations of n by their inversions, up to n = 33.
INVERSIONS = {"inv": """SELECT 1 AS n, [1.0::DOUBLE] AS p UNION ALL
  SELECT n+1, list_transform(range(n*(n+1)//2+1), lambda k: list_sum(p[greatest(1,k-n+1):k+1])/(n+1)) FROM inv WHERE n<33"""}


def kendall_sql(src: str, keys: str) -> dict[str, str]:
    on = " AND ".join(f"a.{k}=b.{k}" for k in keys.split(","))
    ak = ", ".join(f"a.{k}" for k in keys.split(","))
    return INVERSIONS | {
            f"{src}_s": f"SELECT {ak}, sum(sign(b.value-a.value)) AS s FROM {src} a JOIN {src} b ON {on} AND a.i<b.i GROUP BY {ak}",
            f"{src}_t": f"SELECT {keys}, sum(c*(c-1)) AS t1, sum(c*(c-1)*(2*c+5)) AS t2, sum(c) AS n FROM (SELECT {keys}, value, count(*)::DOUBLE AS c FROM {src} GROUP BY {keys}, value) GROUP BY {keys}",
            f"{src}_f": f"SELECT {keys}, max(abs(value-x0))<=1e-8+1e-5*abs(max(x0)) AS flat FROM (SELECT {keys}, value, first_value(value) OVER (PARTITION BY {keys} ORDER BY i) AS x0 FROM {src}) GROUP BY {keys}",
            f"{src}_x": f"SELECT *, s/sqrt((n*(n-1)*(2*n+5)-t2)/18) AS z, (n*(n-1)/2-abs(s))/2 AS few, n>=8 AND NOT flat AS ok FROM {src}_t JOIN {src}_f USING ({keys}) JOIN {src}_s USING ({keys})",
            f"{src}_y": f"SELECT x.*, CASE WHEN NOT ok THEN 1.0 WHEN t1=0 AND x.n<=33 THEN least(1.0, 2*list_sum(p[1:few::INT+1])) ELSE {tail_sql('z')} END AS p_value FROM {src}_x x LEFT JOIN inv ON inv.n=x.n",
            f"{src}_k": f"""SELECT {keys}, n::BIGINT AS n, flat, CASE WHEN ok THEN s/sqrt((n*(n-1)/2)*(n*(n-1)/2-t1/2)) ELSE 0.0 END AS tau, p_value,
              CASE WHEN ok AND p_value<0.05 THEN sign(s)::INTEGER ELSE 0 END AS direction FROM {src}_y"""}


def pettitt_sql(src: str, keys: str) -> dict[str, str]:
    return {f"{src}_r": f"SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value)+(count(*) OVER (PARTITION BY {keys}, value)-1)/2 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}",
            f"{src}_u": f"SELECT *, abs(2*sum(r) OVER (PARTITION BY {keys} ORDER BY i)-(i+1)*(n+1)) AS u FROM {src}_r",
            f"{src}_m": f"SELECT {keys}, max(n) AS n, max(u) AS k FROM {src}_u GROUP BY {keys}",
            f"{src}_l": f"SELECT {', '.join('u.'+k for k in keys.split(','))}, m.n, k, min(i) FILTER (u=k) AS loc FROM {src}_u u JOIN {src}_m m USING ({keys}) GROUP BY ALL",
            f"{src}_p": f"""SELECT {keys}, n, CASE WHEN n>=10 AND NOT flat THEN loc ELSE -1 END AS location, CASE WHEN n>=10 AND NOT flat THEN k END AS k,
              CASE WHEN n>=10 AND NOT flat THEN least(1.0, 2*exp(-6*k*k/(n::DOUBLE*n*n+n*n))) ELSE 1.0 END AS p_value, n>=10 AND NOT flat AND 2*exp(-6*k*k/(n::DOUBLE*n*n+n*n))<0.05 AS significant FROM {src}_l JOIN {src}_f USING ({keys})""",
            f"{src}_e": f"""SELECT {keys}, location, significant, CASE WHEN location>0 THEN abs(avg(value) FILTER (i>=location)-avg(value) FILTER (i<location)) END AS cp_effect,
              CASE WHEN location>=0 THEN location/max(x.n) END AS cp_frac FROM {src}_p x JOIN {src} y USING ({keys}) GROUP BY {keys}, location, significant"""}


LONG = {"sl": "SELECT a_id, 'p404' AS feature, i, p404 AS value FROM sfeat UNION ALL SELECT a_id, 'evasion_index', i, evasion_index FROM sfeat UNION ALL SELECT a_id, 'flat', i, 0.0 FROM sfeat"}
TREND = LONG | kendall_sql("sl", "a_id,feature") | pettitt_sql("sl", "a_id,feature")


def long_features(v):
    return unpivot(v.sfeat.withColumn("flat", F.lit(0.0)), ["a_id", "i"], ["p404", "evasion_index", "flat"])


@query("mann_kendall", "SELECT a_id, feature, n, tau, p_value, direction FROM sl_k", "tau p_value", ctes=TREND)
def _(v):
    return I.mann_kendall(long_features(v), ["a_id", "feature"])


@query("pettitt", "SELECT * FROM sl_p", "k p_value", ctes=TREND)
def _(v):
    return I.pettitt(long_features(v), ["a_id", "feature"])


@query("changepoint_effect", "SELECT * FROM sl_e", "cp_effect cp_frac", ctes=TREND)
def _(v):
    long = materialize(long_features(v))
    return I.changepoint_effect(long, I.pettitt(long, ["a_id", "feature"]), ["a_id", "feature"])


def autocorr_sql(src: str, keys: str) -> dict[str, str]:
    on = " AND ".join(f"a.{k}=b.{k}" for k in keys.split(","))
    ak = ", ".join(f"a.{k}" for k in keys.split(","))
    return {f"{src}_c": f"SELECT *, value-avg(value) OVER (PARTITION BY {keys}) AS x, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}",
            f"{src}_v": f"SELECT {keys}, max(n) AS n, sum(x*x) AS vr FROM {src}_c GROUP BY {keys}",
            f"{src}_ac": f"SELECT {ak}, b.i-a.i AS lag, sum(a.x*b.x) AS s FROM {src}_c a JOIN {src}_c b ON {on} AND b.i-a.i BETWEEN 1 AND 100 GROUP BY ALL",
            f"{src}_a": f"""SELECT {keys}, n, CASE WHEN n>=8 AND NOT flat AND vr>0 THEN coalesce(min(lag) FILTER (s/vr<exp(-1)), least(n-1,100))::DOUBLE END AS adaptation_time, n>=8 AND NOT flat AND vr>0 AND min(lag) FILTER (s/vr<exp(-1)) IS NULL AS censored
              FROM {src}_v JOIN {src}_f USING ({keys}) LEFT JOIN {src}_ac USING ({keys}) GROUP BY {keys}, n, flat, vr"""}


def period_sql(src: str, keys: str) -> dict[str, str]:
    return {f"{src}_g": f"SELECT {keys}, regr_slope(value,i) AS b1, regr_intercept(value,i) AS b0, count(*) AS n FROM {src} GROUP BY {keys}",
            f"{src}_w": f"""SELECT {keys}, k, max(n) AS n, pow(sum((value-b0-b1*i)*cos(2*pi()*k*i/n)),2)+pow(sum((value-b0-b1*i)*sin(2*pi()*k*i/n)),2) AS pw
              FROM (SELECT *, unnest(generate_series(1, n//2)) AS k FROM {src} JOIN {src}_g USING ({keys}) JOIN {src}_f USING ({keys}) WHERE n>=30 AND NOT flat) GROUP BY {keys}, k""",
            f"{src}_q": f"""SELECT {keys}, coalesce(o,0.0) AS oscillation, per AS osc_period FROM {src}_f LEFT JOIN
              (SELECT {keys}, max(pw)/sum(pw) AS o, max(n)/arg_max(k,pw) AS per FROM {src}_w GROUP BY {keys}) USING ({keys})"""}


AC = {"sv": "SELECT a_id, arm, i, evasion_index AS value FROM sfeat"} | {k: x for k, x in kendall_sql("sv", "a_id,arm").items() if k == "sv_f"} | autocorr_sql("sv", "a_id,arm") | period_sql("sv", "a_id,arm")


def evasion_series(v):
    return v.sfeat.select("a_id", "arm", "i", F.col("evasion_index").alias("value"))


@query("autocorr_time", "SELECT * FROM sv_a", "adaptation_time", ctes=AC)
def _(v):
    return I.autocorr_time(evasion_series(v), ["a_id", "arm"])


@query("periodicity", "SELECT * FROM sv_q", "oscillation osc_period", ctes=AC)
def _(v):
    return I.periodicity(evasion_series(v), ["a_id", "arm"])


RC = {"rcu": "SELECT a_id, count(*) AS k, avg(o) AS x, avg(score) AS y FROM sobs s JOIN sscores c USING (a_id,date) GROUP BY 1"} | boot("rcb", "rcu", "a_id") | {
    "rcx": "SELECT rep, x, y, rank() OVER (PARTITION BY rep ORDER BY x)+(count(*) OVER (PARTITION BY rep,x)-1)/2 AS rx, rank() OVER (PARTITION BY rep ORDER BY y)+(count(*) OVER (PARTITION BY rep,y)-1)/2 AS ry FROM rcb_d",
    "rco": "SELECT x, y, rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2 AS rx, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2 AS ry FROM rcu"}


def score_units(v):
    return v.sobs.join(v.sscores, ["a_id", "date"]).groupBy("a_id").agg(F.avg("o").alias("x"), F.avg("score").alias("y"))


@query("rank_correlation", """SELECT * FROM (SELECT count(*) AS n, corr(x,y) AS pearson_r, corr(rx,ry) AS spearman_rho FROM rco), (SELECT quantile_cont(s,0.025) AS ci_lo, quantile_cont(s,0.975) AS ci_hi
  FROM (SELECT rep, corr(rx,ry) AS s FROM rcx GROUP BY 1))""", "pearson_r spearman_rho ci_lo ci_hi", ctes=RC)
def _(v):
    return I.rank_correlation(score_units(v), "a_id", "x", "y")


#: U's shares without ties by one sample's members in rank order: ways to reach (members taken, sum of ranks so far).
AUC = RC | {
    "auz": """SELECT n1, n0, u, ties, (abs(u-n1*n0/2)-0.5)/sqrt(n1*n0/12*(n1+n0+1-ties/((n1+n0)*(n1+n0-1)))) AS z, median_pos, median_neg FROM (
      SELECT sum(rx) FILTER (pos)-count(*) FILTER (pos)*(count(*) FILTER (pos)+1)/2 AS u, count(*) FILTER (pos) AS n1, count(*) FILTER (NOT pos) AS n0, sum(t*t-1) AS ties,
      quantile_cont(x,0.5) FILTER (pos) AS median_pos, quantile_cont(x,0.5) FILTER (NOT pos) AS median_neg FROM (SELECT *, y>0.5 AS pos, (count(*) OVER (PARTITION BY x))::DOUBLE AS t FROM rco))""",
    "auw": """SELECT 0 AS r, 0 AS m, 0 AS w, 1.0::DOUBLE AS c UNION ALL SELECT * FROM (SELECT r+1, m+d, w+d*(r+1), sum(c) FROM auw, auz, (VALUES (0),(1)) q(d) WHERE r<n1+n0 AND m+d<=least(n1,n0) AND least(n1,n0)<=8 AND ties=0 GROUP BY 1,2,3)""",
    "aup": "SELECT sum(c) FILTER (w-m*(m+1)/2>=greatest(u,n1*n0-u))*2/sum(c) AS p FROM auw, auz WHERE r=n1+n0 AND m=least(n1,n0)"}


@query("auc_mann_whitney", f"""SELECT n1 AS n_pos, n0 AS n_neg, u/(n1*n0) AS auc, u, z, least(1.0, CASE WHEN ties=0 AND least(n1,n0)<=8 THEN (SELECT p FROM aup) ELSE {tail_sql('z')} END) AS p_value,
  z>1.959964 AS significant, median_pos, median_neg FROM auz""", "auc u z p_value median_pos median_neg", ctes=AUC)
def _(v):
    return I.auc_mann_whitney(score_units(v).withColumn("x", steady("x")), "x", steady("y") > 0.5)


@query("wasserstein", """SELECT sum(abs(ca/ga-cb/gb)*(nx-x)) AS distance, max(ga)::BIGINT AS n_a, max(gb)::BIGINT AS n_b FROM (SELECT x, sum(na) OVER (ORDER BY x) AS ca, sum(nb) OVER (ORDER BY x) AS cb,
  sum(na) OVER () AS ga, sum(nb) OVER () AS gb, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT evasion_index AS x, count(*) FILTER (arm='abusive') AS na, count(*) FILTER (arm='verified') AS nb FROM sfeat GROUP BY 1))""", "distance", digits=9)
def _(v):
    return I.wasserstein(v.sfeat, "evasion_index", "arm", "abusive", "verified")


@query("density_histogram", """SELECT b::BIGINT AS bin, (b+0.5)/40 AS centre, coalesce(c,0)*40/n AS density, above/n AS share_above FROM (SELECT unnest(generate_series(0,39)) AS b) LEFT JOIN
  (SELECT least(floor(score*40),39) AS k, count(*) AS c FROM scores GROUP BY 1) ON k=b, (SELECT count(*) AS n, count(*) FILTER (score>=0.5) AS above FROM scores)""", "centre density share_above")
def _(v):
    return I.density_histogram(v.scores, "score")


@query("dose_split", """SELECT arm, count(*) AS n_events, count(DISTINCT a_id) AS n_agents, count(*) FILTER (heavy) AS n_heavy, avg(d_o) FILTER (heavy) AS "dO_heavy", avg(d_o) FILTER (NOT heavy) AS "dO_light",
  avg(dvol) FILTER (heavy) AS dvol_heavy, avg(dvol) FILTER (NOT heavy) AS dvol_light, avg(retreat::INT) FILTER (heavy) AS retreat_heavy, avg(retreat::INT) FILTER (NOT heavy) AS retreat_light,
  CASE WHEN count(*) FILTER (heavy)>=5 AND count(*) FILTER (NOT heavy)>=5 THEN avg(d_o) FILTER (heavy)-avg(d_o) FILTER (NOT heavy) END AS gap FROM dz GROUP BY 1""", "dO_heavy dO_light dvol_heavy dvol_light retreat_heavy retreat_light gap", ctes=DOSE)
def _(v):
    return I.dose_split(materialize(I.dose_events(v.by_period().sobs)))


@query("balance_smd", " UNION ALL ".join(f"""SELECT arm, '{c}' AS covariate, avg({c}) FILTER (heavy) AS heavy_mean, avg({c}) FILTER (NOT heavy) AS light_mean, avg({c}) FILTER (heavy)-avg({c}) FILTER (NOT heavy) AS diff,
  (avg({c}) FILTER (heavy)-avg({c}) FILTER (NOT heavy))/sqrt((var_samp({c}) FILTER (heavy)+var_samp({c}) FILTER (NOT heavy))/2) AS smd FROM dz GROUP BY arm""" for c in ("pre_o", "pre_logvol")),
       "heavy_mean light_mean diff smd", ctes=DOSE)
def _(v):
    return I.balance_smd(materialize(I.dose_events(v.by_period().sobs)))


ADJ = DOSE | {"a1": "SELECT arm, heavy::INT::DOUBLE AS h, pre_o AS p, pre_logvol AS v, d_o AS y1, retreat::INT::DOUBLE AS y2 FROM dz",
              "a2": "SELECT arm, regr_slope(v,p) AS vb, regr_intercept(v,p) AS va, regr_slope(h,p) AS hb, regr_intercept(h,p) AS ha FROM a1 GROUP BY 1",
              "a3": "SELECT a.*, v-va-vb*p AS rv, h-ha-hb*p AS rh FROM a1 a JOIN a2 b ON b.arm=a.arm",
              "a4": "SELECT arm, sum(rv*rh)/sum(rv*rv) AS g FROM a3 GROUP BY 1",
              "a5": "SELECT a.*, rh-g*rv AS r FROM a3 a JOIN a4 b ON b.arm=a.arm"}


@query("adjusted_gap", "SELECT arm, count(*) AS n, CASE WHEN count(*)>=10 THEN sum(r*y1)/sum(r*r) END AS adjusted_d_o, CASE WHEN count(*)>=10 THEN sum(r*y2)/sum(r*r) END AS adjusted_retreat FROM a5 GROUP BY 1", "adjusted_d_o adjusted_retreat", ctes=ADJ)
def _(v):
    return I.adjusted_gap(materialize(I.dose_events(v.by_period().sobs)))


CM = DOSE | {"cms": """SELECT arm, avg(pre_o) AS mo, avg(pre_logvol) AS mv, sqrt((var_samp(pre_o) FILTER (heavy)+var_samp(pre_o) FILTER (NOT heavy))/2)+1e-12 AS so,
  sqrt((var_samp(pre_logvol) FILTER (heavy)+var_samp(pre_logvol) FILTER (NOT heavy))/2)+1e-12 AS sv FROM dz GROUP BY 1""",
             "cmz": "SELECT d.arm, heavy, a_id*100000+i AS id, d_o AS y, (pre_o-mo)/so AS x, (pre_logvol-mv)/sv AS z FROM dz d JOIN cms s ON s.arm=d.arm",
             "cmp": "SELECT h.arm, h.id, h.y, sqrt(pow(h.x-l.x,2)+pow(h.z-l.z,2)) AS dist, l.id AS lid, l.y AS ly FROM cmz h JOIN cmz l ON l.arm=h.arm AND h.heavy AND NOT l.heavy",
             "cmb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm,id ORDER BY dist, lid) AS rn FROM cmp) WHERE rn=1 AND dist<=0.2"}


@query("caliper_match", "SELECT arm, n_heavy, CASE WHEN ok THEN coalesce(n_matched,0) ELSE 0 END AS n_matched, CASE WHEN ok THEN matched_gap END AS matched_gap FROM (SELECT arm, count(*) FILTER (heavy) AS n_heavy, count(*) FILTER (heavy)>=10 AND count(*) FILTER (NOT heavy)>=10 AS ok FROM dz GROUP BY 1) LEFT JOIN (SELECT arm, count(*) AS n_matched, avg(y)-avg(ly) AS matched_gap FROM cmb GROUP BY 1) USING (arm)",
       "matched_gap", ctes=CM)
def _(v):
    return I.caliper_match(I.dose_events(v.by_period().sobs))


FC_F = ["ip_ent", "dom_ent", "ctry_ent", "url_ent"]
FC = {"fcl": " UNION ALL ".join(f"SELECT label, '{f}' AS feature, {f} AS value, log_hits AS lv FROM active" for f in FC_F),
      "fcb": "SELECT label, feature, count(*) AS n, quantile_cont(value,0.05) AS p05, quantile_cont(value,0.95) AS p95, corr(value,lv) AS corr_log_hits FROM fcl GROUP BY 1,2",
      "fcc": "SELECT feature, max(p05) AS lo, min(p95) AS hi FROM fcb GROUP BY 1",
      "fcs": "SELECT label, feature, avg((value BETWEEN lo AND hi)::INT) AS share_common FROM fcl JOIN fcc USING (feature) GROUP BY 1,2"}


@query("feature_correlation", "SELECT label, feature, n, p05, p95, corr_log_hits, share_common FROM fcb JOIN fcs USING (label,feature)", "p05 p95 corr_log_hits share_common", ctes=FC)
def _(v):
    return I.feature_correlation(v.active, FC_F)
