"""Registered queries: identity bridges."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.operators import bridges as B, events as E, windows as W
from rebuff.operators.populations import sample_to_size_of
from rebuff.oracle.ctes import ALL_DEATHS, boot, draw_sql
from rebuff.plans.event_queries import BX, PD, is_arm
from rebuff.plans.registry import query
from rebuff.session import materialize

CAP, REPS, DRAWS = B.POP_CAP, 2000, 200


def decoy_candidates(v, deaths):
    """The estimator's candidates: the 40 rarest per death."""
    return B.decoy_bridge(v.sdecoy, deaths, CAP).where(F.col("rank") <= B.TOP_K).drop("rank")


def ip_candidates(v, deaths):
    """The estimator's candidates: of the first 48 by shared addresses the best 12."""
    return B.ip_bridge(v.ip, deaths).where((F.col("rank_shared") <= 4 * B.TOPK_IP) & (F.col("rank") <= B.TOPK_IP)).drop("rank", "rank_shared")


def cand_sql(p: str, deaths: str) -> dict[str, str]:
    return {f"{p}c0": f"SELECT d.a_id AS a_death, b.uh_a_id AS a_succ, count(*) AS shared_hp, sum(1.0::DOUBLE/pop) AS rare_score, min(pop) AS min_pop FROM {deaths} d JOIN sdecoy a ON a.uh_a_id=d.a_id JOIN dpop p ON p.u=a.uh_u_id AND pop<={CAP} "
                      "JOIN sdecoy b ON b.uh_u_id=a.uh_u_id AND b.uh_a_id<>d.a_id GROUP BY 1,2",
            f"{p}ci": f"SELECT c.a_death, c.a_succ, count(*) AS k FROM {p}c0 c JOIN sdecoy x ON x.uh_a_id=c.a_death JOIN sdecoy y ON y.uh_a_id=c.a_succ AND y.uh_u_id=x.uh_u_id GROUP BY 1,2",
            f"{p}cand": f"SELECT * FROM {p}all WHERE rank<=40",
            f"{p}all": f"""SELECT a_death, a_succ, shared_hp, rare_score, min_pop, shared_hp/(na.k+nb.k-i.k) AS jaccard, (min_pop<=25)::INTEGER AS in_core, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a_death ORDER BY round(rare_score,9) DESC, a_succ) AS rn
              FROM {p}c0) c JOIN {p}ci i USING (a_death,a_succ) JOIN dsz na ON na.a=a_death JOIN dsz nb ON nb.a=a_succ"""}


def stats_join(alias: str, agent: str, t: str) -> str:
    return f"""LEFT JOIN LATERAL (SELECT ln(1+coalesce(sum(hits) FILTER (date>={t}-14 AND date<{t}),0)) AS v_pre, ln(1+coalesce(sum(hits) FILTER (date>={t} AND date<{t}+14),0)) AS v_post, avg(b) FILTER (date>={t}-14 AND date<{t}) AS b_pre,
      avg(b) FILTER (date>={t} AND date<{t}+14) AS b_post, count(*) FILTER (date>={t}-14 AND date<{t}) AS n_pre, count(*) FILTER (date>={t} AND date<{t}+14) AS n_post FROM sbot s WHERE s.a_id={agent} AND s.date BETWEEN {t}-14 AND {t}+14) {alias} ON true"""


def pairs_sql(p: str, cand: str, deaths: str, cols: str) -> dict[str, str]:
    return {p: f"""SELECT c.a_death, c.a_succ, d.t_death AS "t_A", {cols}, x.b_pre AS "bA_pre", x.b_post-x.b_pre AS "dA_b", x.v_post-x.v_pre AS "dA_v", y.b_post AS "bB_post", y.b_post-y.b_pre AS "dB_b", y.v_post-y.v_pre AS "dB_v",
      z.v_post-z.v_pre AS "dB_v_placebo" FROM {cand} c JOIN {deaths} d ON d.a_id=c.a_death {stats_join('x', 'c.a_death', 'd.t_death')} {stats_join('y', 'c.a_succ', 'd.t_death')} {stats_join('z', 'c.a_succ', '(d.t_death-60)')}
      WHERE y.n_post>0 AND c.a_succ IN (SELECT a_id FROM sidx GROUP BY 1 HAVING count(*)>=15)"""}


HP = "c.shared_hp, c.rare_score, c.min_pop, c.jaccard, c.in_core"
BASE = BX | {"dpop": "SELECT uh_u_id AS u, count(DISTINCT uh_a_id) AS pop FROM sdecoy WHERE uh_total>0 GROUP BY 1", "dsz": "SELECT uh_a_id AS a, count(*) AS k FROM sdecoy GROUP BY 1"} | cand_sql("d", "deaths") | {
    "lnk": "SELECT i_name, i_agent, min(i_proxy) AS px FROM ip GROUP BY 1,2",
    "ifp": "SELECT i_agent AS a_id, count(DISTINCT i_name) AS n_ip FROM ip WHERE i_proxy=0 GROUP BY 1",
    "ic0": "SELECT a.i_agent AS a_death, b.i_agent AS a_succ, count(DISTINCT b.i_name) AS shared_ips FROM lnk a JOIN lnk b ON a.i_name=b.i_name AND b.i_agent<>a.i_agent WHERE a.px=0 AND a.i_agent IN (SELECT a_id FROM deaths) GROUP BY 1,2",
    "ic1": "SELECT c.*, shared_ips/n_ip AS overlap_frac, (shared_ips/n_ip>=0.5 AND shared_ips>=3)::INTEGER AS in_core FROM (SELECT *, row_number() OVER (PARTITION BY a_death ORDER BY shared_ips DESC, a_succ) AS rank_shared FROM ic0) c JOIN ifp ON a_id=a_death",
    "iall": "SELECT a_death, a_succ, shared_ips, rank_shared::INTEGER AS rank_shared, overlap_frac, in_core, row_number() OVER (PARTITION BY a_death ORDER BY rank_shared<=48 DESC, in_core DESC, shared_ips DESC, a_succ)::INTEGER AS rank FROM ic1",
    "icand": "SELECT a_death, a_succ, shared_ips, overlap_frac, in_core FROM iall WHERE rank_shared<=48 AND rank<=12"} | pairs_sql("prs", "dcand", "deaths", HP) | {
    "pst": "SELECT *, unnest(CASE WHEN in_core=1 THEN ['core','envelope'] ELSE ['envelope'] END) AS stratum FROM prs"}
#: For the queries over the deaths of both arms.
BOTH = BASE | ALL_DEATHS
PAIR_D = "rare_score jaccard bA_pre dA_b dA_v bB_post dB_b dB_v dB_v_placebo"


def botness(v):
    return W.botness_series(v.sidx, W.botness_axis(v.sidx, is_arm("abusive"), is_arm("verified"))).select("a_id", "arm", "date", "hits", "b")


def setup(v, deaths=None):
    """Materialised (series, deaths, candidates, pairs) for the decoy bridge."""
    s = materialize(botness(v))
    d = materialize(v.deaths if deaths is None else deaths)
    c = materialize(decoy_candidates(v, d))
    return s, d, c, materialize(B.pair_event_study(c, d, s))


@query("decoy_popularity", f"SELECT u, pop, pop<={CAP} AS usable FROM dpop", ctes=BASE)
def _(v):
    return B.decoy_popularity(v.sdecoy, CAP)


@query("decoy_bridge", "SELECT * FROM dall", "rare_score jaccard", ctes=BASE)
def _(v):
    return B.decoy_bridge(v.sdecoy, materialize(v.lone_bot_deaths), CAP)


@query("ip_footprint", "SELECT * FROM ifp", ctes=BASE)
def _(v):
    return B.ip_footprint(v.ip)


@query("ip_bridge", "SELECT * FROM iall", "overlap_frac", ctes=BASE)
def _(v):
    return B.ip_bridge(v.ip, materialize(v.lone_bot_deaths))


@query("date_window_stats", f"SELECT d.a_id, d.t_death AS t, x.* FROM deaths d {stats_join('x', 'd.a_id', 'd.t_death')}", "v_pre v_post b_pre b_post", ctes=BOTH)
def _(v):
    return B.date_window_stats(botness(v), v.deaths.select("a_id", F.col("t_death").alias("t")))


@query("pair_event_study", "SELECT * FROM prs", PAIR_D, ctes=BOTH)
def _(v):
    return setup(v)[3]


@query("pair_placebo", 'SELECT a_death, a_succ, "dB_v_placebo" FROM ipr', "dB_v_placebo", ctes=BOTH | pairs_sql("ipr", "icand", "deaths", "c.shared_ips, c.overlap_frac, c.in_core"))
def _(v):
    d = materialize(v.deaths)
    return B.pair_event_study(ip_candidates(v, d), d, botness(v)).select("a_death", "a_succ", "dB_v_placebo")


@query("pair_dedup", "SELECT a_death, a_succ, bridge FROM (SELECT *, row_number() OVER (PARTITION BY a_death, a_succ ORDER BY bridge) AS rn FROM (SELECT a_death, a_succ, 'decoy' AS bridge FROM dall UNION ALL SELECT a_death, a_succ, 'ip' FROM iall)) WHERE rn=1", ctes=BASE)
def _(v):
    d = materialize(v.lone_bot_deaths)
    return B.pair_dedup(B.candidate_pairs(v.sdecoy, v.ip, d, CAP), [F.asc("bridge")])      # all candidates


def transfer_sql(pairs: str) -> tuple[str, dict[str, str]]:
    c, joins = {}, ""
    for n, (cluster, value, tag) in enumerate((("a_death", '"dB_v"', "dvol"), ("a_death", '"dB_b"', "dbot"), ('"t_A"', '"dB_v"', "dvol_date"))):
        key = cluster.strip('"')
        c[f"tc{n}"] = f"SELECT stratum, {cluster} AS {'a_death' if key == 'a_death' else 'td'}, sum({value}) AS s, count({value}) AS m FROM {pairs} GROUP BY 1,2"
        c |= boot(f"tb{n}", f"tc{n}", "a_death" if key == "a_death" else "td", "stratum", REPS)
        c[f"tr{n}"] = f"SELECT stratum, rep, sum(s)/sum(m) AS stat FROM tb{n}_d GROUP BY 1,2"
        c[f"tq{n}"] = f"SELECT stratum, quantile_cont(stat,0.025) AS {tag}_lo, quantile_cont(stat,0.975) AS {tag}_hi FROM tr{n} GROUP BY 1"
        joins += f" LEFT JOIN tq{n} USING (stratum)"
    c["tp"] = f"""SELECT stratum, count(*) AS n_pairs, count(DISTINCT a_death) AS n_deaths, count(DISTINCT "t_A") AS n_dates, avg("dB_v") AS dvol_mean, avg("dB_b") AS dbot_mean, avg("dB_v_placebo") AS dvol_placebo FROM {pairs} GROUP BY 1"""
    c["tl"] = f'SELECT stratum, max(k)/sum(k) AS largest_date_share FROM (SELECT stratum, "t_A", count(*) AS k FROM {pairs} GROUP BY 1,2) GROUP BY 1'
    return f"SELECT *, dvol_mean-dvol_placebo AS ramp_minus_placebo FROM tp JOIN tl USING (stratum){joins}", c


TRANSFER_D = "dvol_mean dbot_mean dvol_placebo largest_date_share ramp_minus_placebo dvol_lo dvol_hi dbot_lo dbot_hi dvol_date_lo dvol_date_hi"
_sql, _c = transfer_sql("pst")


@query("transfer_summary", _sql, TRANSFER_D, ctes=BOTH | _c)
def _(v):
    return B.transfer_summary(setup(v)[3], REPS)


@query("transfer_rates", "SELECT stratum, k AS n_with_successor, n AS n_deaths, k/greatest(n,1) AS rate FROM (SELECT stratum, count(DISTINCT a_death) AS k FROM pst GROUP BY 1), (SELECT count(*) AS n FROM deaths)", "rate", ctes=BOTH)
def _(v):
    _s, d, _c, p = setup(v)
    return B.transfer_rates(p, d)


POOL = BOTH | {"pd": "SELECT t_death AS t, count(*) AS n_records FROM deaths GROUP BY 1",
               "pf": 'SELECT s.a_succ, t, n_records FROM (SELECT DISTINCT a_succ FROM prs) s CROSS JOIN pd WHERE (s.a_succ, t) NOT IN (SELECT (a_succ, "t_A") FROM prs)',
               "pool": f"SELECT f.a_succ, f.t, n_records, x.n_pre=0 AND x.n_post=0 AS dormant, x.v_post-x.v_pre AS dv FROM pf f {stats_join('x', 'f.a_succ', 'f.t')}",
               "ps": "SELECT a_succ, sum(n_records) AS c, sum(CASE WHEN dormant THEN n_records ELSE 0 END) AS d, count(*) FILTER (NOT dormant) AS ok FROM pool GROUP BY 1",
               "pw": "SELECT stratum, a_succ, count(*) AS w FROM pst GROUP BY 1,2",
               "px": "SELECT *, row_number() OVER (PARTITION BY a_succ, dates ORDER BY t, u)-1 AS idx, count(*) OVER (PARTITION BY a_succ, dates) AS size FROM (SELECT a_succ, t, dv, 'unique' AS dates, 1 AS u FROM pool WHERE NOT dormant UNION ALL SELECT a_succ, t, dv, 'records', unnest(generate_series(1,n_records)) FROM pool WHERE NOT dormant)",
               "pdr": "SELECT a_succ, dates, rep, " + draw_sql("size", "dates", "a_succ", "rep") + f" AS idx FROM (SELECT DISTINCT a_succ, dates, size FROM px), (SELECT unnest(generate_series(1,{DRAWS})) AS rep)",
               "pv": "SELECT d.a_succ, d.dates, d.rep, dv FROM pdr d JOIN px x ON x.a_succ=d.a_succ AND x.dates=d.dates AND x.idx=d.idx",
               "pm": "SELECT stratum, dates, rep, sum(dv*w)/sum(w) AS stat, sum(w) AS k FROM pv JOIN pw USING (a_succ) GROUP BY 1,2,3"}


@query("eligible_null_dates", """SELECT stratum, count(*) AS n_successors, count(*) FILTER (ok>0) AS n_successors_supported, sum(w)::BIGINT AS n_pairs, sum(d)/sum(c) AS dormant_share, sum(d*w)/sum(c*w) AS dormant_share_pair_weighted,
  1-sum(CASE WHEN ok>0 THEN w ELSE 0 END)/sum(w) AS attrition FROM pw LEFT JOIN ps USING (a_succ) GROUP BY 1""", "dormant_share dormant_share_pair_weighted attrition", ctes=POOL)
def _(v):
    s, d, _c, p = setup(v)
    return B.eligible_null_dates(B.null_pool(p, d, s), p)


@query("link_permutation_null", """SELECT stratum, dates, avg(stat) AS null_mean, quantile_cont(stat,0.025) AS null_lo, quantile_cont(stat,0.975) AS null_hi, count(*) AS n_draws, max(k)::BIGINT AS n_pairs_evaluated, max(n)::BIGINT AS n_pairs, max(k)/max(n) AS coverage
  FROM pm JOIN (SELECT stratum, sum(w) AS n FROM pw GROUP BY 1) USING (stratum) GROUP BY 1,2""", "null_mean null_lo null_hi coverage", ctes=POOL)
def _(v):
    s, d, _c, p = setup(v)
    return B.link_permutation_null(B.null_pool(p, d, s), p, DRAWS)


BINV = {"bns": "SELECT * FROM (VALUES (0::BIGINT,5::BIGINT),(6,25),(26,100),(101,1000000000)) x(lo,hi)", "bnm": "SELECT (SELECT count(*) FROM bns WHERE min_pop BETWEEN lo AND hi) AS m FROM prs"}


@query("specificity_partition", """SELECT lo, hi, count(*) AS n_pairs, count(DISTINCT a_death) AS n_deaths, count(DISTINCT "t_A") AS n_dates, avg("dB_v") AS dvol_mean, avg("dB_b") AS dbot_mean, (SELECT count(*) FROM bnm WHERE m=1) AS n_covered,
  (SELECT count(*) FROM bnm WHERE m=0) AS n_uncovered, (SELECT count(*) FROM bnm WHERE m>1) AS n_double FROM prs JOIN bns ON min_pop BETWEEN lo AND hi GROUP BY 1,2""", "dvol_mean dbot_mean", ctes=BOTH | BINV)
def _(v):
    return B.specificity_partition(setup(v)[3])


LD = {"big": 'SELECT "t_A" AS big_date, count(*) AS n_on_date FROM prs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1', "rst": 'SELECT p.*, big_date, n_on_date FROM prs p, big WHERE "t_A"<>big_date',
      "rsc": 'SELECT \'rest\' AS stratum, "t_A" AS td, sum("dB_v") AS s, count("dB_v") AS m FROM rst GROUP BY 1,2'} | boot("rsb", "rsc", "td", "stratum", REPS) | {"rsr": "SELECT rep, sum(s)/sum(m) AS stat FROM rsb_d GROUP BY 1"}


@query("leave_date_out", """SELECT * FROM (SELECT big_date, n_on_date, count(*) AS n_pairs, count(DISTINCT a_death) AS n_deaths, count(DISTINCT "t_A") AS n_dates, avg("dB_v") AS dvol_mean FROM rst GROUP BY 1,2),
  (SELECT quantile_cont(stat,0.025) AS ci_lo, quantile_cont(stat,0.975) AS ci_hi FROM rsr)""", "dvol_mean ci_lo ci_hi", ctes=BOTH | LD)
def _(v):
    return B.leave_date_out(setup(v)[3], REPS)


PH = {"phc": "SELECT a_id, min(date)+((max(date)-min(date))//2)::INTEGER AS t FROM sbot WHERE arm='abusive' GROUP BY 1 HAVING max(date)-min(date)>=56",
      "phd": """SELECT s.a_id, ln(1+coalesce(sum(hits) FILTER (date<t AND date>=t-14),0)) AS va, ln(1+coalesce(sum(hits) FILTER (date>=t AND date<t+14),0)) AS vb, avg(b) FILTER (date<t AND date>=t-14) AS ba, avg(b) FILTER (date>=t AND date<t+14) AS bb,
        count(*) FILTER (date<t) AS na, count(*) FILTER (date>=t) AS nb, count(*) FILTER (date>=t AND date<t+14) AS np FROM sbot s JOIN phc c ON c.a_id=s.a_id GROUP BY 1"""}


@query("planted_handoff", """SELECT count(*) AS n_planted, avg(-va) AS "dA_v_mean", avg(vb) AS "dB_v_mean", 0.0::DOUBLE AS "dB_v_placebo_mean", avg(bb-ba) AS b_transfer_bias, corr(ba,bb) AS b_corr, avg((vb>0)::INT) AS frac_ramp FROM phd WHERE na>=15 AND nb>=15 AND np>0""",
       "dA_v_mean dB_v_mean b_transfer_bias b_corr frac_ramp", ctes=BASE | PH)
def _(v):
    return B.planted_handoff(botness(v), is_arm("abusive"))


@query("coverage_register", f"""SELECT c.a_death, c.a_succ, CASE WHEN k.days IS NULL THEN 'no_series' WHEN k.days<15 THEN 'below_min_days' WHEN y.n_post=0 THEN 'unobserved_after' ELSE 'evaluated' END AS reason FROM dall c JOIN deaths d ON d.a_id=c.a_death
  LEFT JOIN (SELECT a_id, count(*) AS days FROM sidx GROUP BY 1) k ON k.a_id=c.a_succ {stats_join('y', 'c.a_succ', 'd.t_death')}
  UNION ALL SELECT a_id, NULL, 'no_candidate' FROM deaths WHERE a_id NOT IN (SELECT a_death FROM dall)""", ctes=BASE)
def _(v):
    d = materialize(v.bot_deaths)
    return B.coverage_register(B.decoy_bridge(v.sdecoy, d, CAP), d, materialize(botness(v)))


PT = BOTH | {"pdeaths": PD["pdeaths"].replace("arm='abusive' AND ", "")} | {"pld": "SELECT a_id, t_death FROM (SELECT *, row_number() OVER (ORDER BY md5('42:'||a_id), a_id) AS rn FROM pdeaths) WHERE rn<=(SELECT count(*) FROM deaths)"} | cand_sql("q", "pld") | pairs_sql("qrs", "qcand", "pld", HP) | {
    "qst": "SELECT *, unnest(CASE WHEN in_core=1 THEN ['core','envelope'] ELSE ['envelope'] END) AS stratum FROM qrs"}
_sql, _c = transfer_sql("qst")


@query("placebo_transfer", _sql, TRANSFER_D, ctes=PT | _c)
def _(v):
    placebo = sample_to_size_of(E.placebo_deaths(v.sidx), v.deaths)
    return B.transfer_summary(setup(v, placebo)[3], REPS)
