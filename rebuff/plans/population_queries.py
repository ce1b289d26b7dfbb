"""Registered queries: populations."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuff.operators import populations as R
from rebuff.plans.registry import query

TOT = {"tot": "SELECT uh_a_id AS a_id, sum(uh_total)::BIGINT AS tot FROM honeypot GROUP BY 1",
       "tagged": """SELECT a_id, 'labeled_'||label AS role, 4 AS p, CASE label WHEN 'pothuman' THEN 4 WHEN 'human' THEN 2 ELSE 1 END AS q FROM alabels UNION ALL
         SELECT a_id, 'bot_hp', 3, 0 FROM tot WHERE tot>0 UNION ALL SELECT DISTINCT h_a_id, 'ctrl_white', 2, 0 FROM hits WHERE h_i_id IN (5,17) UNION ALL
         SELECT a_id, 'ctrl_hpneg', 1, 0 FROM tot WHERE tot=0""",
       "members": """SELECT 'abusive' AS population, a_id FROM abusive UNION ALL SELECT label, a_id FROM alabels UNION ALL SELECT 'decoy_positive', a_id FROM tot WHERE tot>0"""}


@query("honeypot_split", "SELECT a_id, CASE WHEN tot>0 THEN 'positive' ELSE 'negative' END AS side FROM tot WHERE tot IS NOT NULL AND tot>=0", ctes=TOT)
def _(v):
    return R.honeypot_split(v.honeypot)


@query("trusted_ip_agents", "SELECT DISTINCT h_a_id AS a_id FROM hits WHERE h_i_id IN (SELECT i_id FROM whiteip)")
def _(v):
    return R.trusted_ip_agents(v.hits, v.whiteip)


@query("roster_v1", """SELECT a_id, role, role IN ('bot_hp','labeled_bot') AS is_bot, (role LIKE 'ctrl_%' OR role IN ('labeled_human','labeled_pothuman')) AS is_control, a_id>2147483647 AS over_limit
  FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY p DESC, q DESC) AS rn FROM tagged) WHERE rn=1""", ctes=TOT)
def _(v):
    side = R.honeypot_split(v.honeypot)
    return R.roster_v1(v.labels, side.where("side = 'positive'"), R.trusted_ip_agents(v.hits, v.whiteip), side.where("side = 'negative'"))


@query("seeded_sample", "SELECT a_id, a_totalhit, row_number() OVER (ORDER BY md5('42:'||a_id), a_id) AS draw FROM agent")
def _(v):
    return R.draw_order(v.agent.select("a_id", "a_totalhit"))


@query("abusive_arm", "SELECT a_id, decoy_hits::BIGINT AS decoy_hits, a_totalhit, share FROM abusive", "share")
def _(v):
    return R.abusive_arm(v.honeypot, v.agent)


@query("arm_of_record", "SELECT a_id, decoy_hits::BIGINT AS decoy_hits, a_totalhit, share FROM abusive WHERE a_id NOT IN (SELECT a_id FROM alabels WHERE label='human')", "share")
def _(v):
    return R.arm_of_record(R.abusive_arm(v.honeypot, v.agent), v.labels)


@query("roster_v2", "SELECT a_id, role, is_bot, is_control, a_id>2147483647 AS over_limit FROM roster2")
def _(v):
    return v.roster


@query("honeypot_census", """SELECT count(*) AS distinct_agents, count(*) FILTER (tot IS NULL) AS null_total, count(*) FILTER (tot=0) AS explicit_zero,
  count(*) FILTER (tot>0) AS positive FROM tot""", ctes=TOT)
def _(v):
    return R.honeypot_census(v.honeypot)


@query("window_selection", """SELECT CASE WHEN tot>0 THEN 'in_window' ELSE 'out_of_window' END AS grp, count(*) AS agents, round(avg(a_totalhit),0) AS mean_requests,
  round(avg(a_last_5p-a_start_5p),1) AS mean_window_days FROM tot JOIN agent USING (a_id) WHERE tot IS NOT NULL GROUP BY 1""", "mean_requests mean_window_days", ctes=TOT)
def _(v):
    return R.window_selection(v.honeypot, v.agent)


@query("population_overlap", """SELECT a.population AS left_pop, b.population AS right_pop, count(*) AS n_common FROM (SELECT DISTINCT * FROM members) a
  JOIN (SELECT DISTINCT * FROM members) b ON a.a_id=b.a_id AND a.population<b.population GROUP BY 1,2""", ctes=TOT)
def _(v):
    m = (R.abusive_arm(v.honeypot, v.agent).select(F.lit("abusive").alias("population"), "a_id")
         .unionByName(v.labels.select(F.col("label").alias("population"), "a_id"))
         .unionByName(R.honeypot_split(v.honeypot).where("side = 'positive'").select(F.lit("decoy_positive").alias("population"), "a_id")))
    return R.population_overlap(m)


@query("cohort_counts", "SELECT role, count(*) AS n_roster, count(p.a_id) AS n_extracted FROM roster2 r LEFT JOIN (SELECT DISTINCT a_id FROM panel WHERE hits>=2) p ON p.a_id=r.a_id GROUP BY 1")
def _(v):
    return R.cohort_counts(v.roster, v.panel.where("hits >= 2"))


@query("moderate_bots", """SELECT a_id, tot, moderate, moderate AND rn<=10 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY moderate ORDER BY a_id) AS rn
  FROM (SELECT *, tot BETWEEN 15 AND 8000 AS moderate FROM tot WHERE tot IS NOT NULL))""", ctes=TOT)
def _(v):
    return R.moderate_bots(v.honeypot, lo=15)      # the tables hold fewer requests than the 200 that the library asks for


@query("size_screen", "SELECT a_id, a_totalhit, coalesce(a_totalhit>66, false) AS screened FROM agent")
def _(v):
    return R.size_screen(v.agent, 66).select("a_id", "a_totalhit", "screened")      # the tables have no agent beyond the library's 500,000


@query("arm_revision", """SELECT CASE WHEN o.a_id IS NULL THEN 'added' WHEN n.a_id IS NULL THEN 'removed' ELSE 'kept' END AS change, coalesce(role,'none') AS role, count(*) AS n_agents
  FROM (SELECT a_id FROM tot WHERE tot>10) o FULL JOIN (SELECT a_id FROM abusive) n ON n.a_id=o.a_id LEFT JOIN roster2 r ON r.a_id=coalesce(o.a_id,n.a_id) GROUP BY 1,2""", ctes=TOT)
def _(v):
    return R.arm_revision(R.decoy_totals(v.honeypot).where("tot > 10"), R.abusive_arm(v.honeypot, v.agent), v.roster)


@query("curated_labels", """SELECT a_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT label) AS n_labels, count(DISTINCT label)>1 AS twin, a_id>2147483647 AS over_limit
  FROM alabels GROUP BY 1""")
def _(v):
    return R.curated_labels(v.labels)
