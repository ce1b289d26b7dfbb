"""SQL oracle: the same views as the Spark side, written independently as common table expressions."""
from __future__ import annotations

import math
import re

BASE: dict[str, str] = {}


def draw_sql(n: str, *parts: str, seed: int = 42) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::UBIGINT % ({n}) AS BIGINT)")


def thin(name: str, cand: str, gap: int) -> dict[str, str]:
    """Greedy thinning as a recursion over each candidate's successor at distance >= gap."""
    return {
        f"{name}_nx": f"SELECT c.a_id, c.i, min(d.i) AS j FROM {cand} c JOIN {cand} d ON d.a_id=c.a_id AND d.i>=c.i+{gap} GROUP BY 1,2",
        name: f"SELECT a_id, min(i) AS i FROM {cand} GROUP BY a_id UNION ALL "
              f"SELECT t.a_id, x.j FROM {name} t JOIN {name}_nx x ON x.a_id=t.a_id AND x.i=t.i",
    }


def boot(name: str, src: str, key: str, by: str = "", reps: int = 2000, seed: int = 42) -> dict[str, str]:
    """CTE name_d: each replicate's units, as many copies of a unit as its Poisson(1) count says."""
    bys = [b.strip() for b in by.split(",") if b.strip()]
    total, bounds = 0.0, []
    for k in range(40):
        total += math.exp(-1) / math.factorial(k)
        if total >= 1 - 2 ** -32:
            break
        bounds.append(f"'{int(total * 2 ** 32):08x}'")
    digest = f"md5(concat_ws(':', '{seed}', {', '.join([*bys, '(r.rep-1)//4', key])}))"
    return {
        f"{name}_h": f"SELECT r.rep, s.*, substr({digest}, CAST(1+8*((r.rep-1)%4) AS BIGINT), 8) AS hx FROM {src} s, (SELECT unnest(generate_series(1,{reps})) AS rep) r",
        f"{name}_d": f"SELECT *, unnest(range({'+'.join(f"(hx>={b})::BIGINT" for b in bounds)})) AS cp FROM {name}_h",
    }


BASE.update({
    "hits": """SELECT event_id AS h_id, user_id AS h_a_id, ts AS h_ts, CAST(ts AS DATE) AS date, k AS h_u_id, value,
      CASE WHEN event_type='error' AND value>=150 THEN 429 WHEN event_type='error' AND event_id%3=0 THEN 401
           WHEN event_type='error' THEN 403 WHEN event_type='signup' THEN 404 ELSE 200 END AS h_status,
      CASE WHEN event_id%29=0 THEN NULL ELSE (user_id+k)%40 END AS h_i_id,
      CASE WHEN event_id%31=0 THEN NULL ELSE k%12 END AS h_d_id,
      CASE WHEN k%7=0 THEN 'HU' ELSE 'C'||(k%7) END AS h_ccode,
      CASE WHEN event_type='purchase' THEN 'POST' ELSE 'GET' END AS h_mode
      FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events)""",
    "url": """SELECT u_id, CASE WHEN u_id%16=0 THEN 'HTML' WHEN u_id%4=0 THEN 'html' WHEN u_id%4=1 THEN 'htm'
      WHEN u_id%4=2 THEN 'php' END AS u_extension, CASE WHEN u_id%5=3 THEN 1 ELSE 0 END AS u_honeypot
      FROM (SELECT DISTINCT h_u_id AS u_id FROM hits)""",
    "honeypot": """SELECT h_a_id AS uh_a_id, h_u_id AS uh_u_id, CASE WHEN h_a_id%11=0 THEN NULL WHEN h_a_id%13=0 THEN 0
      ELSE count(*) END AS uh_total FROM hits WHERE h_u_id%5=3 GROUP BY 1,2""",
    "panel": """SELECT h_a_id AS a_id, date, count(*) AS hits, count(*) FILTER (h_status=200) AS c200,
      count(*) FILTER (h_status=404) AS c404, count(*) FILTER (h_status IN (401,403)) AS cblock,
      count(*) FILTER (h_status=429) AS c429, count(*) FILTER (h_u_id=64) AS robots FROM hits GROUP BY 1,2""",
    "agent": """SELECT h_a_id AS a_id, 'agent-'||h_a_id AS a_name, min(date) AS a_start, max(date) AS a_last, count(*) AS a_totalhit,
      CAST('1970-01-01' AS DATE)+CAST(floor(quantile_cont(date-DATE '1970-01-01',0.05)) AS INTEGER) AS a_start_5p,
      CAST('1970-01-01' AS DATE)+CAST(floor(quantile_cont(date-DATE '1970-01-01',0.95)) AS INTEGER) AS a_last_5p
      FROM hits GROUP BY 1,2""",
    "alabels": """SELECT doc_id AS a_id, CASE WHEN toxic=1 THEN 'bot' WHEN quality=1 THEN 'human' ELSE 'pothuman' END AS label
      FROM labels WHERE doc_id IN (SELECT h_a_id FROM hits)
      UNION ALL SELECT doc_id, 'pothuman' FROM labels WHERE quality=1 AND toxic<>1 AND doc_id IN (SELECT h_a_id FROM hits)""",
    "whiteip": "SELECT DISTINCT h_i_id AS i_id FROM hits WHERE h_i_id IN (5,17)",
    "emptydays": "SELECT DISTINCT date AS e_day FROM hits WHERE date IN ('2024-01-13','2024-01-22')",
    "spanel": """SELECT l_suppkey AS a_id, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS hits,
      CAST(sum(CASE WHEN l_returnflag NOT IN ('A','R') THEN l_quantity ELSE 0 END) AS BIGINT) AS c200,
      CAST(sum(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END) AS BIGINT) AS c404,
      CAST(sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) AS BIGINT) AS cblock,
      CAST(sum(CASE WHEN l_linenumber=1 AND l_quantity=50 THEN l_quantity ELSE 0 END) AS BIGINT) AS c429,
      CAST(sum(CASE WHEN l_linenumber=7 AND l_linestatus='F' THEN l_quantity ELSE 0 END) AS BIGINT) AS robots
      FROM lineitem GROUP BY 1,2""",
    "sidx": """SELECT *, CASE WHEN a_id%2=1 THEN 'abusive' ELSE 'verified' END AS arm,
      CASE a_id%4 WHEN 1 THEN 'abusive' WHEN 0 THEN 'verified' WHEN 3 THEN 'declared' ELSE 'pothuman' END AS pop,
      row_number() OVER (PARTITION BY a_id ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY a_id) AS n,
      c200/greatest(hits,1) AS p200, c404/greatest(hits,1) AS p404, cblock/greatest(hits,1) AS p_block, c429/greatest(hits,1) AS p_429,
      robots/greatest(hits,1) AS robots_rate, ln(1+hits) AS loghits,
      CASE WHEN hits-cblock-c429>0 THEN c404/(hits-cblock-c429) END AS p404_bi FROM spanel""",
    "sprof": """SELECT a_id, arm, pop, avg(p404_bi) AS m1, avg(robots_rate) AS m2, avg(loghits) AS m3 FROM sidx WHERE n>=20 GROUP BY 1,2,3""",
    "sframe": """SELECT avg(m1) AS u1, stddev_pop(m1)+1e-9 AS s1, avg(m2) AS u2, stddev_pop(m2)+1e-9 AS s2,
      avg(m3) AS u3, stddev_pop(m3)+1e-9 AS s3 FROM sprof WHERE arm='verified'""",
    "sobs": "SELECT s.*, sqrt(pow((p404_bi-u1)/s1,2)+pow((robots_rate-u2)/s2,2)+pow((loghits-u3)/s3,2)) AS o FROM sidx s, sframe WHERE n>=20",
    "scand": """SELECT a_id, i FROM (SELECT *, avg(cblock) OVER w AS m, stddev_pop(cblock) OVER w AS sd FROM sidx WINDOW w AS (PARTITION BY a_id))
      WHERE (n>=3 AND sd>0 AND cblock>greatest(m+1.5*sd,0)) OR c429>0""",
    "panel_end": "SELECT max(date) AS panel_end FROM spanel",
    "ip": """SELECT l_partkey AS i_name, l_suppkey AS i_agent, year(l_shipdate) AS i_year, month(l_shipdate) AS i_month,
      CASE WHEN l_partkey%10=0 THEN 1 ELSE 0 END AS i_proxy FROM lineitem""",
    "sdecoy": "SELECT l_suppkey AS uh_a_id, l_partkey AS uh_u_id, count(*) AS uh_total FROM lineitem WHERE l_partkey%5=3 GROUP BY 1,2",
    "scores": """SELECT user_id AS a_id, CAST(ts AS DATE) AS date, greatest(0.0, least(1.0, avg(value)/500)) AS score FROM events GROUP BY 1,2""",
    "sscores": "SELECT l_suppkey AS a_id, CAST(l_shipdate AS DATE) AS date, avg(l_discount*10) AS score FROM lineitem GROUP BY 1,2",
    "zdays": """SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM hits)::TIMESTAMP,
      (SELECT max(date) FROM hits)::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT date FROM hits)""",
    "dense": """SELECT a_id, CAST(d AS DATE) AS date FROM (SELECT a_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP,
      INTERVAL 1 DAY)) AS d FROM panel GROUP BY a_id)""",
    "perday": """SELECT h_a_id AS a_id, date, count(*) AS hits, count(*) FILTER (h_status=404) AS c404, count(*) FILTER (h_status=200) AS c200,
      count(*) FILTER (h_status IN (401,403)) AS cblock, count(*) FILTER (h_status=429) AS c429,
      count(*) FILTER (h_u_id=64) AS robots, count(*) FILTER (h_ccode='HU') AS hu,
      count(DISTINCT coalesce(h_i_id,-1)) AS n_ip, count(DISTINCT coalesce(h_d_id,-1)) AS n_dom, count(DISTINCT h_ccode) AS n_ctry,
      count(DISTINCT h_u_id) AS n_url, count(*) FILTER (lower(coalesce(u_extension,'(null)')) IN ('html','htm')) AS html,
      count(*) FILTER (lower(coalesce(u_extension,'(null)'))='php') AS php,
      count(*) FILTER (lower(coalesce(u_extension,'(null)'))='(null)') AS folder
      FROM hits JOIN url ON u_id=h_u_id GROUP BY 1,2""",
    "seq14": """SELECT a_id, date, row_number() OVER (PARTITION BY a_id ORDER BY date)-1 AS day, coalesce(hits,0) AS hits,
      coalesce(c404/hits,0.0) AS p404, coalesce(c200/hits,0.0) AS p200, coalesce(robots/hits,0.0) AS robots, 0.0::DOUBLE AS img,
      coalesce(html/hits,0.0) AS html, 0.0::DOUBLE AS js, coalesce(php/hits,0.0) AS php, coalesce(folder/hits,0.0) AS folder,
      coalesce(n_ip/hits,0.0) AS ip_ent, coalesce(n_dom/hits,0.0) AS dom_ent, coalesce(n_ctry/hits,0.0) AS ctry_ent,
      coalesce(n_url/hits,0.0) AS url_ent, coalesce(hu/hits,0.0) AS husource, coalesce(cblock,0) AS cblock, coalesce(c429,0) AS c429
      FROM dense LEFT JOIN perday USING (a_id, date) WHERE date NOT IN (SELECT date FROM zdays)""",
    "series": """SELECT s.*, label, (ip_ent+dom_ent+ctry_ent)/3 AS evasion_index, greatest(1.0-p200,0.0) AS resistance,
      robots AS compliance, url_ent AS request_diversity FROM seq14 s JOIN alabels USING (a_id)""",
    "active": """SELECT * FROM (SELECT *, ln(1+hits) AS log_hits, row_number() OVER (PARTITION BY a_id,label ORDER BY day)-1 AS i,
      count(*) OVER (PARTITION BY a_id,label) AS n FROM series WHERE hits>0) WHERE n>=20""",
    "sfeat": """SELECT s.a_id, s.arm, s.date, i, n, hits, p404, p200, robots_rate AS robots, p/hits AS ip_ent, l/hits AS dom_ent, f/hits AS ctry_ent,
      (p/hits+l/hits+f/hits)/3 AS evasion_index FROM sidx s JOIN (SELECT l_suppkey AS a_id, CAST(l_shipdate AS DATE) AS date,
      count(DISTINCT l_partkey) AS p, count(DISTINCT l_linenumber) AS l, count(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1,2) d
      ON d.a_id=s.a_id AND d.date=s.date""",
    "abusive": """SELECT a_id, tot AS decoy_hits, a_totalhit, least(1.0, greatest(0.0, tot/a_totalhit)) AS share FROM
      (SELECT uh_a_id, sum(uh_total) AS tot FROM honeypot GROUP BY 1) JOIN agent ON a_id=uh_a_id
      WHERE tot>0 AND least(1.0, greatest(0.0, tot/a_totalhit))>0.25""",
    "roster2": """SELECT a_id, role, role='abusive_share' AS is_bot, role='verified_human' AS is_control FROM (
      SELECT a_id, role, row_number() OVER (PARTITION BY a_id ORDER BY pr) AS rn FROM (
        SELECT a_id, 'verified_human' AS role, 1 AS pr FROM alabels WHERE label='human' UNION ALL
        SELECT a_id, 'abusive_share', 2 FROM abusive UNION ALL SELECT a_id, 'declared', 3 FROM alabels WHERE label='bot' UNION ALL
        SELECT a_id, 'pothuman', 4 FROM alabels WHERE label='pothuman')) WHERE rn=1""",
    "deaths": """SELECT a_id, max(date) AS t_death, arg_max(pre,date) AS pre_vol, arg_max(tail,date) AS tail_vol FROM (
      SELECT s.*, avg(hits) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre,
       avg(hits) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tail,
       max(hits) OVER (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS look FROM sidx s)
      WHERE arm='abusive' AND n>=25 AND i>=5 AND i+1<n AND pre>=5 AND tail<0.5*pre AND look<pre AND (a_id,i) IN (SELECT (a_id,i) FROM scand) GROUP BY a_id""",
    "ids": "SELECT DISTINCT a_id FROM spanel",
})
#: The deaths of both arms, for the queries that do not ask for the bot arm.
ALL_DEATHS = {"deaths": BASE["deaths"].replace("arm='abusive' AND ", "")}
for _g in (5, 11, 15, 16, 21):
    BASE.update(thin(f"sev{_g}", "scand", _g))


def compose(sql: str, doubles: list[str], extra: dict[str, str], digits: int = 6) -> str:
    """Put the needed common table expressions, in dependency order, before the final SELECT."""
    known = BASE | extra
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...] = ()):
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", text))):
            if word in known and word not in order and word not in stack:
                visit(known[word], (*stack, word))
                order.append(word)

    visit(sql)
    body = sql
    if doubles:
        rep = ", ".join(f"round(CAST({d} AS DOUBLE),{digits})+0.0 AS {d}" for d in doubles)
        body = f"SELECT * REPLACE ({rep}) FROM ({sql}) AS result_rows"
    head = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH RECURSIVE {head}\n{body}" if order else body


def did(name: str, src: str, value: str, a: str = "abusive", b: str = "verified", arm: str = "arm", by: str = "",
        reps: int = 2000, key: str = "a_id") -> tuple[str, dict[str, str]]:
    """Final SELECT and CTEs of a two-arm mean difference with a bootstrap interval."""
    bys = [x.strip() for x in by.split(",") if x.strip()]
    sel = "".join(f"{x}, " for x in bys)
    psel = "".join(f"p.{x}, " for x in bys)
    grp = ("GROUP BY " + ", ".join(bys)) if bys else ""
    c = {f"{name}_s": f"SELECT {sel}{key}, {arm} AS xarm, {value} AS x FROM {src} WHERE {value} IS NOT NULL AND {arm} IN ('{a}','{b}')"}
    c |= boot(name, f"{name}_s", key, ", ".join([*bys, "xarm"]), reps)
    c[f"{name}_m"] = f"SELECT {sel}rep, xarm, avg(x) AS m FROM {name}_d GROUP BY {sel}rep, xarm"
    c[f"{name}_r"] = f"SELECT {sel}rep, max(m) FILTER (xarm='{a}')-max(m) FILTER (xarm='{b}') AS stat FROM {name}_m GROUP BY {sel}rep"
    c[f"{name}_c"] = f"SELECT {sel}quantile_cont(stat,0.025) AS lo, quantile_cont(stat,0.975) AS hi FROM {name}_r {grp}"
    c[f"{name}_p"] = (f"SELECT {sel}avg(x) FILTER (xarm='{a}') AS ma, avg(x) FILTER (xarm='{b}') AS mb, count(x) FILTER (xarm='{a}') AS n_a, "
                      f"count(x) FILTER (xarm='{b}') AS n_b FROM {name}_s {grp}")
    on = " AND ".join(f"p.{x}=c.{x}" for x in bys) or "true"
    ok = "n_a>=5 AND n_b>=5"
    sql = (f"SELECT {psel}n_a, n_b, CASE WHEN {ok} THEN ma END AS mean_a, CASE WHEN {ok} THEN mb END AS mean_b, CASE WHEN {ok} THEN ma-mb END AS did, "
           f"CASE WHEN {ok} THEN lo END AS ci_lo, CASE WHEN {ok} THEN hi END AS ci_hi, ({ok} AND (lo>0 OR hi<0)) AS sig FROM {name}_p p LEFT JOIN {name}_c c ON {on}")
    return sql, c


DID_DOUBLES = "mean_a mean_b did ci_lo ci_hi"


def mean_ci(name: str, src: str, value: str, by: str = "", reps: int = 2000, key: str = "a_id", stat: str = "avg(x)",
            point: str | None = None) -> tuple[str, dict[str, str]]:
    """One-sample statistic with a bootstrap interval: columns by, mean, n, ci_lo, ci_hi."""
    bys = [x.strip() for x in by.split(",") if x.strip()]
    sel = "".join(f"{x}, " for x in bys)
    psel = "".join(f"p.{x}, " for x in bys)
    grp = ("GROUP BY " + ", ".join(bys)) if bys else ""
    c = {f"{name}_s": f"SELECT {sel}{key}, {value} AS x FROM {src} WHERE {value} IS NOT NULL"}
    c |= boot(name, f"{name}_s", key, by, reps)
    c[f"{name}_r"] = f"SELECT {sel}rep, {stat} AS stat FROM {name}_d GROUP BY {sel}rep"
    c[f"{name}_c"] = f"SELECT {sel}quantile_cont(stat,0.025) AS ci_lo, quantile_cont(stat,0.975) AS ci_hi FROM {name}_r {grp}"
    c[f"{name}_p"] = f"SELECT {sel}{point or stat} AS mean, count(x) AS n FROM {name}_s {grp}"
    on = " AND ".join(f"p.{x}=c.{x}" for x in bys) or "true"
    return f"SELECT {psel}mean, n, ci_lo, ci_hi FROM {name}_p p JOIN {name}_c c ON {on}", c


BASE.update({
    "rcand": """SELECT a_id, label, i FROM (SELECT *, avg(resistance) OVER w AS m, stddev_pop(resistance) OVER w AS sd,
      max(abs(resistance-r0)) OVER w AS sp FROM (SELECT *, first_value(resistance) OVER (PARTITION BY a_id,label ORDER BY i) AS r0 FROM active)
      WINDOW w AS (PARTITION BY a_id,label)) WHERE n>=3 AND sp>1e-8+1e-5*abs(r0) AND m+1.5*sd>0 AND resistance>m+1.5*sd""",
    "rev5_nx": "SELECT c.a_id, c.label, c.i, min(d.i) AS j FROM rcand c JOIN rcand d ON d.a_id=c.a_id AND d.label=c.label AND d.i>=c.i+5 GROUP BY 1,2,3",
    "rev5": """SELECT a_id, label, min(i) AS i FROM rcand GROUP BY a_id, label UNION ALL SELECT t.a_id, t.label, x.j FROM rev5 t JOIN rev5_nx x
      ON x.a_id=t.a_id AND x.label=t.label AND x.i=t.i""",
    "off21": "SELECT unnest(generate_series(-10,10)) AS t",
    "off11": "SELECT unnest(generate_series(-5,5)) AS t",
    "swin": """SELECT *, avg(loghits) OVER p AS pre_lv, avg(loghits) OVER q AS post_lv, avg(o) OVER b AS pre_o, avg(o) OVER q AS post_o, avg(o) OVER p AS near_o,
      avg(loghits) OVER b AS clean_lv FROM sobs WINDOW p AS (PARTITION BY a_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
      q AS (PARTITION BY a_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), b AS (PARTITION BY a_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING)""",
    "sout": """SELECT a_id, arm, pop, i, date, p_block, cblock, pre_o, post_o, post_o-pre_o AS d_o, clean_lv, pre_lv, post_lv, exp(post_lv)-1 AS post_v, exp(pre_lv)-1 AS pre_v,
      NOT (exp(post_lv)-1 < 0.5*(exp(pre_lv)-1)) AS stealth FROM swin JOIN sev16 USING (a_id,i) WHERE i>=10 AND i+5<n AND post_o-pre_o IS NOT NULL""",
    "sunit": "SELECT a_id, arm, avg(d_o) AS d_o, avg(CASE WHEN stealth THEN d_o END) AS d_o_stealth, count(*) AS n_events FROM sout GROUP BY 1,2",
    "traj11": """SELECT e.a_id, s.arm, t, avg(s.o-r.o) AS v FROM sev11 e CROSS JOIN off21 JOIN sobs s ON s.a_id=e.a_id AND s.i=e.i+t
      JOIN sobs r ON r.a_id=e.a_id AND r.i=e.i-6 WHERE e.i>=10 AND e.i+10<s.n AND r.o IS NOT NULL GROUP BY 1,2,3""",
    "traj16": """SELECT e.a_id, s.arm, t, avg(s.o) AS v FROM sev16 e CROSS JOIN off21 JOIN sobs s ON s.a_id=e.a_id AND s.i=e.i+t
      WHERE e.i>=10 AND e.i+10<s.n GROUP BY 1,2,3""",
})
