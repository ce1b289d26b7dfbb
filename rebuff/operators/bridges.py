"""Identity bridges: who takes over when an agent goes silent."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.functions.expressions import draw, safe_div
from rebuff.functions.resample import REPLICATES, interval, replicate_sums
from rebuff.session import materialize

WC, PLACEBO_OFFSET, MIN_DAYS = 14, 60, 15
POP_CAP, CORE_POP, TOP_K = 1000, 25, 40
TOPK_IP, IP_OVERLAP_CORE, IP_SHARED_MIN = 12, 0.5, 3
#: Agents from which a URL or address is dealt out in slices.
HEAVY = 2000
#: Links or pairs in one task: more of them make more tasks, not larger ones.
TASK_ROWS = 500_000
#: Bins of the rarest shared decoy's popularity.
BINS = ((0, 5), (6, 25), (26, 100), (101, 1_000_000_000))


def _edges(decoy: DataFrame) -> DataFrame:
    """Distinct (agent, decoy URL) with a positive total."""
    return decoy.where("uh_total > 0").select(F.col("uh_a_id").alias("a_id"), F.col("uh_u_id").alias("u")).distinct()


def decoy_popularity(decoy: DataFrame, cap: int | None = POP_CAP) -> DataFrame:
    """Agents per decoy URL; a URL beyond the cap does not link agents. ``None``: every URL does."""
    usable = F.lit(True) if cap is None else F.col("pop") <= cap
    return _edges(decoy).groupBy("u").agg(F.count(F.lit(1)).alias("pop")).withColumn("usable", usable)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows of links, pairs or days, one per core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def _gathered(df: DataFrame, keys: Sequence[str], value: str, how: str, tasks: int) -> DataFrame:
    """One row per ``keys`` with ``how`` ("min" or "sum") of ``value``.

    Rows of equal keys combine within each Arrow batch before they move, so a key of very many rows moves as few
    and no task keeps a table of all the keys it scans."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([(value, how)])
            yield from t.select([*keys, f"{value}_{how}"]).rename_columns([*keys, value]).cast(batch.schema).to_batches()
    df = df.select(*keys, value)
    return df.mapInArrow(run, df.schema).repartition(tasks, *keys).groupBy(*keys).agg(getattr(F, how)(value).alias(value))


def _sliced(edges: DataFrame, key: str, agent: str) -> DataFrame:
    """Edges with ``pop``, the agents per key, and ``slice``: 0, or one of many for a key of over ``HEAVY`` agents.

    ``edges`` are stored ones, since they are read three times. Heavy keys, at most one per ``HEAVY`` edges, are found first and their
    counts broadcast; the others are counted where their few edges meet. So a key that a third of all agents share is nowhere one task's work."""
    slices = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.where(F.col(key).isNotNull())
    tasks = tasks_for(edges, edges.count())
    heavy = _gathered(edges.select(key, F.lit(1).cast("long").alias("_pop")), [key], "_pop", "sum", tasks).where(F.col("_pop") > HEAVY)
    e = edges.join(F.broadcast(heavy), key, "left")
    e = e.withColumn("slice", F.when(F.col("_pop").isNull(), 0).otherwise(F.pmod(F.xxhash64(agent), F.lit(slices)).cast("int"))).repartition(tasks, key, "slice")
    return e.withColumn("pop", F.coalesce("_pop", F.count(F.lit(1)).over(Window.partitionBy(key, "slice")))).drop("_pop")


def _linked(dead: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(dead side's columns, a_succ) over shared keys, dealt out by pair. A heavy key's dead rows, few beside its agents, go to all its slices."""
    slices = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks_for(dead, dead.agg(F.sum("pop")).first()[0] or 0)
    every = F.when(F.col("pop") > HEAVY, F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    dead = dead.drop("slice").withColumn("slice", F.explode(every)).repartition(tasks, key, "slice")
    edges = edges.select(F.col("a_id").alias("a_succ"), key, "slice").repartition(tasks, key, "slice")
    return edges.join(dead.hint("shuffle_hash"), [key, "slice"]).where("a_succ <> a_death").repartition(tasks, "a_death", "a_succ")


def _decoy_links(decoy: DataFrame, deaths: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """Stored edges (agent, decoy URL) and those of the dead."""
    e = materialize(_sliced(materialize(_edges(decoy)), "u", "a_id").withColumn("usable", F.lit(True) if cap is None else F.col("pop") <= cap))
    return e, materialize(e.join(deaths.select("a_id"), "a_id").select(F.col("a_id").alias("a_death"), "u", "pop", "usable", "slice"))


def _decoy_pairs(e: DataFrame, dead: DataFrame) -> DataFrame:
    return (_linked(dead.where("usable"), e, "u")
            .groupBy("a_death", "a_succ").agg(F.count(F.lit(1)).alias("shared_hp"), F.sum(1 / F.col("pop")).alias("rare_score"), F.min("pop").alias("min_pop")))


def _ip_links(ip: DataFrame, deaths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored links (address, agent) and the clean ones of the dead."""
    ip = ip.where("i_name is not null").select("i_name", F.col("i_agent").alias("a_id"), F.col("i_proxy").alias("_clean"))
    links = materialize(_sliced(materialize(_gathered(ip, ["i_name", "a_id"], "_clean", "min", tasks_for(ip, ip.count()))), "i_name", "a_id"))
    return links, materialize(links.where("_clean = 0").join(deaths.select("a_id"), "a_id").select(F.col("a_id").alias("a_death"), "i_name", "pop", "slice"))


def candidate_pairs(decoy: DataFrame, ip: DataFrame, deaths: DataFrame, cap: int | None = POP_CAP) -> DataFrame:
    """(a_death, a_succ, bridge) of all candidates of both bridges, without what only their estimators need."""
    links, dead = _ip_links(ip, deaths)
    return (_decoy_pairs(*_decoy_links(decoy, deaths, cap)).select("a_death", "a_succ", F.lit("decoy").alias("bridge"))
            .unionByName(_linked(dead, links, "i_name").select("a_death", "a_succ").distinct().withColumn("bridge", F.lit("ip"))))


def decoy_bridge(decoy: DataFrame, deaths: DataFrame, cap: int | None = POP_CAP) -> DataFrame:
    """Candidates sharing a usable decoy with each death: shared count, sum of 1/popularity, rarest
    popularity, Jaccard, and ``rank``, the place among the death's candidates, rarest first.

    The popularity cap is part of the estimator; without it (``None``) every URL links. Jaccard is over
    uncapped sets: intersections on popular URLs are counted only for pairs that already exist. A caller's filter
    on the rank becomes a limit per task before the ranking's shuffle.
    """
    e, dead = _decoy_links(decoy, deaths, cap)
    size = e.groupBy("a_id").agg(F.count(F.lit(1)).alias("_urls"))
    pairs = _decoy_pairs(e, dead)
    popular = (pairs.select("a_death", "a_succ").join(dead.where("not usable").select("a_death", "u"), "a_death")
               .join(e.where("not usable").select(F.col("a_id").alias("a_succ"), "u"), ["a_succ", "u"])
               .groupBy("a_death", "a_succ").agg(F.count(F.lit(1)).alias("_more")))
    d = (pairs.join(popular, ["a_death", "a_succ"], "left")
         .join(size.select(F.col("a_id").alias("a_death"), F.col("_urls").alias("_na")), "a_death")
         .join(size.select(F.col("a_id").alias("a_succ"), F.col("_urls").alias("_nb")), "a_succ"))
    union = F.col("_na") + F.col("_nb") - F.col("shared_hp") - F.coalesce("_more", F.lit(0))
    d = d.select("a_death", "a_succ", "shared_hp", "rare_score", "min_pop", (F.col("shared_hp") / union).alias("jaccard"),
                 (F.col("min_pop") <= CORE_POP).cast("int").alias("in_core"))
    w = Window.partitionBy("a_death").orderBy(F.desc(F.round("rare_score", 9)), F.asc("a_succ"))
    return d.withColumn("rank", F.row_number().over(w))


def ip_footprint(ip: DataFrame) -> DataFrame:
    """Distinct non-proxy addresses per agent."""
    return ip.where("i_proxy = 0").groupBy(F.col("i_agent").alias("a_id")).agg(F.count_distinct("i_name").alias("n_ip"))


def ip_bridge(ip: DataFrame, deaths: DataFrame, k: int = TOPK_IP) -> DataFrame:
    """Candidates sharing addresses with each death; the proxy filter is on the dying side only. ``rank_shared`` is
    the place by shared addresses, ``rank`` the one by which the estimator keeps its best ``k``: those among the first
    4 k by shared addresses come first, the precise ones before the others. No candidate is dropped here.

    Both sides are distinct (address, agent) pairs before the join, and only the dead agents'
    addresses enter it. An address used by very many agents is dealt out in slices.
    """
    links, dead = _ip_links(ip, deaths)
    # The footprint of a dead agent is counted over its links and goes with them.
    dead = dead.withColumn("n_ip", F.count(F.lit(1)).over(Window.partitionBy("a_death")))
    d = _linked(dead, links, "i_name").groupBy("a_death", "a_succ").agg(F.count(F.lit(1)).alias("shared_ips"), F.max("n_ip").alias("n_ip"))
    # One sort serves both ranks: inside the first 4 k, and behind them, core candidates come first and keep their order.
    by = Window.partitionBy("a_death")
    order = by.orderBy(F.desc("shared_ips"), F.asc("a_succ"))
    d = d.withColumns({"rank_shared": F.row_number().over(order), "overlap_frac": F.col("shared_ips") / F.col("n_ip")})
    d = d.withColumn("in_core", ((F.col("overlap_frac") >= IP_OVERLAP_CORE) & (F.col("shared_ips") >= IP_SHARED_MIN)).cast("int"))
    core, first = F.col("in_core") == 1, F.col("rank_shared") <= 4 * k
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_core": F.count_if(core).over(upto), "_early": F.count_if(core & first).over(upto)})
    d = d.withColumns({"_cores": F.max("_core").over(by), "_earlies": F.max("_early").over(by)})
    place = (F.when(first & core, F.col("_core")).when(first, F.col("_earlies") + F.col("rank_shared") - F.col("_core"))
             .when(core, 4 * k + F.col("_core") - F.col("_early")).otherwise(F.col("rank_shared") + F.col("_cores") - F.col("_core")))
    return d.withColumn("rank", place.cast("int")).select("a_death", "a_succ", "shared_ips", "rank_shared", "overlap_frac", "in_core", "rank")


def date_window_stats(series: DataFrame, centres: DataFrame, days: int = WC) -> DataFrame:
    """Per (a_id, t): log1p volume, mean botness and observed days in [t-days, t) and [t, t+days).

    An agent's days and its centres are one row each, at most one value per calendar day; windows are differences of
    running sums at three looked-up places, so a centre costs the same whatever the window's length. Agents that
    were silent keep zero volume.
    """
    def num(c):
        return F.datediff(F.col(c), F.lit("1970-01-01"))
    at = centres.select("a_id", num("t").alias("t")).distinct().groupBy("a_id").agg(F.collect_list("t").alias("t"))
    own = series.join(centres.select("a_id").distinct(), "a_id", "left_semi").groupBy("a_id").agg(
        F.collect_list(F.struct(num("date").alias("d"), F.col("hits").cast("double").alias("h"), F.col("b").cast("double").alias("b"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, stats = [], []
            for k in range(batch.num_rows):
                t, s = np.array(batch.column(1)[k].values, np.int64), batch.column(2)[k].values
                d, h, x = (s.field(i).to_numpy(zero_copy_only=False) for i in range(3)) if s is not None else (np.empty(0), np.empty(0), np.empty(0))
                order = np.argsort(d, kind="stable")
                d, h, x = d[order], h[order], x[order]
                known = np.isfinite(x)
                sums = [np.concatenate(([0.0], np.cumsum(y))) for y in (np.nan_to_num(h), np.where(known, x, 0.0), known, np.ones(len(d)))]
                lo, mid, hi = (np.searchsorted(d, y) for y in (t - days, t, t + days))
                pre, post = ([y[to] - y[of] for y in sums] for of, to in ((lo, mid), (mid, hi)))
                ids.append(np.full(len(t), k))
                stats.append(np.stack([t, *pre, *post]))
            if not ids:
                continue
            t, v0, b0, k0, n0, v1, b1, k1, n1 = np.concatenate(stats, axis=1)
            def mean(total, count):
                return pa.array(total / np.maximum(count, 1), pa.float64(), mask=count == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(t.astype(np.int32)).cast(pa.date32()), pa.array(np.log1p(v0)), pa.array(np.log1p(v1)),
                                              mean(b0, k0), mean(b1, k1), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64))], ["a_id", "t", "v_pre", "v_post", "b_pre", "b_post", "n_pre", "n_post"])
    kind = centres.schema["a_id"].dataType.simpleString()
    return at.join(own, "a_id", "left").mapInArrow(run, f"a_id {kind}, t date, v_pre double, v_post double, b_pre double, b_post double, n_pre long, n_post long")


def observed_agents(series: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    return series.groupBy("a_id").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") >= min_days).select("a_id")


def pair_event_study(candidates: DataFrame, deaths: DataFrame, series: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Both sides' change around the death date and the successor's placebo change 60 days earlier.
    Successors with too few days, or never seen after the date, are dropped (see the register)."""
    series = materialize(series.select("a_id", "date", "hits", "b"))
    c = materialize(candidates.join(deaths.select(F.col("a_id").alias("a_death"), F.col("t_death").alias("t_A")), "a_death"))
    at_death = c.select(F.col("a_death").alias("a_id"), F.col("t_A").alias("t"))
    at_succ = c.select(F.col("a_succ").alias("a_id"), F.col("t_A").alias("t"))
    placebo = at_succ.withColumn("t", F.date_sub("t", PLACEBO_OFFSET))
    st = materialize(date_window_stats(series, at_death.unionByName(at_succ).unionByName(placebo)))
    def pick(agent, t, tag):
        cols = [F.col(x).alias(f"{tag}_{x}") for x in ("v_pre", "v_post", "b_pre", "b_post", "n_post")]
        return st.select(F.col("a_id").alias(agent), F.col("t").alias(t), *cols)
    d = (c.join(observed_agents(series, min_days).withColumnRenamed("a_id", "a_succ"), "a_succ", "left_semi")
         .join(pick("a_death", "t_A", "A"), ["a_death", "t_A"]).join(pick("a_succ", "t_A", "B"), ["a_succ", "t_A"])
         .withColumn("_tp", F.date_sub("t_A", PLACEBO_OFFSET)).join(pick("a_succ", "_tp", "P"), ["a_succ", "_tp"]))
    d = d.where("B_n_post > 0")
    keep = [x for x in candidates.columns if x not in ("a_death", "a_succ")]
    return d.select(
        "a_death", "a_succ", "t_A", *keep, F.col("A_b_pre").alias("bA_pre"), (F.col("A_b_post") - F.col("A_b_pre")).alias("dA_b"),
        (F.col("A_v_post") - F.col("A_v_pre")).alias("dA_v"), F.col("B_b_post").alias("bB_post"), (F.col("B_b_post") - F.col("B_b_pre")).alias("dB_b"),
        (F.col("B_v_post") - F.col("B_v_pre")).alias("dB_v"), (F.col("P_v_post") - F.col("P_v_pre")).alias("dB_v_placebo"))


def pair_dedup(pairs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row per (death, successor) in an explicit order. The pairs are stored first, so that their number gives that of the tasks."""
    pairs = materialize(pairs)
    pairs = pairs.repartition(tasks_for(pairs, pairs.count()), "a_death", "a_succ")
    w = Window.partitionBy("a_death", "a_succ").orderBy(*order)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def strata(pairs: DataFrame) -> DataFrame:
    """Every pair is in the envelope; precise ones are also in the core."""
    return pairs.withColumn("stratum", F.explode(F.when(F.col("in_core") == 1, F.array(F.lit("core"), F.lit("envelope"))).otherwise(F.array(F.lit("envelope")))))


def _cluster_interval(p: DataFrame, cluster: str, value: str, lo: str, hi: str, reps: int) -> DataFrame:
    """Cluster bootstrap of a pair mean from cluster sums."""
    c = materialize(p.groupBy("stratum", cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_m")))
    d = replicate_sums(c, cluster, ["stratum"], ["_s", "_m"], reps).withColumn("stat", F.col("_s") / F.nullif("_m", F.lit(0.0)))
    return d.groupBy("stratum").agg(*interval(lo=lo, hi=hi))


def transfer_summary(pairs: DataFrame, reps: int = REPLICATES) -> DataFrame:
    """Per stratum: successor ramp and botness change with death- and date-clustered intervals,
    placebo change, ramp minus placebo, concentration on the largest date."""
    p = materialize(strata(pairs))
    t = p.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("a_death").alias("n_deaths"), F.count_distinct("t_A").alias("n_dates"),
        F.avg("dB_v").alias("dvol_mean"), F.avg("dB_b").alias("dbot_mean"), F.avg("dB_v_placebo").alias("dvol_placebo"))
    top = p.groupBy("stratum", "t_A").agg(F.count(F.lit(1)).alias("_n")).groupBy("stratum").agg((F.max("_n") / F.sum("_n")).alias("largest_date_share"))
    t = t.join(top, "stratum").withColumn("ramp_minus_placebo", F.col("dvol_mean") - F.col("dvol_placebo"))
    for cluster, value, tag in (("a_death", "dB_v", "dvol"), ("a_death", "dB_b", "dbot"), ("t_A", "dB_v", "dvol_date")):
        t = t.join(_cluster_interval(p, cluster, value, f"{tag}_lo", f"{tag}_hi", reps), "stratum", "left")
    return t


def transfer_rates(pairs: DataFrame, deaths: DataFrame) -> DataFrame:
    """Share of deaths with a successor, per stratum."""
    n = deaths.agg(F.count(F.lit(1)).alias("n_deaths"))
    return strata(pairs).groupBy("stratum").agg(F.count_distinct("a_death").alias("n_with_successor")).crossJoin(F.broadcast(n)).withColumn(
        "rate", F.col("n_with_successor") / F.greatest("n_deaths", F.lit(1)))


def null_pool(pairs: DataFrame, deaths: DataFrame, series: DataFrame, days: int = WC) -> DataFrame:
    """One row per successor over the unrelated death dates: ``c`` and ``d``, the records on all and on dormant dates, ``ok``,
    the dates that are not dormant, and for those in their order ``dv`` and ``upto``, the running number of records.

    The dates are one array of at most one entry per calendar day, and so are a successor's days and results. Linked
    dates (from ALL pairs) are removed per successor before anything is measured."""
    def num(c):
        return F.datediff(F.col(c), F.lit("1970-01-01"))
    dates = deaths.groupBy(num("t_death").alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("_d"))
    succ = pairs.groupBy("a_succ").agg(F.collect_set(num("t_A")).alias("_linked"))
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = series.join(succ.select(F.col("a_succ").alias("a_id")), "a_id", "left_semi").repartition(parts, "a_id").groupBy(F.col("a_id").alias("a_succ")).agg(
        F.sort_array(F.collect_list(F.struct(num("date").alias("d"), F.col("hits").cast("double").alias("h")))).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                all_t, all_n = (np.asarray(batch.column(3)[k].values.field(f)) for f in range(2))
                free = ~np.isin(all_t, np.asarray(batch.column(1)[k].values))
                t, n = all_t[free].astype(np.int64), all_n[free]
                own = batch.column(2)[k].values
                d, h = (np.asarray(own.field(f)) for f in range(2)) if own is not None else (np.empty(0), np.empty(0))
                volume = np.concatenate(([0.0], np.cumsum(np.nan_to_num(h))))
                lo, mid, hi = (np.searchsorted(d, x) for x in (t - days, t, t + days))
                seen = hi > lo
                dv = np.log1p(volume[hi] - volume[mid]) - np.log1p(volume[mid] - volume[lo])
                rows.append((n.sum(), n[~seen].sum(), seen.sum(), dv[seen], np.cumsum(n[seen])))
            columns = [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())))]]
            yield pa.RecordBatch.from_arrays(columns, ["a_succ", "c", "d", "ok", "dv", "upto"])
    kind = pairs.schema["a_succ"].dataType.simpleString()
    return (succ.join(own, "a_succ", "left").crossJoin(F.broadcast(dates)).select("a_succ", "_linked", "_s", "_d")
            .mapInArrow(run, f"a_succ {kind}, c long, d long, ok long, dv array<double>, upto array<long>"))


def eligible_null_dates(pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dormant shares (successor- and pair-weighted) and attrition per stratum."""
    p = strata(pairs).groupBy("stratum", "a_succ").agg(F.count(F.lit(1)).alias("w")).join(pool.select("a_succ", "c", "d", "ok"), "a_succ", "left")
    d, c, w = (F.coalesce(F.col(x), F.lit(0)) for x in ("d", "c", "w"))
    ok = F.coalesce(F.col("ok"), F.lit(0)) > 0
    return p.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_successors"), F.count_if(ok).alias("n_successors_supported"), F.sum("w").alias("n_pairs"),
        safe_div(F.sum(d), F.sum(c)).alias("dormant_share"), safe_div(F.sum(d * w), F.sum(c * w)).alias("dormant_share_pair_weighted"),
        (1 - F.sum(F.when(ok, w).otherwise(0)) / F.sum(w)).alias("attrition"))


def link_permutation_null(pool: DataFrame, pairs: DataFrame, draws: int = 200, seed=42) -> DataFrame:
    """Distribution of the mean successor change around unrelated dates, on fixed support, for
    record-weighted and unique-date pools.

    A draw is an index into a successor's eligible dates. A successor is one row with all its draws, and a task sums
    them up per (stratum, pool, draw), so nothing grows with successors x draws."""
    counts = strata(pairs).groupBy("stratum", "a_succ").agg(F.count(F.lit(1)).alias("k"))
    total = counts.groupBy("stratum").agg(F.sum("k").alias("n_pairs"))
    size = {"records": F.element_at("upto", -1), "unique": F.size("dv").cast("long")}
    def drawn(dates: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda rep: draw(seed, size[dates], F.lit(dates), F.col("a_succ"), rep))
    d = (pool.where("ok > 0").join(counts.groupBy("a_succ").agg(F.collect_list(F.struct("stratum", "k")).alias("_w")), "a_succ")
         .select("dv", "upto", "_w", *[drawn(dates).alias(dates) for dates in size]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                dv, upto, records, unique = (np.asarray(batch.column(c)[k].values) for c in ("dv", "upto", "records", "unique"))
                value = {"records": dv[np.searchsorted(upto, records, "right")], "unique": dv[unique]}
                for w in batch.column("_w")[k].as_py():
                    for dates, v in value.items():
                        sums.setdefault((w["stratum"], dates), np.zeros((2, draws)))[:] += v * w["k"], np.full(draws, w["k"])
        for (stratum, dates), (s, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(stratum, draws), pa.repeat(dates, draws), pa.array(np.arange(1, draws + 1), pa.int32()), pa.array(s), pa.array(n.astype(np.int64))],
                                             ["stratum", "dates", "rep", "_s", "_k"])
    rep = d.mapInArrow(run, "stratum string, dates string, rep int, _s double, _k long").groupBy("stratum", "dates", "rep").agg(
        (F.sum("_s") / F.sum("_k")).alias("stat"), F.sum("_k").alias("_k"))
    out = rep.groupBy("stratum", "dates").agg(F.avg("stat").alias("null_mean"), *interval(lo="null_lo", hi="null_hi"), F.count(F.lit(1)).alias("n_draws"),
                                              F.max("_k").alias("n_pairs_evaluated"))
    return out.join(total, "stratum").withColumn("coverage", F.col("n_pairs_evaluated") / F.greatest("n_pairs", F.lit(1)))


def _in_bins(pairs: DataFrame, bins: Sequence[tuple[int, int]]) -> Column:
    return F.filter(F.array(*[F.when(F.col("min_pop").between(lo, hi), F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")))
                              for lo, hi in bins]), lambda x: x.isNotNull())


def specificity_partition(pairs: DataFrame, bins: Sequence[tuple[int, int]] = BINS) -> DataFrame:
    """Pair effects by the rarest shared decoy; each pair must fall into exactly one bin."""
    d = pairs.withColumn("_b", _in_bins(pairs, bins)).withColumn("_m", F.size("_b"))
    check = d.agg(F.count_if(F.col("_m") == 1).alias("n_covered"), F.count_if(F.col("_m") == 0).alias("n_uncovered"), F.count_if(F.col("_m") > 1).alias("n_double"))
    t = d.withColumn("x", F.explode("_b")).groupBy("x.lo", "x.hi").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("a_death").alias("n_deaths"), F.count_distinct("t_A").alias("n_dates"),
        F.avg("dB_v").alias("dvol_mean"), F.avg("dB_b").alias("dbot_mean"))
    return t.crossJoin(F.broadcast(check))


def leave_date_out(pairs: DataFrame, reps: int = REPLICATES) -> DataFrame:
    """Effect without the most represented date (ties: the earliest), date-clustered."""
    n = pairs.groupBy("t_A").agg(F.count(F.lit(1)).alias("_n"))
    big = n.agg(F.max(F.struct("_n", (-F.datediff("t_A", F.lit("1970-01-01"))).alias("_t"))).alias("m")).select(
        F.date_add(F.lit("1970-01-01").cast("date"), -F.col("m._t")).alias("big_date"), F.col("m._n").alias("n_on_date"))
    rest = materialize(pairs.crossJoin(F.broadcast(big)).where("t_A <> big_date").withColumn("stratum", F.lit("rest")))
    t = rest.groupBy("stratum", "big_date", "n_on_date").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("a_death").alias("n_deaths"),
                                                           F.count_distinct("t_A").alias("n_dates"), F.avg("dB_v").alias("dvol_mean"))
    return t.join(_cluster_interval(rest, "t_A", "dB_v", "ci_lo", "ci_hi", reps), "stratum", "left").drop("stratum")


def planted_handoff(series: DataFrame, bots: Column, min_days: int = MIN_DAYS, placebo_shift: int = 60) -> DataFrame:
    """Positive control: real series cut at their midpoint into a dying and a born half, two agents to
    ``date_window_stats``. The volume must collapse in A, ramp in B, and the placebo of B must stay 0."""
    s = series.where(bots)
    span = s.groupBy("a_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where(F.datediff("hi", "lo") >= 4 * WC)
    cut = span.select("a_id", F.date_add("lo", F.floor(F.datediff("hi", "lo") / 2).cast("int")).alias("t"))
    d = s.join(cut, "a_id").withColumn("half", F.when(F.col("date") < F.col("t"), "A").otherwise("B"))
    d = materialize(d.select(F.col("a_id").alias("own"), F.concat_ws("/", "a_id", "half").alias("a_id"), "half", "t", "date", "hits", "b"))
    halves = materialize(d.groupBy("own", "half", "a_id", "t").agg(F.count(F.lit(1)).alias("days")).where(f"days >= {min_days}"))

    def at(half: str, shift: int, tag: str) -> DataFrame:
        """The windows of one half around its cut, or ``shift`` days before it."""
        c = halves.where(F.col("half") == half).select("own", "a_id", F.date_sub("t", shift).alias("t"))
        st = date_window_stats(d.drop("t"), c.select("a_id", "t")).withColumn("change", F.col("v_post") - F.col("v_pre"))
        return c.join(st, ["a_id", "t"]).select("own", *[F.col(x).alias(f"{x}_{tag}") for x in ("change", "b_pre", "b_post", "n_post")])
    p = at("A", 0, "a").join(at("B", 0, "b"), "own").join(at("B", placebo_shift, "z"), "own").where("n_post_b > 0")
    return p.agg(F.count(F.lit(1)).alias("n_planted"), F.avg("change_a").alias("dA_v_mean"), F.avg("change_b").alias("dB_v_mean"),
                 F.avg("change_z").alias("dB_v_placebo_mean"), F.avg(F.col("b_post_b") - F.col("b_pre_a")).alias("b_transfer_bias"),
                 F.corr("b_pre_a", "b_post_b").alias("b_corr"), F.avg((F.col("change_b") > F.col("change_z")).cast("double")).alias("frac_ramp"))


def coverage_register(candidates: DataFrame, deaths: DataFrame, series: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Every candidate pair with the reason it was or was not evaluated, and every death without a candidate."""
    days = series.groupBy("a_id").agg(F.count(F.lit(1)).alias("_days"), F.max("date").alias("_last"))
    c = candidates.select("a_death", "a_succ").join(deaths.select(F.col("a_id").alias("a_death"), F.col("t_death").alias("t_A")), "a_death")
    st = date_window_stats(series, c.select(F.col("a_succ").alias("a_id"), F.col("t_A").alias("t"))).select(
        F.col("a_id").alias("a_succ"), F.col("t").alias("t_A"), "n_post")
    d = c.join(days.withColumnRenamed("a_id", "a_succ"), "a_succ", "left").join(st, ["a_succ", "t_A"])
    reason = (F.when(F.col("_days").isNull(), "no_series").when(F.col("_days") < min_days, "below_min_days")
              .when(F.col("n_post") == 0, "unobserved_after").otherwise("evaluated"))
    alone = deaths.select(F.col("a_id").alias("a_death")).join(candidates.select("a_death"), "a_death", "left_anti")
    return d.select("a_death", "a_succ", reason.alias("reason")).unionByName(
        alone.select("a_death", F.lit(None).cast(candidates.schema["a_succ"].dataType).alias("a_succ"), F.lit("no_candidate").alias("reason")))
