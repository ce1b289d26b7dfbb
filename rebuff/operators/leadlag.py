"""Lead-lag between friction and response: cross-correlations, peaks, shift nulls, censoring."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rebuff.functions.distributed import BUCKETS, exact_quantiles, middle_ranges, range_medians, ranked_values
from rebuff.functions.expressions import draw, safe_div
from rebuff.functions.lagged import TINY, lag_curve, masked_curve, rotation_peaks, standardized
from rebuff.operators import inference as I
from rebuff.session import materialize

LAG_MAX = 14
SHIFT_MIN = 15
MIN_DAYS, MIN_BLOCK_DAYS = 30, 3
#: Density bands of an agent's calendar.
DENSE, MID = 0.50, 0.25


def cohort(idx: DataFrame) -> DataFrame:
    """Agents with enough active days, block days and varying friction; density of their calendar."""
    a = idx.groupBy("a_id", "pop", "arm").agg(
        F.count(F.lit(1)).alias("n_active"), F.count_if(F.col("cblock") > 0).alias("block_days"), F.stddev_pop("p_block").alias("_sd"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("n_calendar"))
    a = a.where((F.col("n_active") >= MIN_DAYS) & (F.col("block_days") >= MIN_BLOCK_DAYS) & (F.col("_sd") >= TINY)).drop("_sd")
    return a.withColumn("density", F.col("n_active") / F.col("n_calendar"))


def _members(df: DataFrame, members: DataFrame) -> DataFrame:
    return df.join(members.select("a_id"), "a_id", "left_semi")


def active_series(idx: DataFrame, members: DataFrame) -> DataFrame:
    return _members(idx, members).select("a_id", "i", F.col("p404").alias("r"), F.col("p_block").alias("f"))


def calendar_series(idx: DataFrame, members: DataFrame) -> DataFrame:
    """Observed days of the calendar, i counted from 1970. A day without requests is a real zero for both
    rates; such days are filled in where the series is an array."""
    def rate(c):
        return F.when(F.col("hits") > 0, F.col(c) / F.col("hits")).otherwise(F.lit(0.0))
    return _members(idx, members).select("a_id", F.datediff("date", F.lit("1970-01-01")).cast("long").alias("i"), rate("c404").alias("r"), rate("cblock").alias("f"))


def windowed_curves(series: DataFrame) -> DataFrame:
    """(a_id, lag, ccf) as ``ccf`` gives them, another way: rows looked up over windows instead of arrays.

    Only the observed days move. The gap up to an agent's next day is filled in behind the shuffle, so that days follow
    each other in rows, and a lag is a row looked up; sums per agent need no further shuffle."""
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("a_id").orderBy("i")
    whole = Window.partitionBy("a_id")
    d = series.select("a_id", "i", "r", "f").repartition(parts, "a_id").withColumn("_next", F.coalesce(F.lead("i").over(w), F.col("i") + 1))
    d = d.withColumn("day", F.explode(F.sequence("i", F.col("_next") - 1)))
    seen = F.col("day") == F.col("i")
    d = d.select("a_id", F.col("day").alias("i"), *[F.when(seen, F.col(c)).otherwise(0.0).alias(c) for c in "rf"])
    d = d.withColumns({"n": F.count(F.lit(1)).over(whole)} | {f"_{t}{c}": x(c).over(whole) for c in "rf" for t, x in (("m", F.avg), ("s", F.stddev_pop))})
    d = d.where((F.col("_sr") >= TINY) & (F.col("_sf") >= TINY))
    d = d.select("a_id", "i", "n", *[((F.col(c) - F.col(f"_m{c}")) / (F.col(f"_s{c}") + TINY)).alias(f"z{c}") for c in "rf"])
    def product(k):
        return F.col("zr") * F.lag("zf", k).over(w) if k >= 0 else F.lag("zr", -k).over(w) * F.col("zf")
    lags = range(-LAG_MAX, LAG_MAX + 1)
    d = d.select("a_id", "n", *[product(k).alias(f"p{k + LAG_MAX}") for k in lags])
    sums = d.groupBy("a_id").agg(F.max("n").alias("n"), *[F.sum(f"p{k + LAG_MAX}").alias(f"p{k + LAG_MAX}") for k in lags])
    curve = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), (F.col(f"p{k + LAG_MAX}") / F.col("n")).alias("ccf")) for k in lags])
    return sums.select("a_id", F.explode(curve).alias("c")).select("a_id", "c.lag", "c.ccf")


def _arrays(series: DataFrame) -> DataFrame:
    """One row per agent, at most one value per day in it, and the span n. Agents are spread over all tasks
    before they are gathered, since the work behind them is larger than the rows are."""
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(parts, "a_id").groupBy("a_id").agg(
        F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("r").cast("double").alias("r"), F.col("f").cast("double").alias("f"))).alias("days"),
        (F.max("i") - F.min("i") + 1).cast("long").alias("n"))


def _grids(days: pa.ListArray, missing: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(r, f) of every agent of a batch on its span of days; days without a row get ``missing``."""
    bounds = days.offsets.to_numpy() - days.offsets[0].as_py()
    flat = days.flatten()
    i, r, f = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = i[a:b] - i[a:b].min()
        grid = np.full((2, at.max() + 1), missing)
        grid[0, at], grid[1, at] = r[a:b], f[a:b]
        yield grid[0], grid[1]


def _curves(series: DataFrame, curve: Callable, missing: float) -> DataFrame:
    """(a_id, lag, ccf) for the agents that have a curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lags = np.arange(-LAG_MAX, LAG_MAX + 1)
        for b in batches:
            curves = [curve(r, f) for r, f in _grids(b.column(1), missing)]
            held = [k for k, c in enumerate(curves) if c is not None]
            values = np.concatenate([curves[k] for k in held]) if held else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(held, len(lags)).astype(np.int64))), pa.array(np.tile(lags, len(held)), pa.int64()),
                                              pa.array(values, pa.float64(), mask=np.isnan(values))], ["a_id", "lag", "ccf"])
    return _arrays(series).select("a_id", "days").mapInArrow(run, f"a_id {series.schema['a_id'].dataType.simpleString()}, lag long, ccf double")


def ccf(series: DataFrame) -> DataFrame:
    """Normalised cross-correlation of response on friction; positive lag = response follows. Days missing
    inside an agent's span are zero. An agent's 29 lags are one matrix product on its array."""
    return _curves(series, lambda r, f: lag_curve(r, f, LAG_MAX), 0.0)


def ccf_masked(idx: DataFrame, members: DataFrame, min_shared: int = 10) -> DataFrame:
    """Pairwise-complete version: each lag uses only dates observed in both series, with its own
    moments; the array's missing days are the mask."""
    d = _members(idx, members).select("a_id", F.datediff("date", F.lit("1970-01-01")).alias("i"), F.col("p404").alias("r"), F.col("p_block").alias("f"))
    return _curves(d, lambda r, f: masked_curve(r, f, LAG_MAX, min_shared), np.nan)


def peaks(curves: DataFrame, keys: Sequence[str] = ("a_id",)) -> DataFrame:
    """Strongest |ccf| on either side (lag 0 excluded; ties go to the smallest lag), responder flag."""
    def best(cond):
        return F.max(F.when(cond & F.col("ccf").isNotNull(), F.struct(F.abs("ccf").alias("a"), (-F.col("lag")).alias("l"), F.col("ccf").alias("c"))))
    p = curves.groupBy(*keys).agg(best(F.col("lag") >= 1).alias("_q"), best(F.col("lag") <= -1).alias("_p"))
    return p.select(*keys, (-F.col("_q.l")).alias("post_lag"), F.col("_q.c").alias("post_ccf"), (-F.col("_p.l")).alias("pre_lag"),
                    F.col("_p.c").alias("pre_ccf"), (F.abs("_q.c") > F.abs("_p.c")).alias("responder"))


def agent_peaks(idx: DataFrame, members: DataFrame) -> DataFrame:
    """Peaks per agent on both indexings; an agent without a varying series keeps NULLs."""
    out = None
    for name, s in (("active", active_series(idx, members)), ("calendar", calendar_series(idx, members))):
        part = members.join(peaks(ccf(s)), "a_id", "left").withColumn("indexing", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def leadlag_summary(p: DataFrame, by: Sequence[str] = ("pop", "indexing"), min_n: int = 5) -> DataFrame:
    """Responder share, median response and leading lags, loop and median |ccf|."""
    by = list(by)
    p = materialize(p.withColumns({"_a": F.when(F.col("responder"), F.col("post_lag")), "_d": F.when(~F.col("responder"), F.abs("pre_lag")),
                                   "_c": F.abs("post_ccf")}))
    t = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("responder").alias("n_responders"),
                           F.count_if(~F.col("responder")).alias("n_leaders")).where(F.col("n") >= min_n)
    for c, name in (("_a", "tau_a"), ("_d", "tau_d"), ("_c", "median_abs_ccf")):
        q = exact_quantiles(p, c, {name: 0.5}, by)
        least = 1 if c == "_c" else 5
        t = t.join(q.select(*by, F.when(F.col("n") >= least, F.col(name)).alias(name)), by, "left")
    return t.withColumns({"responder_share": F.col("n_responders") / F.col("n"), "loop": F.col("tau_a") + F.col("tau_d")})


def shift_peaks(series: DataFrame, members: DataFrame, reps: int = 999, seed=42) -> DataFrame:
    """One row per agent with the peaks of its replicates as arrays: friction rotated by U[15, n-15], peaks recomputed.
    ``lag`` is a responder's lag, or a leader's as a negative number.

    One transform per agent gives the peaks at all offsets, so a replicate is a lookup and their number
    hardly matters; Spark spreads the agents."""
    n = F.col("n")
    a = _arrays(series).where(n >= 2 * SHIFT_MIN).join(members.select("a_id", "pop", "density"), "a_id")
    offsets = F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda rep: draw(seed, n - 2 * SHIFT_MIN + 1, F.col("a_id"), rep) + SHIFT_MIN)
    a = a.select("a_id", "pop", "density", "days", offsets.alias("offsets"))

    def rotate(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, rows) for whole in batches for at in range(0, len(whole), rows)):
            held, lags, values = [], [], []
            for k, (r, f) in enumerate(_grids(b.column("days"), 0.0)):
                r, f = standardized(r), standardized(f)
                if r is None or f is None:
                    continue
                off = np.array(b.column("offsets")[k].values)
                post_lag, post, pre_lag, pre = (x[off] for x in rotation_peaks(r, f, LAG_MAX))
                held.append(k)
                lags.append(np.where(post > pre, post_lag, pre_lag).astype(np.int8))
                values.append(post)
            if held:
                bounds = pa.array(np.arange(len(held) + 1) * reps, pa.int32())
                yield pa.RecordBatch.from_arrays([*b.select(["a_id", "pop", "density"]).take(pa.array(held)).columns,
                                                  *[pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (lags, values)]],
                                                 ["a_id", "pop", "density", "lag", "abs_ccf"])
    kind = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    return a.mapInArrow(rotate, f"a_id {kind['a_id']}, pop {kind['pop']}, density double, lag array<tinyint>, abs_ccf array<double>")


def shift_null(series: DataFrame, members: DataFrame, reps: int = 999, seed=42) -> DataFrame:
    """``shift_peaks`` with one row per agent and replicate."""
    d = shift_peaks(series, members, reps, seed).select("a_id", "pop", "density", F.posexplode(F.arrays_zip("lag", "abs_ccf")).alias("_k", "_x"))
    lag = F.col("_x.lag").cast("long")
    return d.select("a_id", "pop", "density", (F.col("_k") + 1).alias("rep"), (lag > 0).alias("responder"), F.when(lag > 0, lag).alias("resp_lag"),
                    F.when(lag < 0, -lag).alias("lead_lag"), F.col("_x.abs_ccf").alias("abs_ccf"))


def _matrices(batches: Iterator[pa.RecordBatch], by: int, columns: Sequence[str], rows: int = 256) -> Iterator[tuple]:
    """(group, batch of the group's agents, their arrays of ``columns`` as matrices), a bounded number of agents at a time."""
    for b in (whole.slice(at, rows) for whole in batches for at in range(0, len(whole), rows)):
        owners: dict[tuple, list[int]] = {}
        for k, group in enumerate(zip(*(c.to_pylist() for c in b.columns[:by]))):
            owners.setdefault(group, []).append(k)
        for group, own in owners.items():
            part = b.take(pa.array(own))
            yield group, part, *[part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) for c in columns]


def null_counts(null: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rep, lag, _k, _n): agents of every replicate by lag (``_k`` NULL), and by range of |ccf| (``lag`` NULL). A task counts
    in matrices, so no replicate of an agent becomes a row. ``null`` has the ranges' bounds as ``_b``."""
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[np.ndarray]] = {}
        for group, part, lag, value in _matrices(batches, len(by), ("lag", "abs_ccf")):
            bounds = np.asarray(part.column("_b")[0].values)
            at = np.arange(lag.shape[1])
            for k, (x, width) in enumerate(((lag.astype(np.int64) + LAG_MAX, 2 * LAG_MAX + 1), (np.searchsorted(bounds, value, "left"), len(bounds) + 1))):
                n = np.bincount((at * width + x).ravel(), minlength=len(at) * width).reshape(len(at), width)
                held = counts.setdefault(group, [0, 0])
                held[k] = held[k] + n
        for group, tables in counts.items():
            for k, n in enumerate(tables):
                rep, x = np.nonzero(n)
                none = pa.nulls(len(rep), pa.int32())
                x, many = pa.array(x - (0 if k else LAG_MAX), pa.int32()), n[n > 0]
                yield pa.RecordBatch.from_arrays([*[pa.array([g] * len(rep)) for g in group], pa.array(rep + 1, pa.int32()), none if k else x, x if k else none, pa.array(many, pa.int64())],
                                                 [*by, "rep", "lag", "_k", "_n"])
    kinds = ", ".join(f"`{c}` {null.schema[c].dataType.simpleString()}" for c in by)
    d = null.select(*by, "lag", "abs_ccf", "_b").mapInArrow(run, f"{kinds}, rep int, lag int, _k int, _n long")
    return d.groupBy(*by, "rep", "lag", "_k").agg(F.sum("_n").alias("_n"))


def null_replicates(null: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rep): responder share and medians of the replicate's lags and |ccf|, from ``shift_peaks``. Medians of |ccf| are exact: the
    counts by range tell which range holds a replicate's middle, and only that range's values become rows."""
    by = list(by)
    keys = [*by, "rep"]
    probs = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    # Replicates are alike, so the first one's quantiles cut all of them into ranges of about one size.
    bounds = materialize(null.groupBy(*by).agg(F.array_distinct(F.percentile_approx(F.get("abs_ccf", F.lit(0)), probs, F.lit(1000))).alias("_b")), "bounds")
    null = null.join(F.broadcast(bounds), by)
    counts = materialize(null_counts(null, by), "counts")
    lag = F.col("lag")
    t = counts.where("lag is not null").groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(lag > 0, F.col("_n"))), F.lit(0)) / F.sum("_n")).alias("share"), F.sum("_n").alias("n_h"),
        *[F.percentile(F.when(x > 0, x), F.lit(0.5), F.col("_n")).alias(f"m_{c}") for c, x in (("resp_lag", lag), ("lead_lag", -lag))])
    place = materialize(middle_ranges(counts.where("_k is not null").select(*keys, "_k", "_n"), keys), "place")
    # Per group, the first and the last range of each replicate's middle, by replicate.
    ends = place.groupBy(*keys).agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rep", "lo", "hi"))).alias("_e"))
    ends = ends.select(*by, F.col("_e.lo").alias("_lo"), F.col("_e.hi").alias("_hi"))
    near = null.join(F.broadcast(ends), by).select(*by, "abs_ccf", "_b", "_lo", "_hi")

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, part, value in _matrices(batches, len(by), ("abs_ccf",)):
            b, lo, hi = (np.asarray(part.column(c)[0].values) for c in ("_b", "_lo", "_hi"))
            k = np.searchsorted(b, value, "left")
            agent, rep = np.nonzero((k >= lo) & (k <= hi))
            yield pa.RecordBatch.from_arrays([*[pa.array([g] * len(rep)) for g in group], pa.array(rep + 1, pa.int32()), pa.array(k[agent, rep], pa.int32()), pa.array(value[agent, rep])],
                                             [*keys, "_k", "_v"])
    kinds = ", ".join(f"`{c}` {null.schema[c].dataType.simpleString()}" for c in by)
    v = near.mapInArrow(middle, f"{kinds}, rep int, _k int, _v double").groupBy(*keys, "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    m = range_medians(v.join(F.broadcast(place), [*keys, "_k"]), keys)
    return t.join(m.select(*keys, F.col("median").alias("m_abs_ccf")), keys, "left")


def null_summary(null: DataFrame, p: DataFrame, by: Sequence[str] = ("pop",)) -> DataFrame:
    """Observed against null (``shift_peaks``, stored): share on the null-eligible agents, lags, coupling strength."""
    by = list(by)
    reps = materialize(null_replicates(null, by))
    eligible = null.select(*by, "a_id").distinct()
    obs = leadlag_summary(p, by).select(*by, "n", F.col("responder_share").alias("share_all"), "tau_a", "tau_d", F.col("median_abs_ccf").alias("ccf_obs"))
    held = p.join(eligible, [*by, "a_id"], "left_semi").groupBy(*by).agg(
        F.avg(F.coalesce(F.col("responder"), F.lit(False)).cast("double")).alias("share_obs"), F.count(F.lit(1)).alias("n_null_eligible"))
    o = obs.join(held, by)
    d = reps.join(F.broadcast(o), by)
    def p_value(stat, observed, upper):
        hit = (F.col(stat) >= F.col(observed)) if upper else (F.col(stat) <= F.col(observed))
        return F.when(F.max(observed).isNotNull() & (F.count(stat) > 0), (F.count_if(hit) + 1) / (F.count(stat) + 1))
    def q(c, x):
        return F.percentile(c, F.lit(x))
    return d.groupBy(*by).agg(
        F.max("n").alias("n_all"), F.max("n_null_eligible").alias("n_null_eligible"), F.max("share_all").alias("share_all"),
        F.max("share_obs").alias("share_obs"), F.avg("share").alias("share_null_mean"), F.max("share").alias("share_null_max"),
        p_value("share", "share_obs", True).alias("p_share"), F.max("tau_a").alias("tau_a"), q("m_resp_lag", 0.5).alias("tau_a_null_median"),
        q("m_resp_lag", 0.025).alias("tau_a_null_lo"), q("m_resp_lag", 0.975).alias("tau_a_null_hi"), p_value("m_resp_lag", "tau_a", False).alias("p_tau_a"),
        F.max("tau_d").alias("tau_d"), q("m_lead_lag", 0.5).alias("tau_d_null_median"), p_value("m_lead_lag", "tau_d", False).alias("p_tau_d"),
        F.max("ccf_obs").alias("ccf_obs"), F.avg("m_abs_ccf").alias("ccf_null_mean"), F.max("m_abs_ccf").alias("ccf_null_max"),
        p_value("m_abs_ccf", "ccf_obs", True).alias("p_ccf"))


def with_bands(df: DataFrame) -> DataFrame:
    """Each agent belongs to its density band and to ALL."""
    d = F.col("density")
    band = F.when(d >= DENSE, "dense").when(d >= MID, "mid").otherwise("sparse")
    return df.withColumn("band", F.explode(F.array(band, F.lit("ALL"))))


def lag_censoring(p: DataFrame, group: str = "pop", lag_max: int = LAG_MAX) -> DataFrame:
    """Responders at the search boundary, naive and product-limit medians."""
    r = materialize(p.where("responder").select(group, F.col("post_lag").alias("lag")))
    t = r.groupBy(group).agg(F.count(F.lit(1)).alias("n_responders"), F.count_if(F.col("lag") >= lag_max).alias("n_boundary"))
    naive = exact_quantiles(r, "lag", {"median_naive": 0.5}, [group]).drop("n")
    km = I.km_median(I.kaplan_meier(r, group, lag_max=lag_max), group).select(group, F.col("median").alias("median_km"))
    return (t.withColumn("boundary_share_pct", 100 * F.col("n_boundary") / F.col("n_responders"))
            .join(naive, group, "left").join(km, group, "left"))


def recompute_match(stored: DataFrame, again: DataFrame, tolerance: float = TINY) -> DataFrame:
    """Share of agents whose recomputed peak and flag equal the stored ones."""
    j = stored.select("a_id", F.col("post_ccf").alias("x"), F.col("responder").alias("p")).join(
        again.select("a_id", F.col("post_ccf").alias("y"), F.col("responder").alias("q")), "a_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("x") - F.col("y")) < tolerance).cast("double")).alias("ccf_match"),
                 F.avg((F.col("p") == F.col("q")).cast("double")).alias("responder_match"))


def ranked_curves(p: DataFrame, curves: DataFrame, group: str = "pop") -> DataFrame:
    """Curves of all responders with ``rank``, their place in the group by |post ccf|. Places are numbered over
    ranges of the sorted values, so no task holds a whole group; the largest few are a filter on the rank."""
    v = p.where("responder").select("a_id", group, F.round(F.abs("post_ccf"), 9).alias("_v"))
    order = ranked_values(v, "_v", [group]).select(group, "_v", (F.col("n_total") - F.col("n_before") - F.col("n")).alias("_ahead"))
    w = Window.partitionBy(group, "_v").orderBy("a_id")             # ties of one value
    top = v.join(order, [group, "_v"]).withColumn("rank", (F.col("_ahead") + F.row_number().over(w)).cast("int")).select("a_id", group, "rank")
    return curves.join(top, "a_id")


def tau_distribution(p: DataFrame, by: Sequence[str] = ("pop", "indexing")) -> DataFrame:
    """Density of the responders' lag."""
    c = p.where("responder").groupBy(*by, "post_lag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return c.withColumn("density", safe_div(F.col("n"), F.sum("n").over(w)))
