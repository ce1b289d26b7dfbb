"""Statistics and inference: resampling, trend and change-point tests, survival, ranks, dose, matching."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.functions.distributed import BUCKETS, average_ranks, exact_quantiles, range_bins
from rebuff.functions.expressions import Z95, safe_div, solve
from rebuff.functions.ranks import kendall_p, kendall_scores, tie_sums, u_p
from rebuff.functions.resample import REPLICATES, SEED, counters, interval, replicate_medians, replicate_sums, weights
from rebuff.session import materialize

LAG_MAX = 14
CALIPER = 0.2


# ---- clusters -------------------------------------------------------------------------------------
def cluster_mean_intervals(rows: DataFrame, cluster: str, value: str, by: Sequence[str], reps: int = REPLICATES) -> DataFrame:
    """Row-pooled mean with an interval from resampled clusters. Each cluster shrinks to (sum, count)
    first, so a cluster holding a third of the rows is one row in every replicate."""
    by = list(by)
    c = materialize(rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_m")))
    point = c.groupBy(*by).agg((F.sum("_s") / F.sum("_m")).alias("mean"), F.sum("_m").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"),
                               (F.max("_m") / F.sum("_m")).alias("largest_cluster_share"))
    draws = replicate_sums(c, cluster, by, ["_s", "_m"], reps).withColumn("stat", F.col("_s") / F.nullif("_m", F.lit(0.0)))
    return point.join(draws.groupBy(*by).agg(*interval()), by)


def dose_gap_bootstrap(ev: DataFrame, reps: int = REPLICATES) -> DataFrame:
    """Raw dose gap per arm with an agent-clustered interval; the median that splits heavy from light
    is recomputed in every replicate, as a weighted quantile over multiplicities."""
    ev = materialize(ev.select("a_id", "arm", "intensity", "d_o"))
    halves = replicate_medians(ev, "a_id", "intensity", ["arm"], reps, columns=["d_o"])[1]
    def side(heavy, c):
        return F.sum(F.when(F.col("above") == heavy, F.col(c)))
    h, l = (F.coalesce(side(x, "_n"), F.lit(0.0)) for x in (True, False))
    gap = side(True, "d_o") / F.nullif(h, F.lit(0.0)) - side(False, "d_o") / F.nullif(l, F.lit(0.0))
    stat = halves.groupBy("arm", "rep").agg(F.when((h >= 5) & (l >= 5), gap).alias("stat"))
    return dose_split(ev).select("arm", "n_events", "gap").join(stat.groupBy("arm").agg(*interval()), "arm")


# ---- trend and change point -----------------------------------------------------------------------
def mann_kendall(long: DataFrame, keys: Sequence[str], min_n: int = 8, alpha: float = 0.05) -> DataFrame:
    """Kendall's tau-b against time order with its p-value and, where p < ``alpha``, the direction.

    A series (one value per day at most) is one array; the series of an Arrow batch are merged together, so pairs
    are counted without being formed. Short series without ties get their exact p. Values that are not finite are left out."""
    keys = list(keys)
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = long.where(F.col("value").isNotNull()).select(*keys, F.struct(F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value")).alias("_v"))
    a = d.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list("_v").alias("_a"))

    def bounded(batches: Iterator[pa.RecordBatch], values: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        """Slices of whole series with about so many values, or a single longer one."""
        for b in batches:
            ends = np.cumsum(np.diff(b.column(len(keys)).offsets.to_numpy()))
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + values, "right")))
                yield b.slice(at, to - at)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            lists = b.column(len(keys))
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            at, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            order = np.lexsort((at, owner))
            order = order[np.isfinite(x[order])]
            x, owner = x[order], owner[order]
            n = np.bincount(owner, minlength=len(lists))
            bounds = np.concatenate(([0], np.cumsum(n)))
            score, (ties, spread) = kendall_scores(x, bounds), tie_sums(x, bounds)
            rows = []
            for k, size in enumerate(n.tolist()):
                part = x[bounds[k]:bounds[k + 1]]
                if size < min_n or np.allclose(part, part[0]):
                    rows.append((size, 0.0, 1.0, 0))
                    continue
                pairs, p = size * (size - 1) / 2, kendall_p(size, int(score[k]), ties[k], spread[k])
                rows.append((size, score[k] / np.sqrt(pairs * (pairs - ties[k] / 2)), p, int(np.sign(score[k])) if p < alpha else 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.int32()))]],
                                             [*keys, "n", "tau", "p_value", "direction"])
    schema = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in keys)
    return a.mapInArrow(run, f"{schema}, n long, tau double, p_value double, direction int")


def series_arrays(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series, ``_a`` its values in order: at most one per day, so no row outgrows the calendar."""
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = long.where(F.col("value").isNotNull()).select(*keys, F.struct(F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value")).alias("_v"))
    return d.repartition(parts, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_v")).select(*keys, F.col("_v.value").alias("_a"))


def pettitt(long: DataFrame, keys: Sequence[str], min_n: int = 10, alpha: float = 0.05) -> DataFrame:
    """Rank-based single change point: first maximum of |U_t|, p = 2 exp(-6 K^2 / (n^3 + n^2)). A series is one array."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                x = np.asarray(b.column(len(keys))[k].values)
                n = len(x)
                if n < min_n or np.abs(x - x[0]).max() <= 1e-8 + 1e-5 * abs(x[0]):
                    rows.append((n, -1, None, 1.0, False))
                    continue
                _, rank, copies = np.unique(x, return_inverse=True, return_counts=True)
                ranks = (np.cumsum(copies) - copies + (copies + 1) / 2)[rank]
                u = np.abs(2 * np.cumsum(ranks) - np.arange(1, n + 1) * (n + 1))
                at = int(np.argmax(u))
                p = min(1.0, 2 * float(np.exp(-6 * u[at] * u[at] / (float(n) ** 3 + float(n) ** 2))))
                rows.append((n, at, u[at], p, p < alpha))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))]],
                                             [*keys, "_n", "_location", "_k", "_p", "_significant"])
    schema = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in keys)
    d = series_arrays(long, keys).mapInArrow(run, f"{schema}, _n long, _location long, _k double, _p double, _significant boolean")
    return d.select(*keys, F.col("_n").alias("n"), F.col("_location").alias("location"), F.col("_k").alias("k"), F.col("_p").alias("p_value"), F.col("_significant").alias("significant"))


def changepoint_effect(long: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|mean after - mean before| and the location as a fraction of the series."""
    keys = list(keys)
    d = series_arrays(long, keys).join(points.select(*keys, "location", "significant"), keys).withColumn("n", F.size("_a").cast("long"))
    def mean(x):
        return F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / F.size(x)
    at = F.col("location").cast("int")
    before, after = F.slice("_a", F.lit(1), at), F.slice("_a", at + 1, F.size("_a") - at)
    return d.select(*keys, "location", "significant", F.when(F.col("location") > 0, F.abs(mean(after) - mean(before))).alias("cp_effect"),
                    F.when(F.col("location") >= 0, F.col("location") / F.col("n")).alias("cp_frac"))


def _per_series(arrays: DataFrame, keys: list[str], one: Callable[[np.ndarray], tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """(keys, columns): ``one`` of each series of ``series_arrays``. Keys may have the columns' names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            rows = [one(flat[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(columns.values())]],
                                             [*keys, *[f"_{c}" for c in columns]])
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    schema = ", ".join([*[f"`{k}` {arrays.schema[k].dataType.simpleString()}" for k in keys], *[f"`_{c}` {kinds[t]}" for c, t in columns.items()]])
    d = arrays.mapInArrow(run, schema)
    return d.select(*keys, *[F.col(f"_{c}").alias(c) for c in columns])


def _flat(x: np.ndarray) -> bool:
    return bool(np.abs(x - x[0]).max() <= 1e-8 + 1e-5 * abs(x[0]))


def autocorr_time(long: DataFrame, keys: Sequence[str], min_n: int = 8, lag_max: int = 100) -> DataFrame:
    """First lag whose autocorrelation falls below 1/e, else the largest lag tried, then ``censored``; NULL when flat.
    An agent's series (one value per day) is one array; the lags are dot products on it."""
    return autocorr_time_of(series_arrays(long, list(keys)), list(keys), min_n, lag_max)


def autocorr_time_of(arrays: DataFrame, keys: list[str], min_n: int = 8, lag_max: int = 100) -> DataFrame:
    def one(x: np.ndarray) -> tuple:
        n = len(x)
        if n < min_n or _flat(x):
            return n, None, False
        x = x - x.mean()
        total = float(x @ x)
        if total <= 0:
            return n, None, False
        top = min(n - 1, lag_max)
        below = next((k for k in range(1, top + 1) if float(x[:-k] @ x[k:]) / total < np.e ** -1), None)
        return n, float(top if below is None else below), below is None
    return _per_series(arrays, keys, one, {"n": pa.int64(), "adaptation_time": pa.float64(), "censored": pa.bool_()})


def periodicity(long: DataFrame, keys: Sequence[str], min_n: int = 30) -> DataFrame:
    """Spectral peak share and dominant period of the linearly detrended series. One FFT per agent
    series (at most one value per day), in Arrow batches."""
    return periodicity_of(series_arrays(long, list(keys)), list(keys), min_n)


def periodicity_of(arrays: DataFrame, keys: list[str], min_n: int = 30) -> DataFrame:
    def one(x: np.ndarray) -> tuple:
        n = len(x)
        if n >= min_n and not _flat(x):
            day = np.arange(n) - (n - 1) / 2
            x = x - x.mean()
            x = x - day * (float(day @ x) / float(day @ day))
            power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
            if len(power) >= 2 and power.sum() > 0:
                k = int(np.argmax(power))
                return float(power[k] / power.sum()), n / (k + 1)
        return 0.0, None
    return _per_series(arrays, keys, one, {"oscillation": pa.float64(), "osc_period": pa.float64()})


# ---- survival -------------------------------------------------------------------------------------
def kaplan_meier(lags: DataFrame, group: str, lag: str = "lag", lag_max: int = LAG_MAX) -> DataFrame:
    """Product-limit curve per group; a lag at the search boundary is censored. After the grouped
    count a group is at most ``lag_max`` rows."""
    c = lags.where(F.col(lag).isNotNull()).groupBy(group, F.col(lag).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("d"))
    w = Window.partitionBy(group).orderBy("t")
    d = c.withColumn("n_risk", F.sum("d").over(w.rowsBetween(0, Window.unboundedFollowing))).where(F.col("t") < lag_max)
    terms = F.collect_list(F.struct("d", "n_risk")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_h", terms)
    d = d.withColumn("s", F.aggregate("_h", F.lit(1.0), lambda a, e: a * (1 - e["d"] / e["n_risk"])))
    gw = F.aggregate("_h", F.lit(0.0), lambda a, e: F.when(e["n_risk"] > e["d"], a + e["d"] / (e["n_risk"] * (e["n_risk"] - e["d"]))))
    d = d.withColumn("_g", gw)
    s, var = F.col("s"), F.col("s") * F.col("s") * F.col("_g")
    inside = (s > 0) & (s < 1) & F.col("_g").isNotNull()
    se = F.sqrt(var) / (F.abs(s * F.log(s)) + 1e-300)
    half = Z95 * F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(0.0)))
    return d.select(group, "t", "n_risk", "d", "s", var.alias("var_greenwood"),
                    F.when(inside, F.pow(s, F.exp(Z95 * se))).otherwise(F.greatest(s - half, F.lit(0.0))).alias("lo"),
                    F.when(inside, F.pow(s, F.exp(-Z95 * se))).otherwise(F.least(s + half, F.lit(1.0))).alias("hi"))


def km_median(km: DataFrame, group: str) -> DataFrame:
    """First t with S <= 0.5, and where the band crosses 0.5; NULL when it never does."""
    def first(cond):
        return F.min(F.when(cond, F.col("t")))
    return km.groupBy(group).agg(first(F.col("s") <= 0.5).alias("median"), first(F.col("lo") <= 0.5).alias("ci_lo"),
                                 first(F.col("hi") < 0.5).alias("ci_hi"))


# ---- ranks and distributions ----------------------------------------------------------------------
def rank_correlation(units: DataFrame, key: str, x: str, y: str, reps: int = REPLICATES) -> DataFrame:
    """Pearson r, Spearman rho and its interval from resampled units, re-ranked in every replicate."""
    u = materialize(units.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).alias("x"), F.col(y).alias("y")))

    def ranks(c):
        return average_ranks(u, c).select(c, F.col("avg_rank").alias(f"r{c}"))

    point = u.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson_r"))
    obs = u.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.corr("rx", "ry").alias("spearman_rho"))
    ci = replicate_spearman(u, key, reps).agg(*interval())
    return point.crossJoin(F.broadcast(obs)).crossJoin(F.broadcast(ci))


def replicate_spearman(units: DataFrame, key: str, reps: int = REPLICATES, seed=SEED, held: int = 4096, together: int = 256) -> DataFrame:
    """(rep, stat): Spearman's rho of the columns x and y in every replicate, copies of a unit sharing their ranks.

    Units are cut into ranges of x and of y of about ``held`` units. A range's rank before its first unit comes from the ranges'
    weights, so each range is ranked in a task of its own, ``together`` replicates at a time: first on x, then, with those
    ranks beside the units, on y. Ranks are kept as twice their value, a whole number."""
    u = units.select(*counters(key, (), seed), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), key)
    buckets = max(BUCKETS, -(-units.count() // held))
    for c in "xy":
        u = range_bins(u.withColumn("_v", F.col(c)), (), buckets).withColumnRenamed("_k", f"k{c}").drop("_v")
    u = materialize(u, "units")
    each = Window.partitionBy("rep")

    def before(k: str) -> DataFrame:
        """(k, block, rep, start, total): a range's place in the replicates that have weight in it."""
        t = replicate_sums(u.drop("_head", "_tail"), key, (), (), reps, seed, within=[k])
        return t.select(k, F.floor((F.col("rep") - 1) / together).alias("block"), "rep", (F.sum("_n").over(each.orderBy(k)) - F.col("_n")).alias("start"),
                        F.sum("_n").over(each).alias("total"))

    def ranked(own: pa.Table, starts: pa.Table, value: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The range's units in order, their weights, twice their ranks less those of the middle, and the replicates."""
        own = own.sort_by(value)
        first = own.column("block")[0].as_py() * together
        n = min(together, reps - first)
        w = weights(own.column("_head")[0].as_py(), own.column("_tail").to_pylist(), n, first)
        shift = np.zeros((2, n))
        shift[:, starts.column("rep").to_numpy() - 1 - first] = starts.column("start").to_numpy(), starts.column("total").to_numpy()
        v = own.column(value).to_numpy()
        lo, hi = np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right")
        upto = np.concatenate((np.zeros((1, n), np.int32), np.cumsum(w, axis=0, dtype=np.int32)))
        twice = upto[lo] + upto[hi] + (2 * shift[0] - shift[1]).astype(np.int64)
        return own, w, twice, first + 1 + np.arange(n)

    def on_x(own: pa.Table, starts: pa.Table) -> pa.Table:
        own, _w, twice, _reps = ranked(own, starts, "x")
        rows = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * twice.shape[1], pa.array(twice.astype(np.int32).ravel()))
        return own.select(["_head", "_tail", "y", "ky", "block"]).append_column("rx", rows)

    def on_y(own: pa.Table, starts: pa.Table) -> pa.Table:
        own, w, ry, at = ranked(own, starts, "y")
        rx = own.column("rx").combine_chunks().flatten().to_numpy().reshape(w.shape).astype(float)
        ry, w = ry.astype(float), w.astype(float)
        return pa.table({"rep": pa.array(at, pa.int32()), **{n: (w * a * b).sum(axis=0) for n, a, b in (("xy", rx, ry), ("xx", rx, rx), ("yy", ry, ry))}})
    none_y = pa.schema([("rep", pa.int32()), *[(c, pa.float64()) for c in ("xy", "xx", "yy")]]).empty_table()
    none_x = pa.schema([("_head", pa.string()), ("_tail", pa.string()), ("y", pa.float64()), ("ky", pa.int32()), ("block", pa.int64()), ("rx", pa.list_(pa.int32()))]).empty_table()
    d = u.select("_head", "_tail", "x", "y", "kx", "ky", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((reps - 1) // together).cast("long"))).alias("block"))
    d = d.groupBy("kx", "block").cogroup(before("kx").groupBy("kx", "block")).applyInArrow(
        lambda own, starts: on_x(own, starts) if len(own) and len(starts) else none_x, "_head string, _tail string, y double, ky int, block long, rx array<int>")
    d = d.groupBy("ky", "block").cogroup(before("ky").groupBy("ky", "block")).applyInArrow(
        lambda own, starts: on_y(own, starts) if len(own) and len(starts) else none_y, "rep int, xy double, xx double, yy double")
    s = d.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return s.select("rep", (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("stat"))


def auc_mann_whitney(units: DataFrame, value: str, positive: Column) -> DataFrame:
    """AUC, U-test and medians of two clusters. z is the tie-corrected normal score with continuity; the p-value is
    exact where one cluster is small and nothing ties."""
    u = materialize(units.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), positive.cast("int").alias("pos")))
    c = u.groupBy("x").agg(F.sum("pos").alias("p"), F.count(F.lit(1)).alias("c"))
    r = average_ranks(u, "x").join(c, "x")
    t = F.col("c").cast("double")
    a = r.agg(F.sum(F.col("avg_rank") * F.col("p")).alias("r1"), F.sum("p").alias("n_pos"), F.sum(F.col("c") - F.col("p")).alias("n_neg"),
              F.sum(t * t * t - t).alias("ties"))
    med = exact_quantiles(u, "x", {"m": 0.5}, ["pos"]).agg(
        F.max(F.when(F.col("pos") == 1, F.col("m"))).alias("median_pos"), F.max(F.when(F.col("pos") == 0, F.col("m"))).alias("median_neg"))
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n0
    uu = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(uu - n1 * n0 / 2) - 0.5) / sigma
    def p(u: pa.Array, n1: pa.Array, n0: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([u_p(*x) for x in zip(u.to_pylist(), n1.to_pylist(), n0.to_pylist(), ties.to_pylist())], pa.float64())
    p_value = F.arrow_udf(p, "double")(uu, "n_pos", "n_neg", "ties")        # of one row
    return a.crossJoin(F.broadcast(med)).select("n_pos", "n_neg", (uu / (n1 * n0)).alias("auc"), uu.alias("u"), z.alias("z"), p_value.alias("p_value"),
                                                (z > Z95).alias("significant"), "median_pos", "median_neg")


def wasserstein(df: DataFrame, value: str, pool: str, a: str, b: str) -> DataFrame:
    """First-order earth-mover distance: sum over consecutive distinct values of |F - G| times the gap.
    Values are counted first and cut into ranges; a range needs only its totals and the next range's
    first value from outside."""
    def count(name):
        return F.count_if(F.col(pool) == name)
    c = df.where(F.col(value).isNotNull() & F.col(pool).isin(a, b)).groupBy(F.col(value).cast("double").alias("_v")).agg(
        count(a).alias("na"), count(b).alias("nb"))
    d = range_bins(materialize(c, "values"))        # read three times
    t = d.groupBy("_k").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.min("_v").alias("_first"))
    every = Window.orderBy("_k")     # over the range totals only: at most BUCKETS rows
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select("_k", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("ob"),
                 F.sum("ta").over(whole).alias("ga"), F.sum("tb").over(whole).alias("gb"), F.lead("_first").over(every).alias("_next"))
    w = Window.partitionBy("_k").orderBy("_v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"ca": F.sum("na").over(run), "cb": F.sum("nb").over(run), "_nv": F.lead("_v").over(w)}).join(F.broadcast(t), "_k")
    gap = F.coalesce(F.col("_nv"), F.col("_next")) - F.col("_v")
    share = F.abs((F.col("oa") + F.col("ca")) / F.col("ga") - (F.col("ob") + F.col("cb")) / F.col("gb"))
    return d.agg(F.sum(share * gap).alias("distance"), F.max("ga").alias("n_a"), F.max("gb").alias("n_b"))


def density_histogram(df: DataFrame, value: str, bins: int = 40, threshold: float = 0.5) -> DataFrame:
    """Density over ``bins`` equal bins of [0, 1]; empty bins are kept; share at or above a threshold."""
    x = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    c = df.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(x * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(x >= threshold).alias("_above"))
    t = c.agg(F.sum("c").alias("n"), F.sum("_above").alias("_a"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(c, "bin", "left").crossJoin(F.broadcast(t)).select(
        "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), (F.coalesce("c", F.lit(0)) * bins / F.col("n")).alias("density"),
        (F.col("_a") / F.col("n")).alias("share_above"))


def null_percentile(null: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mid-rank percentile of ``obs`` among the replicates' ``stat``."""
    d = null.join(F.broadcast(observed), list(by))
    below, ties = F.avg((F.col("stat") < F.col("obs")).cast("double")), F.avg((F.col("stat") == F.col("obs")).cast("double"))
    return d.groupBy(*by, "obs").agg((100 * (below + 0.5 * ties)).alias("percentile"), F.count(F.lit(1)).alias("n_null"))


def permutation_p(null: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(k+1)/(n+1) for both tails."""
    d = null.where("stat is not null").join(F.broadcast(observed), list(by))
    n = F.count(F.lit(1)) + 1
    return d.groupBy(*by, "obs").agg(((F.count_if(F.col("stat") >= F.col("obs")) + 1) / n).alias("p_upper"),
                                     ((F.count_if(F.col("stat") <= F.col("obs")) + 1) / n).alias("p_lower"))


# ---- dose -----------------------------------------------------------------------------------------
def dose_events(obs: DataFrame, spacing: int = 16, intensity: str = "p_block") -> DataFrame:
    """Per event: blocking intensity, clean-baseline O and volume, change, retreat flag."""
    from rebuff.operators import events, windows as W
    d = events.flag_block_events(W.with_loghits(obs), {"kept": spacing})
    d = d.withColumns({"pre_o": W.frame_mean("o", -10, -6), "post_o": W.frame_mean("o", 1, 5),
                       "pre_logvol": W.frame_mean("loghits", -10, -6), "pre_logvol_adjacent": W.frame_mean("loghits", -5, -1),
                       "post_logvol": W.frame_mean("loghits", 1, 5)})
    d = d.where(F.col("kept") & events.eligible(10, 5) & F.col("pre_o").isNotNull() & F.col("post_o").isNotNull())
    return d.select("a_id", "arm", "i", F.col(intensity).cast("double").alias("intensity"), "pre_o", (F.col("post_o") - F.col("pre_o")).alias("d_o"),
                    "pre_logvol", "pre_logvol_adjacent", "post_logvol", (F.col("post_logvol") - F.col("pre_logvol")).alias("dvol"),
                    (F.expm1("post_logvol") < 0.5 * F.expm1("pre_logvol")).alias("retreat"))


def with_dose(ev: DataFrame) -> DataFrame:
    """heavy: intensity strictly above the median of the event's arm."""
    med = exact_quantiles(ev, "intensity", {"med": 0.5}, ["arm"]).drop("n")
    return ev.join(F.broadcast(med), "arm").withColumn("heavy", F.col("intensity") > F.col("med"))


def _sides(x: Column | str) -> tuple[Column, Column]:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.col("heavy"), x), F.when(~F.col("heavy"), x)


def dose_split(ev: DataFrame, min_side: int = 5) -> DataFrame:
    """Heavy and light means and gaps of dO, retreat share and volume change per arm."""
    d = with_dose(ev)
    aggs = [F.count(F.lit(1)).alias("n_events"), F.count_distinct("a_id").alias("n_agents"), F.count_if("heavy").alias("n_heavy")]
    cols = {"d_o": "dO"} | ({"dvol": "dvol"} if "dvol" in ev.columns else {})
    for c, n in cols.items():
        h, l = _sides(c)
        aggs += [F.avg(h).alias(f"{n}_heavy"), F.avg(l).alias(f"{n}_light")]
    if "retreat" in ev.columns:
        h, l = _sides(F.col("retreat").cast("double"))
        aggs += [F.avg(h).alias("retreat_heavy"), F.avg(l).alias("retreat_light")]
    t = d.groupBy("arm").agg(*aggs)
    enough = (F.col("n_heavy") >= min_side) & (F.col("n_events") - F.col("n_heavy") >= min_side)
    return t.withColumn("gap", F.when(enough, F.col("dO_heavy") - F.col("dO_light")))


def balance_smd(ev: DataFrame, covariates: Sequence[str] = ("pre_o", "pre_logvol")) -> DataFrame:
    """Standardised mean difference (sample variances) and levels of covariates by dose."""
    d = with_dose(ev).select("arm", "heavy", *covariates).unpivot(["arm", "heavy"], list(covariates), "covariate", "value")
    h, l = _sides("value")
    t = d.groupBy("arm", "covariate").agg(F.avg(h).alias("heavy_mean"), F.avg(l).alias("light_mean"),
                                          F.var_samp(h).alias("_vh"), F.var_samp(l).alias("_vl"))
    diff = F.col("heavy_mean") - F.col("light_mean")
    return t.select("arm", "covariate", "heavy_mean", "light_mean", diff.alias("diff"),
                    safe_div(diff, F.sqrt((F.col("_vh") + F.col("_vl")) / 2)).alias("smd"))


def adjusted_gap(ev: DataFrame, min_n: int = 10, volume: str = "pre_logvol") -> DataFrame:
    """Least-squares coefficient of heavy on dO and on retreat, given pre_o and volume: one pass of
    centred moment sums per arm, then a closed-form solve."""
    d = with_dose(ev).where(F.col(volume).isNotNull()).select(
        "arm", F.col("heavy").cast("double").alias("x1"), F.col("pre_o").alias("x2"), F.col(volume).alias("x3"),
        F.col("d_o").alias("y1"), F.col("retreat").cast("double").alias("y2"))
    xs, ys = ("x1", "x2", "x3"), ("y1", "y2")
    aggs = [F.covar_pop(a, b).alias(f"{a}{b}") for a in xs for b in (*xs, *ys) if b > a or b[0] == "y"] + [
        F.var_pop(a).alias(f"{a}{a}") for a in xs]
    t = d.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *aggs)
    m = [[F.col(f"{min(a, b)}{max(a, b)}") for b in xs] for a in xs]
    out = {f"adjusted_{n}": F.when(F.col("n") >= min_n, solve(m, [F.col(f"{a}{y}") for a in xs])[0])
           for y, n in zip(ys, ("d_o", "retreat"))}
    return t.select("arm", "n", *[c.alias(k) for k, c in out.items()])


def caliper_match(ev: DataFrame, outcome: str = "d_o", caliper: float = CALIPER, min_side: int = 10, levels: int = 6) -> DataFrame:
    """Heavy events matched to their nearest light event (with replacement) on two covariates scaled
    by the pooled within-dose sd, inside a caliper.

    Exact and without all pairs: light events are deduplicated by position and indexed on grids whose
    cells shrink fourfold per level. A heavy event searches at the finest level where its 3x3
    neighbourhood is occupied; its nearest neighbour then lies within 2*sqrt(2) cells, so a 7x7
    neighbourhood of that level is enough. Dense regions resolve at fine levels, empty ones stop at
    the caliper itself.
    """
    d = materialize(with_dose(ev).select("arm", "heavy", "a_id", "i", "pre_o", "pre_logvol", F.col(outcome).cast("double").alias("y"))
                    .where("pre_o is not null and pre_logvol is not null and y is not null"))
    def half_var(c):
        h, l = _sides(c)
        return F.sqrt((F.var_samp(h) + F.var_samp(l)) / 2) + 1e-12
    s = d.groupBy("arm").agg(F.avg("pre_o").alias("_mo"), F.avg("pre_logvol").alias("_mv"), half_var("pre_o").alias("_so"),
                             half_var("pre_logvol").alias("_sv"), F.count_if("heavy").alias("n_heavy"),
                             F.count_if(~F.col("heavy")).alias("n_light"))
    z = d.join(F.broadcast(s), "arm").select(
        "arm", "heavy", "y", "n_heavy", "n_light", (F.col("a_id") * 100000 + F.col("i")).alias("id"),
        ((F.col("pre_o") - F.col("_mo")) / F.col("_so")).alias("zx"), ((F.col("pre_logvol") - F.col("_mv")) / F.col("_sv")).alias("zy"))
    light = z.where("not heavy").groupBy("arm", "zx", "zy").agg(F.min("id").alias("l_id"), F.min_by("y", "id").alias("l_y"))
    heavy = z.where("heavy").select("arm", "id", F.col("zx").alias("hx"), F.col("zy").alias("hy"), F.col("y").alias("h_y"))
    size = F.lit(caliper) / F.pow(F.lit(4.0), F.col("lv"))
    def cells(df, x, y):
        return (df.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels))))
                .withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)}))
    def around(df, reach):
        step = F.sequence(-F.lit(reach), F.lit(reach)) if isinstance(reach, int) else F.sequence(-reach, reach)
        return (df.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
                .withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy"))
    grid = cells(light, "zx", "zy")
    cell = ["arm", "lv", "cx", "cy"]
    occupied = grid.select(*cell).distinct()
    near = around(cells(heavy, "hx", "hy"), 1)
    finest = near.join(occupied, cell, "left_semi").groupBy("arm", "id").agg(
        F.max("lv").alias("lv"), F.first("hx").alias("hx"), F.first("hy").alias("hy"), F.first("h_y").alias("h_y"))
    home = finest.withColumns({"cx": F.floor(F.col("hx") / size), "cy": F.floor(F.col("hy") / size)})
    dist = F.sqrt(F.pow(F.col("hx") - F.col("zx"), 2) + F.pow(F.col("hy") - F.col("zy"), 2))
    best = (around(home, F.when(F.col("lv") == 0, 1).otherwise(3)).join(grid, cell)
            .withColumn("dist", dist).where(F.col("dist") <= caliper)
            .groupBy("arm", "id").agg(F.min(F.struct("dist", "l_id", "l_y")).alias("m"), F.first("h_y").alias("h_y")))
    t = best.groupBy("arm").agg(F.count(F.lit(1)).alias("n_matched"), (F.avg("h_y") - F.avg("m.l_y")).alias("matched_gap"))
    ok = (F.col("n_heavy") >= min_side) & (F.col("n_light") >= min_side)
    return (s.select("arm", "n_heavy", "n_light").join(t, "arm", "left")
            .select("arm", "n_heavy", F.when(ok, F.coalesce("n_matched", F.lit(0))).otherwise(F.lit(0)).alias("n_matched"),
                    F.when(ok, F.col("matched_gap")).alias("matched_gap")))


def feature_correlation(active: DataFrame, features: Sequence[str], group: str = "label") -> DataFrame:
    """Per group and feature: correlation with log volume, 5-95 % support band, and the share of the
    feature's values that fall inside every group's band."""
    long = active.select(group, F.log1p("hits").alias("lv"), *features).unpivot([group, "lv"], list(features), "feature", "value")
    long = materialize(long)
    band = exact_quantiles(long, "value", {"p05": 0.05, "p95": 0.95}, [group, "feature"])
    common = band.groupBy("feature").agg(F.max("p05").alias("_lo"), F.min("p95").alias("_hi"))
    inside = F.avg(F.col("value").between(F.col("_lo"), F.col("_hi")).cast("double"))
    c = long.join(F.broadcast(common), "feature").groupBy(group, "feature").agg(F.corr("value", "lv").alias("corr_log_hits"), inside.alias("share_common"))
    return band.join(c, [group, "feature"])
