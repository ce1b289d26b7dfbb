"""Seeded resampling in one pass: a unit's weight in a replicate is a Poisson(1) count of its own.

Weights replace drawing with replacement: a unit's expected weight is one and replicates stay independent,
while the number of units in a replicate varies around the number given, which ratios of weighted sums
take out. No replicate needs to know how many units there are, so nothing is numbered or joined: rows
are weighted where they lie and partial sums per (group, replicate) are all that is shuffled.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rebuff.functions.distributed import exact_quantiles, middle_ranges, range_bins, range_medians
from rebuff.session import materialize

SEED = 42
REPLICATES = 2000
#: Replicates that share one md5, eight hexadecimal digits each.
PER_HASH = 4


def poisson_steps() -> list[str]:
    """Upper bounds of the counts 0, 1, ... as eight hexadecimal digits of the cumulative probability."""
    steps, total, k = [], 0.0, 0
    while (total := total + math.exp(-1) / math.factorial(k)) < 1 - 2 ** -32:
        steps.append(f"{int(total * 2 ** 32):08x}")
        k += 1
    return steps


def multiplicities(units: DataFrame, key: str, by: Sequence[str] = (), reps: int = REPLICATES, seed=SEED) -> DataFrame:
    """The units' columns plus (rep, _w): the weight of each unit in each replicate where it has one. Rows with
    the same group and key share their weights, so clusters stay together."""
    spread = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.sequence(F.lit(0), F.lit((reps - 1) // PER_HASH))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *by, "_b", key))
    digits = F.array(*[F.substring("_h", 8 * k + 1, 8) for k in range(PER_HASH)])
    w = F.lit(0)
    for step in poisson_steps():
        w = w + (F.col("_d") >= step).cast("int")
    # A small table of units becomes reps x units weights, so it is spread before it grows.
    return (units.repartition(spread, key).withColumn("_b", F.explode(blocks)).withColumn("_h", h)
            .select(*units.columns, "_b", F.posexplode(digits).alias("_k", "_d"))
            .select(*units.columns, (F.col("_b") * PER_HASH + F.col("_k") + 1).alias("rep"), w.alias("_w"))
            .where((F.col("_w") > 0) & (F.col("rep") <= reps)))


@lru_cache(maxsize=None)
def _md5_constants() -> tuple[list[int], list[int]]:
    shifts = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
    return shifts, [int(abs(math.sin(k + 1)) * 2 ** 32) for k in range(64)]


def md5_digits(blocks: np.ndarray) -> np.ndarray:
    """md5 of many padded one-block messages (n, 64) at once, as four groups of eight digits (n, 4)."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    shifts, added = _md5_constants()
    start = [np.uint32(x) for x in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x) for x in start)
    for k in range(64):
        if k < 16:
            f, g = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * k % 16
        f += a
        f += words[g]
        f += np.uint32(added[k])
        turned = f << np.uint32(shifts[k])
        turned |= f >> np.uint32(32 - shifts[k])
        turned += b
        a, d, c, b = d, c, b, turned
    return np.stack([x + y for x, y in zip((a, b, c, d), start)], axis=1).byteswap()


def weights(head: str, tails: Sequence[str], reps: int, first: int = 0) -> np.ndarray:
    """Weights (units, reps) of the units whose counters are ``head:block`` + tail: those of ``multiplicities``. ``first``
    is the number of replicates, whole hashes of them, before these."""
    blocks = (reps - 1) // PER_HASH + 1
    steps = np.array([int(x, 16) for x in poisson_steps()], np.uint32)
    digits = np.empty((len(tails), blocks, PER_HASH), np.uint32)
    starts = [f"{head}:{b}".encode() for b in range(first // PER_HASH, first // PER_HASH + blocks)]
    raw = [t.encode() for t in tails]
    for size in {len(t) for t in raw}:
        own = np.array([k for k, t in enumerate(raw) if len(t) == size])
        ends = np.frombuffer(b"".join(raw[k] for k in own), np.uint8).reshape(len(own), size)
        frame = np.zeros((blocks, 64), np.uint8)
        short = np.ones(blocks, bool)
        text = None
        for length in sorted({len(x) for x in starts}):
            at = np.array([b for b, x in enumerate(starts) if len(x) == length])
            n = length + size
            if n > 55:      # longer than one block
                for k in own:
                    digits[k, at] = np.frombuffer(b"".join(hashlib.md5(starts[b] + raw[k]).digest() for b in at), ">u4").reshape(-1, PER_HASH)
                short[at] = False
                continue
            rows = slice(at[0], at[-1] + 1)     # block numbers of one length are contiguous
            frame[rows, :length] = np.frombuffer(b"".join(starts[b] for b in at), np.uint8).reshape(len(at), length)
            frame[rows, n] = 0x80
            frame[rows, 56:58] = np.frombuffer((8 * n).to_bytes(2, "little"), np.uint8)
            if text is None:
                text = np.zeros((len(own), blocks, 64), np.uint8)
            text[:, rows] = frame[rows]
            text[:, rows, length:n] = ends[:, None]
        if text is not None:
            if short.all():
                digits[own] = md5_digits(text.reshape(-1, 64)).reshape(len(own), blocks, PER_HASH)
            else:
                digits[np.ix_(own, np.flatnonzero(short))] = md5_digits(text[:, short].reshape(-1, 64)).reshape(len(own), -1, PER_HASH)
    digits = digits.reshape(len(tails), -1)[:, :reps]
    out, more = np.zeros(digits.shape, np.uint8), np.empty(digits.shape, bool)
    top = digits.max(initial=0)
    for step in steps[steps <= top]:
        np.greater_equal(digits, step, out=more)
        out += more.view(np.uint8)
    return out


def counters(key: str, by: Sequence[str], seed=SEED) -> list[Column]:
    """``_head`` and ``_tail`` of a unit's counters: what stands before and after the block number."""
    return [F.concat_ws(":", F.lit(str(seed)), *by).alias("_head"), F.concat_ws(":", F.lit(""), key).alias("_tail")]


def replicate_sums(units: DataFrame, key: str, by: Sequence[str], columns: Sequence[str], reps: int = REPLICATES, seed=SEED,
                   within: Sequence[str] = ()) -> DataFrame:
    """(by, within, rep, _n, columns, n_columns): each replicate's weight, weighted sums, and the weight of the rows with a
    value (both NULL without one). ``within`` splits the groups further without entering the weights.

    Units are rows of Arrow batches, their weights a matrix that a product sums up, and a task hands on one row per
    (group, replicate): no weight becomes a row. Ranges of (group, key) leave few groups to a task."""
    groups, names = [*by, *within], [*columns, *[f"n_{c}" for c in columns]]
    spread = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = units.select(*groups, *counters(key, by, seed), *[F.col(c).cast("double").alias(c) for c in columns]).repartitionByRange(spread, *groups, "_tail").sortWithinPartitions(*groups, "_tail")

    def run(batches: Iterator[pa.RecordBatch], chunk: int = 16, held: int = 256) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, total in sums.items():
                some = np.flatnonzero(total[-1])
                stats = [pa.array(total[k, some], mask=total[len(columns) + k % len(columns), some] == 0) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*[pa.repeat(x, len(some)) for x in group], pa.array(some + 1, pa.int32()), pa.array(total[-1, some]), *stats], [*groups, "rep", "_n", *names])
            sums.clear()
        for batch in batches:
            heads = [list(x) for x in zip(*(c.to_pylist() for c in batch.columns[:len(groups) + 1]))]
            cuts = [k for k in range(len(heads)) if not k or heads[k] != heads[k - 1]] + [len(heads)]
            for lo, hi in zip(cuts, cuts[1:]):
                group = tuple(batch.column(k)[lo] for k in range(len(groups)))
                total = sums.setdefault(group, np.zeros((2 * len(columns) + 1, reps)))
                for at in range(lo, hi, chunk):
                    part = batch.slice(at, min(chunk, hi - at))
                    valid = [part.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns]
                    x = [part.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
                    total += np.stack([*x, *valid, np.ones(len(part))]).astype(float) @ weights(heads[lo][-1], part.column("_tail").to_pylist(), reps).astype(float)
            if len(sums) > held:
                yield from flush()
        yield from flush()
    kinds = ", ".join(f"`{c}` {u.schema[c].dataType.simpleString()}" for c in groups)
    stats = "".join(f", `{c}` double" for c in names)
    d = u.mapInArrow(run, f"{kinds + ', ' if kinds else ''}rep int, _n double{stats}")
    return d.groupBy(*groups, "rep").agg(*[F.sum(c).alias(c) for c in ("_n", *names)])


def interval(column: str = "stat", lo: str = "ci_lo", hi: str = "ci_hi") -> list[Column]:
    """Percentile interval over replicates; a group holds at most the replicate count."""
    return [F.percentile(column, F.lit(0.025)).alias(lo), F.percentile(column, F.lit(0.975)).alias(hi)]


def mean_intervals(units: DataFrame, key: str, value: str, by: Sequence[str] = (), reps: int = REPLICATES,
                   seed=SEED) -> DataFrame:
    """Mean and percentile interval of resampled means, over the units with a value."""
    by = list(by)
    u = materialize(units.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("_x")))
    point = u.groupBy(*by).agg(F.avg("_x").alias("mean"), F.count("_x").alias("n"))
    reps_ = replicate_sums(u, key, by, ["_x"], reps, seed)
    ci = reps_.withColumn("stat", F.col("_x") / F.col("n__x")).groupBy(*by).agg(*interval())
    return point.join(ci, by) if by else point.crossJoin(F.broadcast(ci))


def mean_difference(units: DataFrame, key: str, value: str, arm: str, a: str, b: str, by: Sequence[str] = (),
                    reps: int = REPLICATES, seed=SEED, min_n: int = 5) -> DataFrame:
    """Mean of arm ``a`` minus mean of arm ``b`` with a percentile interval; NULL below ``min_n``
    units in either arm."""
    by = list(by)
    u = materialize(units.where(F.col(value).isNotNull() & F.col(arm).isin(a, b))
                    .select(*by, key, F.col(arm).alias("_arm"), F.col(value).cast("double").alias("_x")))
    def pick(name, fn, col="_x"):
        return fn(F.when(F.col("_arm") == name, F.col(col)))
    point = u.groupBy(*by).agg(pick(a, F.avg).alias("mean_a"), pick(b, F.avg).alias("mean_b"),
                               pick(a, F.count).alias("n_a"), pick(b, F.count).alias("n_b"))
    draws = replicate_sums(u, key, [*by, "_arm"], ["_x"], reps, seed).withColumn("_m", F.col("_x") / F.col("n__x"))
    stat = draws.groupBy(*by, "rep").agg((pick(a, F.max, "_m") - pick(b, F.max, "_m")).alias("stat"))
    ci = stat.groupBy(*by).agg(*interval())
    out = point.join(ci, by, "left") if by else point.crossJoin(F.broadcast(ci))
    ok = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    return out.select(
        *by, "n_a", "n_b", F.when(ok, F.col("mean_a")).alias("mean_a"), F.when(ok, F.col("mean_b")).alias("mean_b"),
        F.when(ok, F.col("mean_a") - F.col("mean_b")).alias("did"),
        F.when(ok, F.col("ci_lo")).alias("ci_lo"), F.when(ok, F.col("ci_hi")).alias("ci_hi"),
        (ok & ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))).alias("sig"))


def replicate_medians(units: DataFrame, key: str, value: str, by: Sequence[str] = (), reps: int = REPLICATES, seed=SEED,
                      columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(by, rep, median) of ``value`` in every replicate, and (by, rep, above, _n, columns): the weight and the weighted
    sums of a replicate's units above its median, and of those at or below it.

    Units are cut into ranges of the value, and a replicate's weight in each range tells which one holds its middle. Only
    the units of such ranges, few since medians lie close together, are weighted value by value."""
    by, sums = list(by), ["_n", *columns]
    u = materialize(range_bins(units.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")), by), "ranges")
    totals = materialize(replicate_sums(u, key, by, columns, reps, seed, within=["_k"]), "totals")
    place = materialize(middle_ranges(totals, [*by, "rep"]), "place")
    near = u.join(F.broadcast(place.select(*by, "_k").distinct()), [*by, "_k"], "left_semi")
    v = materialize(replicate_sums(near, key, by, columns, reps, seed, within=["_k", "_v"]).join(F.broadcast(place), [*by, "_k", "rep"]), "middle")
    m = materialize(range_medians(v, [*by, "rep"]), "medians")
    # Ranges beside the lower middle's lie on one side as a whole.
    whole = totals.join(F.broadcast(m), [*by, "rep"]).where("_k <> _at").withColumn("above", F.col("_k") > F.col("_at"))
    part = v.join(F.broadcast(m), [*by, "rep"]).where("_k = _at").withColumn("above", F.col("_v") > F.col("median"))
    sides = [*by, "rep", "above"]
    halves = whole.select(*sides, *sums).unionByName(part.select(*sides, *sums)).groupBy(*sides).agg(*[F.sum(c).alias(c) for c in sums])
    return m.drop("_at"), halves


def median_intervals(units: DataFrame, key: str, value: str, by: Sequence[str] = (), reps: int = REPLICATES,
                     seed=SEED, min_n: int = 5) -> DataFrame:
    """Median and percentile interval of resampled medians; NULL below ``min_n`` units."""
    by = list(by)
    u = materialize(units.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("_x")))
    point = exact_quantiles(u, "_x", {"median": 0.5}, by)
    ci = replicate_medians(u, key, "_x", by, reps, seed)[0].groupBy(*by).agg(*interval("median"))
    out = point.join(ci, by) if by else point.crossJoin(F.broadcast(ci))
    ok = F.col("n") >= min_n
    return out.select(*by, "n", *[F.when(ok, F.col(c)).alias(c) for c in ("median", "ci_lo", "ci_hi")])
