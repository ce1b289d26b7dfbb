"""Streaming forms of the rollup and alerts. Sinks are files with a checkpoint in the shared folder."""
from __future__ import annotations

import datetime
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rebuff.operators import panel
from rebuff.session import scratch_path

#: Sessions are merged in a task before the shuffle; the session's own setting comes back once the stream has run.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run everything available through the stream to Parquet and read the result."""
    spark = stream.sparkSession
    path, check = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint")
    before = spark.conf.get(LOCAL_MERGE)
    spark.conf.set(LOCAL_MERGE, "true")
    try:
        (stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", check)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(LOCAL_MERGE, before)
    return spark.read.schema(stream.schema).parquet(path)


def daily_rollup(log: DataFrame, delay: str = "1 day", slide: str | None = None, robots_url: int = 64) -> DataFrame:
    """Tumbling (or sliding) one-day rollup; rows may come ``delay`` late. ``settled_rollup`` counts the later ones, which
    are dropped here, and adds the days that are still open."""
    s = F.col("h_status")
    day = F.window("h_ts", "1 day", slide) if slide else F.window("h_ts", "1 day")
    def n(cond):
        return F.count(F.when(cond, 1))
    return (log.withWatermark("h_ts", delay).groupBy(day, F.col("h_a_id").alias("a_id"))
            .agg(F.count(F.lit(1)).alias("hits"), n(s == 200).alias("c200"), n(s == 404).alias("c404"), n(s.isin(401, 403)).alias("cblock"),
                 n(s == 429).alias("c429"), n(F.col("h_u_id") == robots_url).alias("robots"))
            .select("a_id", F.to_date("window.start").alias("date"), "hits", "c200", "c404", "cblock", "c429", "robots"))


def rate_limit_alerts(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """One alert per agent and day with a rate-limited request: filter plus bounded deduplication."""
    d = log.where("h_status = 429").withWatermark("h_ts", delay).select("h_ts", F.col("h_a_id").alias("a_id"), F.to_date("h_ts").alias("date"))
    return d.dropDuplicatesWithinWatermark(["a_id", "date"]).select("a_id", "date")


def settled_rollup(emitted: DataFrame, log: DataFrame, robots_url: int = 64) -> DataFrame:
    """What the stream wrote, set against the whole log in batch: every (agent, day) with ``state`` and ``late``.

    ``closed`` days are the stream's own rows, and ``late`` counts the requests that came after their day was closed and
    that the stream therefore dropped. ``open`` days were not written yet, because the watermark has not passed them or
    because all of their requests came late; they carry the batch counts, which is the final flush. The sum of ``hits``
    and ``late`` is the log."""
    whole = panel.daily_rollup(log, robots_url)
    counts = [c for c in whole.columns if c not in ("a_id", "date")]
    both = whole.select("a_id", "date", F.struct(*counts).alias("_b")).join(emitted.select("a_id", "date", F.struct(*counts).alias("_s")), ["a_id", "date"], "left")
    closed = F.col("_s").isNotNull()
    return both.select("a_id", "date", *[F.when(closed, F.col(f"_s.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in counts],
                       F.when(closed, "closed").otherwise("open").alias("state"), F.when(closed, F.col("_b.hits") - F.col("_s.hits")).otherwise(F.lit(0)).alias("late"))


def spike_alerts(days: DataFrame, z: float = 1.5, min_days: int = 3, delay: str = "1 day", expiry_days: int = 400) -> DataFrame:
    """Days whose block count exceeds the agent's mean + z sd SO FAR (the batch rule sees the whole history; this is
    its causal variant). ``days`` is (a_id, date, cblock), one row per agent and day.

    A day is judged once the watermark, ``delay`` behind the newest day, has passed it, and an agent's days are judged
    in their order, however they are spread over batches. State is a running count, sum and sum of squares, which are
    whole numbers, so that a day on the threshold itself is judged alike everywhere, and the days that wait, at most ``delay``'s worth; an agent silent for ``expiry_days`` is forgotten."""
    day_ms = 86_400_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, waiting = state.get if state.exists else (0, 0, 0, "[]")
        held = json.loads(waiting)
        if not state.hasTimedOut:
            for rows in frames:
                held += [[int(d), int(x)] for d, x in zip(rows["day"], rows["cblock"])]
        mark = state.getCurrentWatermarkMs()
        out, left = [], []
        for d, x in sorted(held):
            if (d + 1) * day_ms > mark:
                left.append([d, x])
                continue
            mean = total / n if n else 0.0
            variance = squares / n - mean * mean if n else 0.0
            if n >= min_days and variance > 0 and x > mean + z * math.sqrt(variance):
                out.append((key[0], datetime.date(1970, 1, 1) + datetime.timedelta(d), x))
            n, total, squares = n + 1, total + x, squares + x * x
        if state.hasTimedOut and not held:
            state.remove()
        else:
            state.update((n, total, squares, json.dumps(left)))
            state.setTimeoutTimestamp(max((left[0][0] + 1) * day_ms if left else mark + expiry_days * day_ms, mark + 1))
        yield pd.DataFrame(out, columns=["a_id", "date", "cblock"])

    d = days.select("a_id", F.col("date").cast("timestamp").alias("at"), F.datediff("date", F.lit("1970-01-01")).cast("long").alias("day"), "cblock")
    return d.withWatermark("at", delay).groupBy("a_id").applyInPandasWithState(
        step, "a_id long, date date, cblock long", "n long, total long, squares long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def quiet_sessions(log: DataFrame, gap: str = "5 days", delay: str = "1 day") -> DataFrame:
    """Activity sessions closed by ``gap`` without a request. ``drain`` merges sessions inside a task before they
    move, so a hot agent sends a task's few sessions and not its requests."""
    return (log.withWatermark("h_ts", delay).groupBy(F.session_window("h_ts", gap), "a_id").agg(F.count(F.lit(1)).alias("n"))
            .select("a_id", F.to_date("session_window.start").alias("first_date"), F.to_date("session_window.end").alias("end_date"), "n"))
