"""Request-log views over the driver's star-schema tables.

``Views`` gives every operator an input of the shape it works on: a request log, its dimensions,
a long daily panel, labels, and external scores. All views are lazy plans over the Parquet files;
filters and column pruning reach the scans.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuff.operators import bridges, events, panel, populations, windows
from rebuff.session import materialize


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- request log and dimensions, from events ------------------------------------------------
    @cached_property
    def hits(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        e = self.table("events").withColumn("k", k)
        err = F.col("event_type") == "error"
        status = (F.when(err & (F.col("value") >= 150), 429).when(err & (F.col("event_id") % 3 == 0), 401)
                  .when(err, 403).when(F.col("event_type") == "signup", 404).otherwise(200))
        return e.select(
            F.col("event_id").alias("h_id"), F.col("user_id").alias("h_a_id"), F.col("ts").alias("h_ts"),
            F.col("k").alias("h_u_id"), status.alias("h_status"),
            F.when(F.col("event_id") % 29 != 0, (F.col("user_id") + F.col("k")) % 40).alias("h_i_id"),
            F.when(F.col("event_id") % 31 != 0, F.col("k") % 12).alias("h_d_id"),
            F.when(F.col("k") % 7 == 0, "HU").otherwise(F.concat(F.lit("C"), F.col("k") % 7)).alias("h_ccode"),
            F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("h_mode"))

    @cached_property
    def url(self) -> DataFrame:
        k = F.col("u_id")
        ext = (F.when(k % 16 == 0, "HTML").when(k % 4 == 0, "html").when(k % 4 == 1, "htm").when(k % 4 == 2, "php"))
        return (self.hits.select(F.col("h_u_id").alias("u_id")).distinct()
                .select("u_id", ext.alias("u_extension"), F.when(k % 5 == 3, 1).otherwise(0).alias("u_honeypot")))

    @cached_property
    def honeypot(self) -> DataFrame:
        decoys = self.url.where("u_honeypot = 1").select(F.col("u_id").alias("h_u_id"))
        n = F.count(F.lit(1))
        a = F.col("h_a_id")
        return (self.hits.join(decoys, "h_u_id", "left_semi").groupBy("h_a_id", "h_u_id").agg(n.alias("_n"))
                .select(a.alias("uh_a_id"), F.col("h_u_id").alias("uh_u_id"),
                        F.when(a % 11 == 0, None).when(a % 13 == 0, 0).otherwise(F.col("_n")).cast("long")
                        .alias("uh_total")))

    @cached_property
    def panel(self) -> DataFrame:
        return panel.daily_rollup(self.hits)

    @cached_property
    def agent(self) -> DataFrame:
        # The 5th / 95th percentile date is taken over the daily panel weighted by hits, so a
        # giant agent is at most one row per day when the percentile is computed.
        day = F.datediff("date", F.lit("1970-01-01"))
        def pct(p):
            return F.date_add(F.lit("1970-01-01").cast("date"),
                              F.floor(F.percentile(day, F.lit(p), F.col("hits"))).cast("int"))
        return self.panel.groupBy("a_id").agg(
            F.concat(F.lit("agent-"), F.max("a_id")).alias("a_name"),
            F.min("date").alias("a_start"), F.max("date").alias("a_last"), F.sum("hits").alias("a_totalhit"),
            pct(0.05).alias("a_start_5p"), pct(0.95).alias("a_last_5p"))

    @cached_property
    def labels(self) -> DataFrame:
        """One row per (agent, label); every human also carries a pothuman twin."""
        ids = self.panel.select("a_id").distinct()
        q = self.table("labels").select(F.col("doc_id").alias("a_id"), "quality", "toxic").join(ids, "a_id", "left_semi")
        role = F.when(F.col("toxic") == 1, "bot").when(F.col("quality") == 1, "human").otherwise("pothuman")
        return (q.select("a_id", F.explode(
            F.when(role == "human", F.array(F.lit("human"), F.lit("pothuman"))).otherwise(F.array(role))).alias("label")))

    @cached_property
    def whiteip(self) -> DataFrame:
        return self.hits.where(F.col("h_i_id").isin(5, 17)).select(F.col("h_i_id").alias("i_id")).distinct()

    @cached_property
    def emptydays(self) -> DataFrame:
        return (self.panel.where(F.col("date").isin("2024-01-13", "2024-01-22"))
                .select(F.col("date").alias("e_day")).distinct())

    # ---- long panel, from line items ------------------------------------------------------------
    @cached_property
    def spanel(self) -> DataFrame:
        return (self.table("lineitem").groupBy(F.col("l_suppkey").alias("a_id"), F.to_date("l_shipdate").alias("date"))
                .agg(*self._totals()))

    @staticmethod
    def _totals() -> list[Column]:
        """The long panel's counts of one supplier-day."""
        q = F.col("l_quantity").cast("long")
        def total(cond):
            return F.sum(F.when(cond, q).otherwise(0))
        flag = F.col("l_returnflag")
        return [F.sum(q).alias("hits"), total(~flag.isin("A", "R")).alias("c200"), total(flag == "A").alias("c404"),
                total(flag == "R").alias("cblock"),
                total((F.col("l_linenumber") == 1) & (F.col("l_quantity") == 50)).alias("c429"),
                total((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "F")).alias("robots")]

    def by_period(self, days: int = 28) -> Views:
        """The same views with the long panel rolled up to periods of so many days. A supplier's day holds one or two
        line items, so its rates are 0 or 1; a period's rates vary."""
        v = Views(self.spark, self.sf_dir)
        start = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.datediff("date", F.lit("1970-01-01")) / days) * days).cast("int"))
        v.spanel = self.spanel.groupBy("a_id", start.alias("date")).agg(*[F.sum(c).alias(c) for c in ("hits", "c200", "c404", "cblock", "c429", "robots")])
        return v

    @cached_property
    def sidx(self) -> DataFrame:
        """Long panel with rates, active index i (0-based), n, and the two arms / four groups.

        Stored once per query: frames, thresholds and events all read it, and none of them may send
        the scan back to the raw log."""
        return materialize(self._indexed(self.spanel), "panel")

    def _indexed(self, days: DataFrame) -> DataFrame:
        # Rates are derived behind the window's shuffle, which moves counts only.
        d = panel.derived_rates(windows.index_days(days)).withColumn("p404_bi", panel.p404("nonblocked"))
        return d.withColumn("arm", self.arm()).withColumn("pop", self.pop())

    @staticmethod
    def arm():
        return F.when(F.col("a_id") % 2 == 1, "abusive").otherwise("verified")

    @staticmethod
    def pop():
        r = F.col("a_id") % 4
        return (F.when(r == 1, "abusive").when(r == 0, "verified").when(r == 3, "declared").otherwise("pothuman"))

    @cached_property
    def panel_end(self) -> DataFrame:
        return self.spanel.agg(F.max("date").alias("panel_end"))

    @cached_property
    def sframe(self) -> DataFrame:
        return windows.reference_frame(self.sidx, F.col("arm") == "verified")

    @cached_property
    def sobs(self) -> DataFrame:
        return windows.observability(self.sidx, self.sframe)

    @cached_property
    def ip(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("i_name"), F.col("l_suppkey").alias("i_agent"),
            F.year("l_shipdate").alias("i_year"), F.month("l_shipdate").alias("i_month"),
            (F.col("l_partkey") % 10 == 0).cast("int").alias("i_proxy"))

    @cached_property
    def sdecoy(self) -> DataFrame:
        """Decoy visits on the long panel's ids: parts with key % 5 = 3."""
        return (self.table("lineitem").where(F.col("l_partkey") % 5 == 3)
                .groupBy(F.col("l_suppkey").alias("uh_a_id"), F.col("l_partkey").alias("uh_u_id"))
                .agg(F.count(F.lit(1)).alias("uh_total")))

    @cached_property
    def deaths(self) -> DataFrame:
        """Deaths of all agents."""
        return events.persistent_deaths(self.sidx)

    @cached_property
    def bot_deaths(self) -> DataFrame:
        """Deaths of the bot arm: the population whose members may come back under another identity."""
        return events.persistent_deaths(self.sidx.where("arm = 'abusive'"))

    @cached_property
    def lone_bot_deaths(self) -> DataFrame:
        """``bot_deaths`` for queries that need the long panel for nothing else: the arm's days and the columns that deaths
        are judged by are rolled up without storing the panel, and agents are dealt out by the number of line items."""
        days = self.spanel.repartition(bridges.tasks_for(self.spanel, self.table("lineitem").count()), "a_id")
        return events.persistent_deaths(self._indexed(days).where("arm = 'abusive'"))

    # ---- feature series -------------------------------------------------------------------------
    @cached_property
    def seq14(self) -> DataFrame:
        """The feature series, stored once per query for the same reason."""
        return materialize(panel.feature_series(self.hits, self.url), "series")

    @cached_property
    def series(self) -> DataFrame:
        """Feature series per (agent, label), with the derived signals."""
        return panel.derived_signals(self.seq14).join(self.labels, "a_id")

    @cached_property
    def active(self) -> DataFrame:
        """Active days of ``series`` with index i and n per (agent, label), agents of 20+ days."""
        return windows.index_days(self.series.where("hits > 0"), ["a_id", "label"], "day").where("n >= 20")

    @cached_property
    def sfeat(self) -> DataFrame:
        """Long feature series: rates and distinct ratios per supplier-day.

        Line items move once, by supplier and day: the copies that the distinct counts make of them stay in the task,
        and the counts of the panel come from the same rows, without a join."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        li = self.table("lineitem").select(F.col("l_suppkey").alias("a_id"), F.to_date("l_shipdate").alias("date"), "l_partkey", "l_linenumber",
                                           "l_returnflag", "l_linestatus", "l_quantity")
        d = li.repartition(parts, "a_id", "date").groupBy("a_id", "date").agg(
            *self._totals(), *[F.count_distinct(c).alias(n) for c, n in (("l_partkey", "_p"), ("l_linenumber", "_l"), ("l_returnflag", "_f"))])
        return (self._indexed(d).where("a_id is not null and date is not null")
                .select("a_id", "arm", "date", "i", "n", "hits", "p404", "p200", F.col("robots_rate").alias("robots"),
                        (F.col("_p") / F.col("hits")).alias("ip_ent"), (F.col("_l") / F.col("hits")).alias("dom_ent"),
                        (F.col("_f") / F.col("hits")).alias("ctry_ent"))
                .withColumn("evasion_index", (F.col("ip_ent") + F.col("dom_ent") + F.col("ctry_ent")) / 3))

    @cached_property
    def scores(self) -> DataFrame:
        """External per-day score in [0, 1] on the request log's agents."""
        mean = F.avg("value") / 500
        return (self.table("events").groupBy(F.col("user_id").alias("a_id"), F.to_date("ts").alias("date"))
                .agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("score")))

    @cached_property
    def sscores(self) -> DataFrame:
        """External per-day score on the long panel's agents."""
        return (self.table("lineitem").groupBy(F.col("l_suppkey").alias("a_id"), F.to_date("l_shipdate").alias("date"))
                .agg(F.avg(F.col("l_discount") * 10).alias("score")))

    @cached_property
    def roster(self) -> DataFrame:
        return populations.roster_v2(self.labels, populations.abusive_arm(self.honeypot, self.agent))
