"""Request log to daily panel: rollups, rates, calendars and feature series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.functions.expressions import row_mean, safe_div
from rebuff.session import materialize

ROBOTS_URL = 64
MAX_ID = 2_147_483_647
#: Extension buckets of the feature series.
HTML_EXT = ("html", "htm")
FEATURES = ["p404", "p200", "robots", "img", "html", "js", "php", "folder",
            "ip_ent", "dom_ent", "ctry_ent", "url_ent", "husource"]
SERIES_COLUMNS = ["day", "hits", *FEATURES]


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _channels(robots_url: int) -> list[Column]:
    s = F.col("h_status")
    return [F.count(F.lit(1)).alias("hits"), _count(s == 200).alias("c200"), _count(s == 404).alias("c404"),
            _count(s.isin(401, 403)).alias("cblock"), _count(s == 429).alias("c429"),
            _count(F.col("h_u_id") == robots_url).alias("robots")]


def _keys(log: DataFrame) -> DataFrame:
    return log.withColumn("a_id", F.col("h_a_id")).withColumn("date", F.to_date("h_ts"))


def daily_rollup(log: DataFrame, robots_url: int = ROBOTS_URL) -> DataFrame:
    """One row per (agent, day). Partial aggregation bounds what a hot agent shuffles to one row
    per day and map task."""
    return _keys(log).groupBy("a_id", "date").agg(*_channels(robots_url))


def daily_rollup_spread(log: DataFrame, approx: bool = False, robots_url: int = ROBOTS_URL) -> DataFrame:
    """Rollup plus distinct ip / domain / country / url. ``approx`` trades the exact Expand-based
    distinct counts for one mergeable sketch per channel, in columns named ``approx_n_...``."""
    count, prefix = (F.approx_count_distinct, "approx_") if approx else (F.count_distinct, "")
    spread = [count(F.col(c)).alias(prefix + n) for c, n in
              (("h_i_id", "n_ip"), ("h_d_id", "n_dom"), ("h_ccode", "n_ctry"), ("h_u_id", "n_url"))]
    return _keys(log).groupBy("a_id", "date").agg(*_channels(robots_url), *spread)


def daily_rollup_window(log: DataFrame, spans: DataFrame, robots_url: int = ROBOTS_URL) -> DataFrame:
    """Rollup of [lo, hi) per agent; ``spans`` is (a_id, lo, hi).

    The overall date range, one row that the driver fetches first, is a literal filter on the log's own time column,
    so it is pushed into the scan and prunes row groups and date partitions; each agent's own span is applied to
    the aggregated rows, so a hot agent's raw rows are never shuffled.
    """
    lo, hi = spans.agg(F.min("lo"), F.max("hi")).first()
    kind = log.schema["h_ts"].dataType.simpleString()
    inside = (F.col("h_ts") >= F.lit(lo).cast(kind)) & (F.col("h_ts") < F.lit(hi).cast(kind)) if lo is not None and hi is not None else F.lit(False)
    near = _keys(log.where(inside))
    daily = near.groupBy("a_id", "date").agg(*_channels(robots_url))
    return daily.join(spans, "a_id").where("date >= lo and date < hi").drop("lo", "hi")


def rotation_rollup(log: DataFrame, robots_url: int = ROBOTS_URL) -> DataFrame:
    """hits, c404 and robots only; channels that were not measured are NULL, never 0."""
    d = _keys(log).groupBy("a_id", "date").agg(
        F.count(F.lit(1)).alias("hits"), _count(F.col("h_status") == 404).alias("c404"),
        _count(F.col("h_u_id") == robots_url).alias("robots"))
    missing = {c: F.lit(None).cast("long") for c in ("c200", "cblock", "c429", "n_ip", "n_dom", "n_ctry", "n_url")}
    return d.withColumns(missing).withColumn("rotation_minimal", F.lit(True))


def derived_rates(panel: DataFrame) -> DataFrame:
    """Rates over max(hits, 1); spread columns follow when the distinct counts are there."""
    h = F.greatest(F.col("hits"), F.lit(1))
    out = panel.withColumns({"p200": F.col("c200") / h, "p404": F.col("c404") / h, "p_block": F.col("cblock") / h,
                             "p_429": F.col("c429") / h, "robots_rate": F.col("robots") / h,
                             "resistance": F.greatest(1 - F.col("c200") / h, F.lit(0.0))})
    if "n_ip" in panel.columns:
        out = out.withColumns({"spread_ip": F.col("n_ip"), "spread_dom": F.col("n_dom"), "spread_ctry": F.col("n_ctry"),
                               "evasion_index": row_mean("n_ip", "n_dom", "n_ctry")})
    return out


def day_index(panel: DataFrame) -> DataFrame:
    """Days since the agent's first observation."""
    return panel.withColumn("day_index", F.datediff("date", F.min("date").over(Window.partitionBy("a_id"))))


def drop_downtime(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Remove collection-downtime dates; the list has at most one row per calendar day."""
    return panel.join(F.broadcast(days.select(F.col("e_day").alias("date"))), "date", "left_anti")


def id_guard(df: DataFrame, column: str = "a_id") -> DataFrame:
    """Flag ids beyond the 32-bit limit; such ids carry no requests."""
    return df.withColumn("over_limit", F.col(column) > MAX_ID)


def p404(coordinate: str) -> Column:
    """404 share under one of three denominators; NULL when the denominator is empty."""
    if coordinate == "baseline":
        return F.col("p404")
    if coordinate == "nonblocked":
        return safe_div(F.col("c404"), F.col("hits") - F.col("cblock") - F.col("c429"))
    return safe_div(F.col("c404"), F.col("c404") + F.col("c200"))


def distinct_ratios(log: DataFrame) -> DataFrame:
    """Distinct count over hits per channel; a NULL ip or domain counts as one value."""
    return (_keys(log).groupBy("a_id", "date").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct(F.coalesce("h_i_id", F.lit(-1))).alias("n_ip"),
        F.count_distinct(F.coalesce("h_d_id", F.lit(-1))).alias("n_dom"), F.count_distinct("h_ccode").alias("n_ctry"),
        F.count_distinct("h_u_id").alias("n_url"))
        .select("a_id", "date", *[(F.col(n) / F.col("hits")).alias(c) for n, c in
                                  (("n_ip", "ip_ent"), ("n_dom", "dom_ent"), ("n_ctry", "ctry_ent"), ("n_url", "url_ent"))]))


def extension_counts(log: DataFrame, url: DataFrame) -> DataFrame:
    """Hits per extension bucket per (agent, day), and the number of distinct URLs.

    Requests collapse to (agent, day, url) before the join, so a URL that draws a third of the
    traffic meets the dimension once per agent-day; AQE splits what is left of it.
    """
    per_url = _keys(log).groupBy("a_id", "date", F.col("h_u_id").alias("u_id")).agg(F.count(F.lit(1)).alias("_c"))
    x = F.lower(F.coalesce(F.col("u_extension"), F.lit("(null)")))
    def total(cond):
        return F.sum(F.when(F.col("_known") & cond, F.col("_c")).otherwise(0))
    dim = url.select("u_id", "u_extension", F.lit(True).alias("_known"))
    return (per_url.join(dim, "u_id", "left").groupBy("a_id", "date").agg(
        F.sum("_c").alias("hits"), total(x.isin(*HTML_EXT)).alias("html"), total(x == "php").alias("php"),
        total(x == "(null)").alias("folder"), F.count(F.lit(1)).alias("n_url")))


def extension_shares(log: DataFrame, url: DataFrame) -> DataFrame:
    c = extension_counts(log, url)
    return c.select("a_id", "date", *[(F.col(x) / F.col("hits")).alias(x) for x in ("html", "php", "folder")])


def country_share(log: DataFrame, code: str = "HU") -> DataFrame:
    """Share of hits from one country; a request without a country is not from it."""
    hit = F.coalesce((F.col("h_ccode") == code).cast("int"), F.lit(0))
    return _keys(log).groupBy("a_id", "date").agg(F.avg(hit).alias("husource"))


def densify_calendar(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Every day between an agent's first and last date; absent days count 0."""
    days = (panel.groupBy("a_id").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
            .select("a_id", F.explode(F.sequence("_lo", "_hi")).alias("date")))
    return (days.join(panel.select("a_id", "date", *columns), ["a_id", "date"], "left")
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns}))


def panel_zero_days(panel: DataFrame) -> DataFrame:
    """Calendar dates on which no agent has a hit."""
    span = panel.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    return (span.select(F.explode(F.sequence("_lo", "_hi")).alias("date"))
            .join(panel.select("date").distinct(), "date", "left_anti"))


def feature_series(log: DataFrame, url: DataFrame, robots_url: int = ROBOTS_URL) -> DataFrame:
    """The 15-column series on each agent's own calendar, plus the block channels."""
    base = _keys(log).groupBy("a_id", "date").agg(
        *_channels(robots_url), _count(F.col("h_ccode") == "HU").alias("hu"),
        F.count_distinct(F.coalesce("h_i_id", F.lit(-1))).alias("n_ip"),
        F.count_distinct(F.coalesce("h_d_id", F.lit(-1))).alias("n_dom"), F.count_distinct("h_ccode").alias("n_ctry"))
    ext = extension_counts(log, url).drop("hits")
    counts = materialize(base.join(ext, ["a_id", "date"]), "counts")      # feeds calendar, zero days and values
    names = ["hits", "c200", "c404", "cblock", "c429", "robots", "hu", "n_ip", "n_dom", "n_ctry", "n_url", "html", "php", "folder"]
    full = densify_calendar(counts, names).join(F.broadcast(panel_zero_days(counts)), "date", "left_anti")
    def share(c):
        return F.when(F.col("hits") > 0, F.col(c) / F.col("hits")).otherwise(F.lit(0.0))
    w = Window.partitionBy("a_id").orderBy("date")
    return full.select(
        "a_id", "date", (F.row_number().over(w) - 1).cast("long").alias("day"), "hits",
        share("c404").alias("p404"), share("c200").alias("p200"), share("robots").alias("robots"),
        F.lit(0.0).alias("img"), share("html").alias("html"), F.lit(0.0).alias("js"), share("php").alias("php"),
        share("folder").alias("folder"), share("n_ip").alias("ip_ent"), share("n_dom").alias("dom_ent"),
        share("n_ctry").alias("ctry_ent"), share("n_url").alias("url_ent"), share("hu").alias("husource"),
        "cblock", "c429")


def derived_signals(series: DataFrame) -> DataFrame:
    """Signals of the file series: its evasion index averages three ratios."""
    return series.withColumns({
        "evasion_index": row_mean("ip_ent", "dom_ent", "ctry_ent"),
        "resistance": F.greatest(1 - F.col("p200"), F.lit(0.0)),
        "compliance": F.col("robots"), "request_diversity": F.col("url_ent")})


def column_parity(left: DataFrame, right: DataFrame, columns: list[str], tolerance: float = 2e-6) -> DataFrame:
    """Largest absolute difference per column of two series aligned on (a_id, day). Rows are compared as they are
    joined; only the one row of results is turned from wide to long."""
    keys = ["a_id", "day"]
    a = left.select(*keys, *[F.col(c).cast("double").alias(f"x_{c}") for c in columns])
    b = right.select(*keys, *[F.col(c).cast("double").alias(f"y_{c}") for c in columns])
    def pair(c):
        x, y = F.col(f"x_{c}"), F.col(f"y_{c}")
        return F.struct(F.lit(c).alias("feature"), F.max(F.abs(x - y)).alias("max_abs_diff"), F.count(F.when(x.isNull() | y.isNull(), 1)).alias("unmatched"))
    return (a.join(b, keys, "full").agg(F.array(*[pair(c) for c in columns]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        .withColumn("verdict", F.when((F.col("unmatched") == 0) & (F.col("max_abs_diff") <= tolerance), "EXACT").otherwise("DIFF")))


def activity_summary(series: DataFrame, by: list[str]) -> DataFrame:
    """Active days, first and last active day, life span."""
    return (series.where("hits > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_active"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        .withColumn("lifespan_days", F.col("last_day") - F.col("first_day") + 1))


def build_tally(series: DataFrame, declared: DataFrame, min_rows: int = 30) -> DataFrame:
    """ok / short / fail per declared agent: no series at all is a failure."""
    n = series.groupBy("a_id").agg(F.count(F.lit(1)).alias("_n"))
    status = (F.when(F.col("_n").isNull(), "fail").when(F.col("_n") < min_rows, "short").otherwise("ok"))
    return declared.join(n, "a_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_agents"))


def status_histogram(log: DataFrame, population: DataFrame) -> DataFrame:
    """Hits per status over a population (agents, not requests, are what the semi join ships)."""
    h = (log.groupBy(F.col("h_a_id").alias("a_id"), "h_status").agg(F.count(F.lit(1)).alias("n"))
         .join(population.select("a_id").distinct(), "a_id", "left_semi")
         .groupBy("h_status").agg(F.sum("n").alias("n")))
    s, n = F.col("h_status"), F.col("n")
    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    t = h.agg(F.sum("n").alias("hits"), total(s.isin(401, 403)).alias("blocks"), total(s == 429).alias("c429"),
              total(s == 403).alias("_403"), total(s == 401).alias("_401"))
    return h.crossJoin(F.broadcast(t)).select(
        "h_status", "n", "hits", "blocks", "c429",
        (100 * F.col("blocks") / F.greatest("hits", F.lit(1))).alias("block_share_pct"),
        (F.col("_403") / F.greatest("_401", F.lit(1))).alias("ratio_403_401"))


def agent_block_counts(log: DataFrame) -> DataFrame:
    s = F.col("h_status")
    return log.groupBy(F.col("h_a_id").alias("a_id")).agg(
        _count(s == 401).alias("c401"), _count(s == 403).alias("c403"), _count(s == 429).alias("c429"),
        F.count(F.lit(1)).alias("hits"))


def monthly_coevolution(panel: DataFrame, group: str) -> DataFrame:
    """Per group and month: agents, active days, hits and hit-weighted rates. (The producer of this
    table is not public; its definition follows from the published columns.)"""
    def rate(c):
        return F.sum(c) / F.sum("hits")
    return panel.groupBy(F.col(group).alias("grp"), F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count_distinct("a_id").alias("agent_months"), F.count(F.lit(1)).alias("active_days"), F.sum("hits").alias("hits"),
        rate("cblock").alias("block_rate"), rate("robots").alias("robots_rate"), rate("c200").alias("success_rate"))


def extraction_check(panel: DataFrame) -> DataFrame:
    """Validation report per agent."""
    return panel.groupBy("a_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("hits").alias("hits"), F.sum("cblock").alias("blocks"),
        F.sum("c429").alias("rate_limited"), F.sum("robots").alias("robots"), F.max("n_ip").alias("max_ip_per_day"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def agent_block_profile(log: DataFrame) -> DataFrame:
    """Agent-level view of blocking, robust to giants: median 403 share, share of agents with a
    403 majority, and the largest agent's share of all blocks."""
    from rebuff.functions.distributed import exact_quantiles
    c = agent_block_counts(log).withColumn("b", F.col("c401") + F.col("c403"))
    c = c.withColumn("share403", safe_div(F.col("c403"), F.col("b")))
    t = c.agg(F.count_if(F.col("b") > 0).alias("agents_with_blocks"),
              (100 * F.avg((F.col("share403") > 0.5).cast("double"))).alias("pct_403_majority"),
              (100 * F.max("b") / F.greatest(F.sum("b"), F.lit(1))).alias("largest_agent_share_pct"))
    med = exact_quantiles(c.where("b > 0"), "share403", {"median_403_share": 0.5}).drop("n")
    return t.crossJoin(F.broadcast(med))
