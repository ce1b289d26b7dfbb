"""Readers and writers: request log, labelled series, panel store, id lists, results."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from rebuff.operators.panel import FEATURES, MAX_ID, SERIES_COLUMNS
from rebuff.session import materialize


def scan_requests(log: DataFrame, columns: list[str], lo: str | None = None, hi: str | None = None,
                  ids: DataFrame | None = None) -> DataFrame:
    """Only the needed columns and [lo, hi); both reach the Parquet scan. ``ids`` is a semi join."""
    out = log
    if lo is not None:
        out = out.where(F.col("h_ts") >= F.lit(lo).cast("timestamp_ntz"))
    if hi is not None:
        out = out.where(F.col("h_ts") < F.lit(hi).cast("timestamp_ntz"))
    out = out.select(*dict.fromkeys(["h_a_id", *columns]))
    return out if ids is None else out.join(ids.select(F.col("a_id").alias("h_a_id")), "h_a_id", "left_semi")


def scan_requests_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int = 200) -> DataFrame:
    """The same log from a relational store, read in parallel ranges of the agent id."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", "h_a_id").option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", partitions).load())


def agent_dimension(agent: DataFrame) -> DataFrame:
    """Agent attributes with the global first and last date beside them."""
    span = agent.agg(F.min("a_start").alias("date_floor"), F.max("a_last").alias("date_ceiling"))
    return agent.select("a_id", "a_name", "a_start", "a_last", "a_totalhit").crossJoin(F.broadcast(span))


def read_labelled_series(spark: SparkSession, path: str, pattern: str = r"([0-9]+)\.([a-z]+)$",
                         id_group: int = 1, label_group: int = 2) -> DataFrame:
    """Headerless tab files, one per agent: id and label come from the file's path, rows with a
    value that is not a number are dropped."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*")
           .csv(path, sep="\t", schema=", ".join(f"{c} string" for c in SERIES_COLUMNS)))
    where = F.col("_metadata.file_path")
    typed = raw.select(
        F.regexp_extract(where, pattern, id_group).cast("long").alias("a_id"),
        F.regexp_extract(where, pattern, label_group).alias("label"),
        F.expr("try_cast(try_cast(day as double) as bigint)").alias("day"),
        F.expr("try_cast(try_cast(hits as double) as bigint)").alias("hits"),
        *[F.expr(f"try_cast({c} as double)").alias(c) for c in FEATURES])
    return typed.na.drop()


def write_labelled_series(series: DataFrame, path: str, folders: int = 256) -> int:
    """One headerless tab file ``<id>.<label>`` per agent and label, dealt over a fixed number of folders; returns how many.

    Tasks write the files themselves, each under a hidden name first, so that nothing is left for the driver to move and
    listing costs a few folders, not one per agent. A file's folder, name and bytes depend on its rows only: an attempt
    that runs again replaces what an earlier one left."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SERIES_COLUMNS])
    rows = series.select(F.concat_ws(".", "a_id", "label").alias("name"), F.pmod(F.xxhash64("label", "a_id"), F.lit(folders)).alias("folder"), "day", line.alias("line"))
    spread = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, root = fs.FileSystem.from_uri(path)
        made: set[int] = set()
        written = 0

        def put(folder: int, name: str, lines: list[str]) -> None:
            if folder not in made:
                out.create_dir(f"{root}/{folder}", recursive=True)
                made.add(folder)
            hidden = f"{root}/{folder}/_{uuid.uuid4().hex}"
            with out.open_output_stream(hidden, compression=None) as stream:
                stream.write("".join(f"{x}\n" for x in lines).encode())
            out.move(hidden, f"{root}/{folder}/{name}")
        held: tuple[int, str, list[str]] | None = None
        for b in batches:
            for name, folder, row in zip(*(b.column(c).to_pylist() for c in ("name", "folder", "line"))):
                if held is None or held[1] != name:
                    if held is not None:
                        put(*held)
                        written += 1
                    held = (folder, name, [])
                held[2].append(row)
        if held is not None:
            put(*held)
            written += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})
    done = rows.repartition(spread, "name").sortWithinPartitions("name", "day").select("name", "folder", "line").mapInArrow(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Month folders for date pruning, clustered by agent inside; one shuffle on (month, agent)."""
    (panel.withColumn("month", F.date_format("date", "yyyy-MM")).repartition("month", "a_id")
     .sortWithinPartitions("month", "a_id", "date").write.mode(mode).partitionBy("month").parquet(path))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def save_panel_table(panel: DataFrame, table: str, buckets: int = 1024) -> None:
    """Bucketed by agent, so every later window or join by agent reads without a shuffle."""
    panel.write.mode("overwrite").bucketBy(buckets, "a_id").sortBy("a_id", "date").saveAsTable(table)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Validated, distinct, sorted ids of a one-column CSV with a header; an id beyond 32 bits is kept and flagged."""
    raw = spark.read.csv(path, header=True, schema="a_id string")
    value = F.expr("try_cast(a_id as decimal(38,6))")
    return (raw.select(value.alias("v")).where((F.col("v") > 0) & (F.col("v") == F.floor("v")) & (F.col("v") <= 2 ** 63 - 1))
            .select(F.col("v").cast("long").alias("a_id")).distinct().orderBy("a_id").withColumn("over_limit", F.col("a_id") > MAX_ID))


def write_result(result: DataFrame, path: str, fmt: str = "json", **parameters: object) -> None:
    """A result table with its parameters as columns, so that a value carries how it was computed."""
    for name, value in parameters.items():
        result = result.withColumn(name, F.lit(value))
    writer = result.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_feature_series(series: DataFrame, tab_path: str, parquet_path: str) -> None:
    """15-column tab files with a header per label, and Parquet with the block channels."""
    series.select("label", "a_id", *SERIES_COLUMNS).write.mode("overwrite").partitionBy("label").csv(tab_path, sep="\t", header=True)
    series.select("label", "a_id", *SERIES_COLUMNS, "cblock", "c429").write.mode("overwrite").partitionBy("label").parquet(parquet_path)


def incremental_extract(spark: SparkSession, log_panel: DataFrame, store: str) -> None:
    """Append only agents the store does not hold; running it again writes nothing."""
    held = spark.read.parquet(store).select("a_id").distinct()
    write_panel(log_panel.join(held, "a_id", "left_anti"), store, mode="append")


def require_extracted(declared: DataFrame, cached: DataFrame, fetched: DataFrame, excluded: DataFrame) -> DataFrame:
    """``extract_outcomes`` behind a gate: a declared id that has no series and is not in ``excluded`` (a_id, reason)
    is an error, so that no cohort shrinks silently. Names the ten lowest such ids."""
    held = cached.select("a_id").unionByName(fetched.select("a_id")).unionByName(excluded.where("reason is not null").select("a_id"))
    missing = declared.join(held, "a_id", "left_anti").select("a_id").distinct()
    lost = [r.a_id for r in missing.orderBy("a_id").limit(11).collect()]
    if lost:
        raise ValueError(f"declared but neither extracted nor excluded with a reason: {', '.join(map(str, lost[:10]))}{' and more' * (len(lost) > 10)}")
    return extract_outcomes(declared, cached, fetched)


def extract_outcomes(declared: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Outcome per declared id: over the limit, cached, fetched, or empty. ``require_extracted`` makes the last an error."""
    c = cached.select("a_id").distinct().withColumn("_c", F.lit(1))
    f = fetched.select("a_id").distinct().withColumn("_f", F.lit(1))
    outcome = (F.when(F.col("a_id") > MAX_ID, "over_max_id").when(F.col("_c").isNotNull(), "cached")
               .when(F.col("_f").isNotNull(), "fetched").otherwise("empty"))
    return (declared.join(c, "a_id", "left").join(f, "a_id", "left").groupBy(outcome.alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n_ids")))


def profile_log(log: DataFrame, robots_url: int) -> DataFrame:
    """Long profile (metric, item, value, at): row, agent and robots counts, first and last time, and every status
    and method with its rows. One pass: rows shrink to (agent, status, method) before anything moves."""
    one = materialize(log.groupBy(F.col("h_a_id").alias("a"), F.col("h_status").cast("string").alias("status"), F.col("h_mode").alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("h_u_id") == robots_url).alias("robots"), F.min("h_ts").alias("lo"), F.max("h_ts").alias("hi")), "profile")
    t = one.agg(F.sum("n").alias("rows"), F.sum("robots").alias("robots_hits"), F.count_distinct("a").alias("agents"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = t.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(v).alias("value"), F.col(w).alias("at") if w else F.lit(None).cast("timestamp").alias("at"))
                                         for m, v, w in (("rows", "rows", None), ("robots_hits", "robots_hits", None), ("agents", "agents", None),
                                                         ("first_time", "rows", "lo"), ("last_time", "rows", "hi"))])).alias("x")).select("x.*")
    total = total.select("metric", F.lit(None).cast("string").alias("item"), F.when(F.col("at").isNull(), F.col("value")).alias("value"), "at")
    for c in ("status", "method"):
        total = total.unionByName(one.groupBy(F.col(c).alias("item")).agg(F.sum("n").alias("value")).withColumns({"metric": F.lit(c), "at": F.lit(None).cast("timestamp")}))
    return total


class RegistryChanged(RuntimeError):
    """Another writer published a registry after this one was read."""


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The published pins (key, digest, n) and their version; nothing and 0 before the first."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return None, 0
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    version = max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)
    return (spark.read.schema("key string, digest string, n long").parquet(f"{path}/v{version}") if version else None), version


def publish_registry(spark: SparkSession, registry: DataFrame, path: str, seen: int) -> int:
    """Publishes ``registry`` as the version after ``seen``, the one that was read when it was planned; refused if any
    other has been published since.

    The rows are staged under a name of their own first. Then the version is claimed by a file that only one writer
    can create, and the staged folder is renamed. Readers see a version whole or not at all, and no writer replaces
    what another one published."""
    if read_registry(spark, path)[1] != seen:
        raise RegistryChanged(f"version {seen} of {path} is not the last any more")
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    registry.select("key", "digest", F.col("n").cast("long").alias("n")).write.parquet(staged)
    fs, at = _file_system(spark, path)
    try:
        fs.create(at(f"{path}/_claim-v{seen + 1}"), False).close()
    except Exception as e:
        raise RegistryChanged(f"version {seen + 1} of {path} is taken") from e
    if not fs.rename(at(staged), at(f"{path}/v{seen + 1}")):
        raise OSError(f"{staged} could not be renamed")
    return seen + 1
