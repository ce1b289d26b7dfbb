"""Labelled series are one file per agent and label in a bounded number of folders."""
from pyspark.sql import functions as F

from rebuff.operators.panel import FEATURES, SERIES_COLUMNS
from rebuff.session import scratch_path
from rebuff.sources import files


def test_files_per_agent_folders_bounded(spark):
    ids = spark.range(40).select(F.col("id").alias("a_id"), F.explode(F.array(F.lit("bot"), F.lit("human"))).alias("label"))
    days = ids.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("hits", F.col("a_id") * 10 + F.col("day"))
    series = days.select("a_id", "label", *[F.col(c).cast("long").alias(c) if c in ("day", "hits") else (F.col("hits") / 7).alias(c) for c in SERIES_COLUMNS])
    series = series.withColumn(FEATURES[0], F.when(F.col("a_id") > 0, F.col(FEATURES[0])))      # the first agent has a null
    path = scratch_path(spark, "labelled")
    assert files.write_labelled_series(series, path, folders=8) == 80
    held = files.read_labelled_series(spark, path)
    places = [r[0] for r in spark.read.option("recursiveFileLookup", "true").text(path).select("_metadata.file_path").distinct().collect()]
    assert len(places) == 80 and len({p.rsplit("/", 1)[0] for p in places}) <= 8
    want = sorted(map(tuple, series.where("a_id > 0").select(*held.columns).collect()))
    assert sorted(map(tuple, held.collect())) == want and len(want) == 390
    again = files.write_labelled_series(series, path, folders=8)
    assert again == 80 and files.read_labelled_series(spark, path).count() == 390
