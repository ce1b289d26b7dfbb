"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rebuff")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; a cluster session
    must name one, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if "REBUFF_LOCAL_SCRATCH" not in os.environ:
        os.environ["REBUFF_LOCAL_SCRATCH"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.environ["REBUFF_LOCAL_SCRATCH"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, one per call."""
    return f"{shared_folder(spark).rstrip('/')}/rebuff/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where one result feeds several branches: the long plan behind it runs once, its real size
    is known to the optimizer, and a lost executor costs a re-read, not a re-run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
