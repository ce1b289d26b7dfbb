"""Small helpers shared by the operators: tables, intermediate results, word and hash expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuff.session import materialize, scratch_path, shared_folder

__all__ = ["ascii_lower", "broadcast_if_small", "materialize", "repack", "scratch_path", "shared_folder", "spread", "table", "text_key", "words"]

#: The six ASCII white-space characters, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; callers scale work by it, never below."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is the fast path and exact unless the text holds an upper- or
    title-case character beyond A-Z, which must stay as it is; such texts go through ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def text_key(text: Column) -> Column:
    """128 bits of a text's content as one string; null differs from every text."""
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null"))


def broadcast_if_small(written: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint behind a count: for a written table of narrow rows, of which at most ``max_rows``
    are sent to every executor. A larger table is left to the optimizer, which then shuffles both sides."""
    return F.broadcast(written) if written.count() <= max_rows else written


def repack(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by ``keys`` into the session's shuffle partitions."""
    return df.repartition(spread(df.sparkSession), *[F.col(k) for k in keys])
