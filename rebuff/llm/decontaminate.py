"""Benchmark decontamination with a broadcast set of normalised test n-grams, native expressions only.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased. Every window
of ``n`` item words (a shorter item is one window of its own length) is hashed; the training windows are
scanned against that set, and a hash match counts only if the words agree.

The benchmark's window table is written and counted first: up to ``BROADCAST_ROWS`` windows are broadcast,
more are joined by a shuffle of the training windows. In the first case training windows never move; only
verified hits are grouped.

Defined cases: null or empty texts have no words, no windows and no hits; an item without words matches
nothing; rows that repeat an id with another text are told apart by their text; an empty benchmark leaves
everything clean.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebuff.llm.common import ascii_lower, broadcast_if_small, materialize, text_key

WINDOW = 10
#: About 100 bytes a window: at most 50 MB are broadcast.
BROADCAST_ROWS = 500_000
#: Fixed value: what stands between words, after A-Z were lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class for text whose case was kept.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows(column: str, length: Column, size: Column) -> Column:
    """Positions at which a window of ``size`` words starts; none in shorter arrays."""
    return F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, n: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: size, hash, words joined by spaces, and the items that hold it."""
    b = benchmark.select(F.col(item).alias("item"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    b = b.withColumn("size", F.least(F.lit(n), F.size("w")))
    b = b.select("item", "size", "w", F.explode(windows("w", F.size("w"), F.col("size"))).alias("p"))
    b = b.withColumn("s", F.slice("w", F.col("p"), F.col("size")))
    return b.groupBy("size", F.xxhash64("s").alias("hash"), F.array_join("s", " ").alias("words")).agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (key, text): ``n_words``, ``positions`` (sorted hit word numbers, from 1), ``items``."""
    w = materialize(item_windows(benchmark, n), "windows")
    sizes = sorted(r["size"] for r in w.select("size").distinct().collect())  # at most n numbers
    d = docs.select(F.col(key).alias("k"), text_key(F.col(text)).alias("text_key"), tokens(F.col(text)).alias("w"))
    d = d.withColumn("n_words", F.size("w"))
    # Position 0 is one row per document that matches nothing and carries its word count.
    starts = [windows("w", F.col("n_words"), F.lit(s)) for s in sizes]
    scan = d.select("k", "text_key", "n_words", "w", F.explode(F.array(F.lit(0), *[F.lit(s) for s in sizes])).alias("size"))
    pick = F.array(F.lit(0))
    for s, at in zip(sizes, starts):
        pick = F.when(F.col("size") == s, at).otherwise(pick)
    scan = scan.select("k", "text_key", "n_words", "w", "size", F.explode(pick).alias("p"))
    scan = scan.withColumn("hash", F.when(F.col("p") > 0, F.xxhash64(F.slice("w", F.col("p"), F.col("size")))))
    told = w.select(F.col("size").alias("b_size"), F.col("hash").alias("b_hash"), "words", "items")
    sent = broadcast_if_small(told, BROADCAST_ROWS)
    own = F.array_join(F.slice("w", F.greatest(F.col("p"), F.lit(1)), F.col("size")), " ")
    if sent is told:        # rows move: each takes its own words along instead of the document's
        scan = scan.withColumn("own", own).drop("w")
        own = F.col("own")
    found = scan.join(sent, (F.col("hash") == F.col("b_hash")) & (F.col("size") == F.col("b_size")), "left")
    same = own == F.col("words")
    found = found.where((F.col("p") == 0) | F.col("words").isNotNull()).select(
        "k", "text_key", "n_words", F.when(same, F.struct("p", "size")).alias("hit"), F.when(same, F.col("items")).alias("items"))
    g = found.groupBy("k", "text_key").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("items").alias("items"))
    spans = F.flatten(F.transform("hits", lambda h: F.sequence(h["p"], h["p"] + h["size"] - 1)))
    return g.select(F.col("k").alias(key), "text_key", F.col("n_words").cast("long").alias("n_words"),
                    F.sort_array(F.array_distinct(spans)).alias("positions"), F.array_distinct(F.flatten("items")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "documents") -> DataFrame:
    """Documents without contamination: ``documents`` drops hit documents, ``spans`` cuts the hit words,
    with the gap in front of each, out of the text. All columns are kept; ``n_chars`` is not recomputed."""
    h = hits(docs, benchmark, n).where(F.size("positions") > 0).select(
        F.col("doc_id").alias("_h_id"), F.col("text_key").alias("_h_key"), F.col("positions").alias("_h_pos"))
    on = docs["doc_id"].eqNullSafe(h["_h_id"]) & (text_key(docs["text"]) == h["_h_key"])
    if mode == "documents":
        return docs.join(h, on, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    pieces = F.regexp_extract_all("text", F.lit(f"{RAW_GAP}*{RAW_GAP.replace('[', '[^')}+|{RAW_GAP}+$"), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("_h_pos"), i + 1)), "")
    joined = docs.join(h, on, "left")
    return joined.select(*[F.when(F.col("_h_pos").isNull(), docs["text"]).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])
