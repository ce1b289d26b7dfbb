"""The registered queries of the subpackage: thin, with production parameters, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rebuff.llm import chat, decontaminate, fill_middle, html_text, language, licenses, periodic, pieces, quality, shards, simhash, suffix_repeats, warc
from rebuff.llm.common import scratch_path, table, text_key, words

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = 8


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's rows are a chain: each turn answers the one before it."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = given.unionByName(own).withColumn("node", F.row_number().over(w).cast("long"))
    nodes = rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.col("node").alias("place"),
                        "role", "text", F.length("text").cast("double").alias("score"))
    f = chat.format_trees(nodes)
    f = f.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes. All dimensions follow from the text, so copies meet."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = d.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_key(F.col("text")).alias("group"),
                    F.log2(F.octet_length(text) + 1.0).alias("log_bytes"), (F.octet_length(text) / (F.length(text) + 1.0)).alias("bytes_per_char"),
                    ((F.size(F.split(text, "\n", -1))) / (F.length(text) + 1.0)).alias("lines_per_char"))
    out = shards.kd_shards(rows, ["log_bytes", "bytes_per_char", "lines_per_char"], n_shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark)).drop("text_key")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentation's size, score and id digest, the N best scores, and whether decoding gives the text back."""
    model = pieces.load(PIECE_MODEL)
    e = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text", F.md5(F.encode("text", "UTF-8")).alias("digest")), model, keep=("doc_id", "digest"))
    e = e.select("doc_id", "digest", "ids", "score", F.transform("n_best", lambda x: x["score"]).alias("n_best_scores"))
    d = pieces.decode(e, model)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_hash"), "n_best_scores",
                    F.md5(F.encode("decoded", "UTF-8")).eqNullSafe(F.col("digest")).alias("round_trip"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return h.select("doc_id", "n_words", F.size("positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), (F.size("positions") > 0).alias("contaminated"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("text_key")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suffix_repeats.spans(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = language.predict(d.withColumn("held_out", language.held_out(F.col("doc_id"))), language.fit(d), keep=("doc_id", "held_out"))
    return p.select("doc_id", "held_out", "lang_pred", "score")


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back from the archives."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text and the text without their repeats. A tenth of the texts, dealt by a checksum of the id, first get a periodic tail."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    d = d.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, cast(a + 1 as int), cast(p as int)), cast((n - a) div p + 1 as int))), 1, cast(n - a as int))")
    d = d.withColumn("text", F.when(F.expr("h % 10 = 0 and n > 0"), F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), tail), " ")).otherwise(F.col("text")))
    r = periodic.find_runs(d)
    best = F.array_max(F.transform("runs", lambda x: F.struct((x["length"] * 1.0 / x["period"]).alias("e"), (-x["start"]).alias("s"), (-x["period"]).alias("p"), x["length"].alias("l"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    r = r.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    start, length, period = -F.col("best.s"), F.col("best.l"), -F.col("best.p")
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                    F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"),
                    F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("fim.text"), F.col("fim.form"))
    return f.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(F.encode("fim.text", "UTF-8"), 256).alias("output_sha256"),
                    F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_formatting, "op2_kd_sharding": sharding, "op3_license_scan": license_scan, "op4_sentencepiece": sentencepiece,
    "op5_html_extraction": html_extraction, "op6_decontamination": decontamination, "op7_simhash": simhash_groups, "op8_quality_rules": quality_rules,
    "op9_suffix_dedup": suffix_dedup, "op10_language_id": language_id,
    "op11_warc": warc_archives, "op12_periodic_runs": periodic_runs, "op13_fill_in_middle": fill_in_middle,
}
