"""Cases beside the main path: null trees, clashing column names, letters and numbers, many languages."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from rebuff.llm import chat, language, shards


def test_null_conversations_are_one_tree(spark):
    rows = [(None, 1, None, 1, "user", "a", 1.0), (None, 2, 1, 2, "assistant", "b</s>", 1.0), (5, 1, None, 1, "user", None, None), (None, None, None, 1, "user", "lost", 1.0)]
    nodes = spark.createDataFrame([(*r, "k", 0) for r in rows], "tree long, node long, parent long, place long, role string, text string, score double, formatted string, leaf int")
    got = {r.tree: r for r in chat.format_trees(nodes).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert set(got) == {None, 5}
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "a"), ("assistant", "b</s>")]
    assert [(t.role, t.text) for t in got[5].turns] == [("user", "")]


def test_a_very_long_conversation(spark):
    n = 1500
    nodes = spark.createDataFrame([(1, k, k - 1 if k else None, k, "user" if k % 2 == 0 else "assistant", f"t{k}", 0.0) for k in range(n)],
                                  "tree long, node long, parent long, place long, role string, text string, score double")
    r = chat.format_trees(nodes).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    assert r.n_turns == n and r.loss == "".join(f"t{k}" for k in range(1, n, 2))


def test_shards_keep_columns_of_any_name(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(1, 400), f"g{k % 90}", rng.random(), k * 7, f"n{k}", -k, 9) for k in range(300)] + [(300, 5_000_000, "big", 0.5, 1, "n", 0, 9)]
    names = "doc_id long, size long, group string, x double, _n long, _row string, _size long, shard int"
    out = shards.kd_shards(spark.createDataFrame(rows, names), ["x"], n_shards=4)
    assert out.columns == ["doc_id", "size", "group", "x", "_n", "_row", "_size", "shard", "slot"]
    got = out.collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(r[:7] for r in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_of_equal_metadata(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(10).alias("size"), F.col("id").cast("string").alias("group"), F.lit(1.0).alias("x"))
    sizes = [r["count"] for r in shards.kd_shards(rows, ["x"], n_shards=4).groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2


def test_numbers_are_no_letters(spark):
    train = [(k, t, l) for k in range(200) for t, l in (("the cat and the dog of an old house", "en"), ("der hund und die katze im alten haus", "de"))]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    tried = spark.createDataFrame([(1, "½ ² ① 12 _"), (1, "½ ² ① 12 _"), (2, None), (3, "the old ½ dog"), (4, "die alte katze " * 5000), (None, "und der hund")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in language.predict(tried, language.fit(docs)).collect())
    assert got == [("1", "und", False), ("1", "und", False), ("2", "und", False), ("3", "en", True), ("4", "de", True), ("None", "de", True)]
    assert language.predict(tried.limit(0), language.fit(docs)).count() == 0


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"w{l} x{l}", f"l{l:02d}") for l in range(8) for k in range(30 + l)], "doc_id long, text string, lang string")
    langs, weights, transition = language.fit(docs, max_languages=3)
    assert langs == ["l05", "l06", "l07"] and weights.shape[1] == 3 and transition.shape == (3, 3)
