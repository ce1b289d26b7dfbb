"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score.

Paths: jump tables to the 2^k-th ancestor are built by joining each with itself; then every leaf's path is
unfolded from the longest jump down, so a tree of depth d takes log2(d) joins twice and every (leaf,
ancestor) row is made exactly once.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. A control string inside a role or text gets a
backslash after its first character (one more if it has some), which reading takes away again; so markers
in the output are the template's own, and every text can be read back.

Defined cases: null role or text is empty; the rows with a null tree id are one tree of their own, with a null id; rows
without a node id have no place in a tree and are left out; only the columns named are read; a parent that is missing, or not earlier than its reply, makes
the reply a root, so there are no cycles; of rows with the same (tree, node) the least counts; equal scores
rank by leaf. One conversation is one output row, so its text must fit a row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuff.llm.common import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and of common templates; each starts with its only ``<`` or ``[``.
CONTROLS = r"(?=\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + CONTROLS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROLS, "$1$2")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) for (tree, node, parent, place): all ancestors of every leaf, itself at 0."""
    up = nodes.select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"), F.col("place").alias("p_place"))
    linked = nodes.join(up, (F.col("tree") == F.col("p_tree")) & (F.col("parent") == F.col("p_node")) & (F.col("place") > F.col("p_place"))) \
        .select("tree", "node", F.col("p_node").alias("up"))
    jumps = [materialize(linked, "jumps")]
    while not jumps[-1].isEmpty():
        a, b = jumps[-1], jumps[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"))
        jumps.append(materialize(a.join(b, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("far").alias("up")), "jumps"))
    parents = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    out = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist"))
    for k in reversed(range(len(jumps) - 1)):
        j = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        step = out.join(j, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left")
        here, there = F.struct(F.col("node"), F.col("dist")), F.struct(F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        out = step.select("tree", "leaf", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")).select("tree", "leaf", "x.*")
    return out


def format_trees(nodes: DataFrame, branches: int | None = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss_spans) of (tree, node, parent, place, role, text,
    score); node ids are unique in a tree, ``place`` orders replies after their parents. ``branches`` of the
    best-scored paths per tree, or all of them; ``loss_spans`` are code-point offsets of the ``learn`` texts."""
    rest = [c for c in ("parent", "place", "role", "text", "score")]
    # Inside, a tree's key is a struct: one that holds null equals another, so the rows without a tree id are one tree.
    n = nodes.where(F.col("node").isNotNull()).groupBy(F.struct(F.col("tree").alias("id")).alias("tree"), "node").agg(F.min(F.struct(*rest)).alias("x")).select("tree", "node", "x.*")
    n = materialize(n, "nodes")
    p = materialize(paths(n.select("tree", "node", "parent", "place")), "paths")
    scored = p.join(n.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    rows = p.join(ranked, ["tree", "leaf"]).join(n.select("tree", "node", "role", "text"), ["tree", "node"])
    g = rows.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("dist")).alias("at"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"),
        (F.col("role") == learn).alias("learn")))).alias("turns"))
    piece = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))
    start = len(TURN) + len(TEXT)

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + start + F.length(t["role"])
        stop = begin + F.length(t["text"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        return F.struct((stop + len(END)).alias("at"), F.when(t["learn"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return g.select(F.col("tree.id").alias("tree"), "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
                    F.array_join(F.transform("turns", piece), "").alias("formatted"),
                    F.aggregate("turns", zero, step, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    one = lambda x: F.transform(F.array(F.split(x, r"<\|text\|>|<\|end\|>", -1)), lambda s: F.struct(unescape(s[0]).alias("role"), unescape(s[1]).alias("text")))[0]
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
