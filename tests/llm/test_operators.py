"""The operators against brute force, with nulls, empty tables, ties, repeats and clashing column names."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from rebuff.llm import chat, decontaminate, html_text, language, licenses, near_copies, pieces, quality, shards, simhash, suffix_repeats
from rebuff.llm.queries import PIECE_MODEL, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, k string"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def frame(spark, rows):
    """Documents with two extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], COLUMNS)


EDGE = [(1, None), (2, ""), (3, "One two."), (4, "One two."), (4, "One two."), (5, "word " * 3000), (None, "lost id text")]


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op6_decontamination"])
def test_oracle(spark, name):
    status, info = compare(spark, connect(SF), name, SF)
    assert status == "OK", info


# quality ------------------------------------------------------------------------------------------

def brute_quality(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, documents):
    extra = [(-1, "a b c d e f g h " * 5 + "x y\nx y\n\nx y", "en"), (-2, None, None), (-3, "", "en")]
    rows = documents + extra
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        want = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_js_distance(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([([1, 3], [2, 2]), ([1, 0], [0, 1]), ([2, 2], [1, 1]), ([0, 0], [1, 1])], "p array<long>, q array<long>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b) if x)
    m = [0.375, 0.625]
    assert got[0] == pytest.approx(np.sqrt((kl([.25, .75], m) + kl([.5, .5], m)) / 2))
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(0) and got[3] is None


def test_quality_edges(spark):
    d = frame(spark, EDGE)
    assert quality.quality(d).count() == len(EDGE)
    assert quality.keep_good(d).columns == d.columns
    assert quality.quality(d.limit(0)).count() == 0


# decontamination ----------------------------------------------------------------------------------

def test_decontamination_modes(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, "...")], "item_id long, text string")
    docs = frame(spark, [(1, f"before {item.upper()} after"), (2, "a short, ITEM here"), (3, "clean text"), (4, "É short"), *EDGE])
    h = {(r.doc_id, r.n_words): (r.positions, sorted(r["items"])) for r in decontaminate.hits(docs, bench).collect()}
    assert h[1, 14] == (list(range(2, 14)), [1]) and h[2, 4] == ([2, 3], [2]) and h[3, 2] == ([], [])
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {1, 2, 3, 4, 5, None}
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs.where("n_chars < 200 and doc_id in (1, 2)"), bench, mode="spans").collect() if r.text}
    assert cut[1] == "before after" and cut[2] == "a here"
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.hits(docs.limit(0), bench).count() == 0


# simhash ------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, documents):
    rows = sorted([(i, t) for i, t, _ in documents[:150]] + [(10**6 + i, t) for i, t in EDGE[:3]])
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {rows[k][0]: (fps[k], rows[r][0]) for k, r in enumerate(brute_groups(fps))}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.groups(frame(spark, rows)).collect()}
    assert got == want
    assert simhash.groups(frame(spark, rows).limit(0)).count() == 0
    kept = simhash.keep_first(frame(spark, EDGE))
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, None} - {None} | ({None} & {r.doc_id for r in kept.collect()})


def test_bit_sliced_links():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) for b in base for _ in range(40)]
    run = np.repeat([1, 2], [170, 70])
    order = np.array(fps, np.uint64)
    links = simhash.spanning_links(order, run, 4)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        assert run[a] == run[b] and bin(fps[a] ^ fps[b]).count("1") <= 4
        root[find(a)] = find(b)
    for lo, hi in ((0, 170), (170, 240)):
        want = brute_groups(fps[lo:hi])
        for i in range(hi - lo):
            for j in range(i):
                assert (want[i] == want[j]) == (find(lo + i) == find(lo + j))


# suffix arrays ------------------------------------------------------------------------------------

def brute_spans(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], i)
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                hit[p:p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(int)))))
        out[i] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


def test_suffix_spans(spark, documents):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    planted = [(10**6 + k, passage[rng.randrange(120):rng.randrange(150, 300)] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(60)))) for k in range(25)]
    periodic = [(2 * 10**6 + k, "ab" * rng.randrange(20, 90)) for k in range(6)]
    rows = [(i, t) for i, t, _ in documents[:120]] + planted + periodic + [(3 * 10**6, None), (3 * 10**6 + 1, "")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_repeats.spans(frame(spark, rows)).collect()}
    assert got == brute_spans(rows)
    kept = suffix_repeats.remove_repeats(frame(spark, EDGE))
    assert kept.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ") and kept.count() == len(EDGE)
    assert suffix_repeats.spans(frame(spark, EDGE).limit(0)).count() == 0


def test_maximal_repeats():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(4)]
    got = {(d, tuple(sorted(o))) for d, o in suffix_repeats.repeat_groups(texts, 5)}
    want = set()
    for w in {t[i:j] for t in texts for i in range(40) for j in range(i + 5, 41)}:
        at = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(w, i)]
        left = {t[i - 1] if i else ("start", k) for k, i in at for t in [texts[k]]}
        right = {texts[k][i + len(w)] if i + len(w) < 40 else ("end", k) for k, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(w), tuple(sorted(at))))
    assert got == want


# pieces -------------------------------------------------------------------------------------------

TRICKY = ["", " ", "  a  b ", "a\n\nb", "▁x▁", "漢字 🙂 \u0000", "éa", "x" * 50, "\t tab"]


def test_pieces_round_trip(spark, documents):
    model = pieces.load(PIECE_MODEL)
    rows = [(i, t) for i, t, _ in documents[:60]] + [(10**6 + k, t) for k, t in enumerate(TRICKY)] + [(-1, None)]
    e = pieces.encode(frame(spark, rows), model)
    got = {r.doc_id: r.decoded for r in pieces.decode(e, model).collect()}
    assert got == dict(rows)


def test_chunks_together(documents):
    model = pieces.load(PIECE_MODEL)
    found = list(dict.fromkeys(c for t in [*TRICKY, *(t for _, t, _ in documents[:40])] if t for c in pieces.chunks(t)))
    found += [c for c in (pieces.SPACE + "ab" * 40, "日本語😀", "é\x00a", "\x00", pieces._LITERAL) if c not in found]
    assert len(found) > 100
    for (ids, score, cost), c in zip(pieces.viterbi_many(model, found), found, strict=True):
        want = pieces.viterbi(model, c)
        assert (ids, score, cost) == (want[0].tobytes(), want[1], want[2]), c
    ways = pieces.Ways(model)
    for _ in range(2):
        for c, k in zip(found[:60] * 2, ways.of(found[:60] * 2).tolist(), strict=True):
            assert ways.ids[ways.ends[k]:ways.ends[k + 1]].tolist() == pieces.viterbi(model, c)[0].tolist()


def test_n_best():
    scored = {p: (k, -float(len(p) * 7 % 5) - 0.01 * k) for k, p in enumerate(["▁", "a", "b", "ab", "aba", "ba", "▁a", "bab", "▁ab"])}
    model = pieces.build([*scored, *range(256)], scored, list(range(9, 265)))

    def ways(chunk, at=0):
        if at == len(chunk):
            return [(0.0, ())]
        return [(s + r, i + t) for e, i, s in pieces.edges(model, chunk, at) for r, t in ways(chunk, e)]
    parts = pieces.chunks("abab ab bab\nabc")
    for c in parts:
        want = sorted((s for s, _ in ways(c)), reverse=True)[:5]
        got = pieces.n_best(model, c, 5)
        assert [s for s, _ in got] == pytest.approx(want) and len({i for _, i in got}) == len(got)
    total = [0.0]
    for c in parts:
        total = sorted((a + s for a in total for s, _ in ways(c)), reverse=True)[:4]
    best = [pieces.viterbi(model, c) for c in parts]
    got = pieces.combined(model, parts, [b[2] for b in best], sum(b[1] for b in best), 4)
    assert [s for s, _ in got] == pytest.approx(total)


# html, language, licences, shards, chat -----------------------------------------------------------

def test_html(spark):
    page = ("<html><head><title>t</title></head><body><nav><a href=x>home</a></nav><div class='ad'>Buy now and save a lot of money today.</div><article><h1>A &amp; B</h1>"
            "<p>Some  words\n of text<script>no()</script>.</p><!-- <p>x</p> --><p>Yes.</p><form>mail</form></article><aside>other stories of the day</aside><footer>© us")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p>unclosed <b>" + "long text " * 5000)]
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got)[:4] == [(1, "A & B\nSome words of text.\nYes.")] * 2 + [(2, ""), (3, "")]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    table = html_text.labelled_table()
    tree = html_text.grow(table)
    assert all(html_text.classify(tree, f) == y for f, y in table)


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(d)
    rows = language.predict(d.withColumn("held_out", language.held_out(d["doc_id"])), model, keep=("doc_id", "held_out", "lang")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in rows)
    edge = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame(spark, [(1, None), (2, "123 ..."), (3, "the of and")]), model).collect()}
    assert edge[1] == edge[2] == ("und", 0.0) and edge[3][0] == "en"
    assert language.fit(d.limit(0)) is None and language.predict(d.limit(3), None).first().lang_pred == "und"


def test_posteriors_against_paths():
    import itertools
    rng = np.random.default_rng(1)
    trans, lengths = rng.random((3, 3)) + .1, np.array([4, 1, 3])
    emit = rng.random((8, 3)) + .05
    post, expected = language.posteriors(emit.copy(), lengths, trans)
    at, want = 0, np.zeros((3, 3))
    for n in lengths.tolist():
        z, g, x = 0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            s = np.prod([emit[at + t, path[t]] for t in range(n)]) * np.prod([trans[path[t - 1], path[t]] for t in range(1, n)])
            z += s
            for t in range(n):
                g[t, path[t]] += s
            for t in range(1, n):
                x[path[t - 1], path[t]] += s
        assert np.allclose(g / z, post[at:at + n])
        want, at = want + x / z, at + n
    assert np.allclose(want, expected)


def test_licenses(spark):
    mit = "Copyright (c) 2020 Somebody\n\n" + licenses.KNOWN[0][1].replace("notice", "NOTICE").replace(",", " ,")
    rows = [(10, mit), (11, "text\n  licensed under the Apache Licence version 2.0\nmore"), (12, "no license"), *EDGE]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got[10] == ("MIT", []) and got[11] == (None, ["Apache-2.0"]) and got[12] == (None, []) and got[1] == (None, [])


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 900), f"g{rng.randrange(300)}", rng.random() * 9, None if i % 9 == 0 else rng.randrange(4)) for i in range(900)]
    rows += [(1000 + i, 500, "hot", 4.0, 1) for i in range(600)]
    out = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, size long, group string, a double, b int"), ["a", "b"], n_shards=8).collect()
    assert len(out) == len(rows)
    total = Counter()
    slots: dict[int, list[int]] = {}
    for r in out:
        total[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    share = sum(total.values()) / 8
    assert set(total) == set(range(8)) and all(abs(v - share) < 0.08 * share for v in total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.kd_shards(spark.createDataFrame([], "doc_id long, size long, group string, a double"), ["a"], n_shards=8).count() == 0


def test_chat_trees(spark):
    rows = [("t", 1, None, 0, "user", "hi <|turn|> <\\|end|>", 0.0), ("t", 2, 1, 1, "assistant", "low", 1.0), ("t", 3, 1, 1, "assistant", None, 5.0),
            ("t", 4, 3, 2, "user", "[INST]", 1.0), ("t", 5, 99, 3, None, "orphan", 0.5), ("t", 6, 6, 1, "user", "own parent", 0.1), ("t", 6, 6, 1, "user", "own parent", 0.1)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, place long, role string, text string, score double")
    got = chat.format_trees(df, branches=None).withColumn("turns", chat.read_turns(chat.F.col("formatted"))).withColumn(
        "loss", chat.read_loss(chat.F.col("formatted"), chat.F.col("loss_spans"))).orderBy("rank").collect()
    assert [(r.leaf, [(t.role, t.text) for t in r.turns], r.loss) for r in got] == [
        (4, [("user", "hi <|turn|> <\\|end|>"), ("assistant", ""), ("user", "[INST]")], ""), (2, [("user", "hi <|turn|> <\\|end|>"), ("assistant", "low")], "low"),
        (5, [("", "orphan")], ""), (6, [("user", "own parent")], "")]
    chain = [("c", i, i - 1 if i else None, i, "user", str(i), 0.0) for i in range(70)]
    one = chat.format_trees(spark.createDataFrame(chain, df.schema)).withColumn("turns", chat.read_turns(chat.F.col("formatted"))).collect()
    assert [t.text for t in one[0].turns] == [str(i) for i in range(70)]
    assert chat.format_trees(df.limit(0)).count() == 0


# pipeline -----------------------------------------------------------------------------------------

def similar_groups(texts):
    """The root of every text by links of five-word similarity 0.8 or more, all pairs compared."""
    sets = [near_copies.shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near_copies.similarity(sets[i], sets[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_pipeline(spark, documents):
    """Each stage by its own brute force, one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verdict = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    left = sorted((i, t) for i, t, _ in documents if i in verdict)
    roots = similar_groups([t for _, t in left])
    left = [x for k, x in enumerate(left) if roots[k] == k]
    cut = brute_spans(left)
    texts = {}
    for i, t in left:
        b, out, last = (t or "").encode(), b"", 0
        for p, q in cut[i]:
            out, last = out + b[last:p], q
        texts[i] = (out + b[last:]).decode("utf-8", "replace")

    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        return [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    windows = {tuple(w[i:i + min(10, len(w))]) for w in map(tokens, bench) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    texts = {i: t for i, t in texts.items() if not any(tuple(w[p:p + s]) in windows for w in [tokens(t)] for s in sizes for p in range(len(w) - s + 1))}
    model = pieces.load(PIECE_MODEL)
    want = {i: [x for c in pieces.chunks(t) for x in pieces.viterbi(model, c)[0]] if t else [] for i, t in texts.items()}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_queries_registered():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(QUERIES) == 13
    assert hashlib.md5(b"").hexdigest()
