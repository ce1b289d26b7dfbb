"""Fill-in-the-middle cuts against regular expressions, and exact round trips."""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rebuff.llm import fill_middle
from rebuff.llm.queries import QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LETTERS = st.sampled_from(list(" \t\n\x0b\f\r\x08\x0e\x1f\x00\x7fab<>é漢😀\xa0\x85 "))


def brute(text, first, second):
    units = UNIT.findall(text or "")
    a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    return units, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(LETTERS, max_size=40)), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=20), st.integers(0, 3))
def test_cuts(rows, skip):
    texts, first, second = ([r[k] for r in rows] for k in range(3))
    column = pa.array([" x y"] * skip + texts, pa.string())[skip:]
    got = fill_middle._cuts(column, pa.array(first, pa.int64()), pa.array(second, pa.int64())).to_pylist()
    for row, r in zip(rows, got, strict=True):
        units, prefix, middle, _ = brute(*row)
        assert r == {"n": len(units), "prefix_bytes": len(prefix.encode()), "middle_bytes": len(middle.encode()), "prefix_chars": len(prefix), "middle_chars": len(middle)}


def test_long_text():
    text = "wörd " * 200_000
    r = fill_middle._cuts(pa.array([text, "", text]), pa.array([7, 7, 200_000]), pa.array([150_001, 1, 200_001])).to_pylist()
    for k, (first, second) in ((0, (7, 150_001)), (2, (200_000, 200_001))):
        units, prefix, middle, _ = brute(text, first, second)
        assert (r[k]["n"], r[k]["prefix_chars"], r[k]["middle_bytes"]) == (len(units), len(prefix), len(middle.encode()))


def test_forms_and_round_trip(spark):
    rows = [(i, t) for i in range(60) for t in ("eins zwei  drei\nvier ", "<", "<P <S> x" if i % 2 else "M> <P", "ä 漢字\t😀", "   ")] + [(None, "a b c"), (None, "a b c"), (70, None), (71, ""), (72, "<P>"), (73, "a<M>b")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n long, t string")
    f = fill_middle.fill_in_middle(docs.withColumn("own", F.col("text")), keep=("doc_id", "own", "n", "t"))
    got = f.select("doc_id", "own", "fim", fill_middle.restore(F.col("fim.text"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(rows) and {r.fim.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = r.own or ""
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
        units, prefix, middle, suffix = brute(text, h[0], h[1])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        assert (r.fim.n, r.fim.form, r.fim.text, r.back) == (len(units), form, want, text)
        assert (r.fim.prefix_chars, r.fim.middle_chars) == ((None, None) if form == "plain" else (len(prefix), len(middle)))
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_query(spark):
    status, info = compare(spark, connect(SF), "op13_fill_in_middle", SF)
    assert status == "OK", info
    rows = QUERIES["op13_fill_in_middle"](spark, SF).where("output_sha256 <> restored_sha256 and form = 'plain'")
    assert rows.count() == 0
