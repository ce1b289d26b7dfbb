"""Periodic runs against brute force over every period."""
from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rebuff.llm import periodic
from rebuff.llm.queries import QUERIES
from rebuff.llm.run_tree import SuffixTree

SF = "/root/testdata/sf0.001"


def brute_runs(seq, least=6, exponent=4):
    n, out = len(seq), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            s, size = i, j - i + q
            whole = seq[s:s + size]
            if size >= max(least, exponent * q) and not any(whole[r:] == whole[:-r] for r in range(1, q)):
                out.append((s, size, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def numbers(seq):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in seq], np.int64)


def runs(seq, *limits):
    return list(zip(*(x.tolist() for x in periodic.document_runs(numbers(seq), *limits))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6), st.integers(1, 8))
def test_runs_against_brute_force(seq, unit, times):
    seq = seq + seq[:unit] * times + [9] + seq[::-1]
    for limits in ((6, 4), (2, 2), (1, 3)):
        assert runs(seq, *limits) == brute_runs(seq, *limits)


def test_extensions():
    rng = random.Random(1)
    for _ in range(200):
        seq = numbers([rng.randrange(3) for _ in range(rng.randrange(1, 60))]).tolist()
        tree, n = SuffixTree(seq), len(seq)
        assert [i for _, i in sorted((seq[i:], i) for i in range(n))] == sorted(range(n), key=tree.rank.__getitem__)
        a, b = np.triu_indices(n + 1, 1)
        want = [next((k for k in range(n) if j + k >= n or seq[i + k] != seq[j + k]), n) for i, j in zip(a, b)]
        assert tree.extension(a, b).tolist() == want


@pytest.mark.parametrize("seq", [[0] * 50_000, [k % 7 for k in range(50_000)]])
def test_long_periodic_text(seq):
    q = len(set(seq))
    assert runs(seq) == [(0, len(seq), q)]


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 5 + "c"), (3, "a b " * 5 + "c"), (None, "x x x x x x x"), (5, " \t\n"), (6, "w " * 5), (7, "w " * 6)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, runs string, _text int")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect())
    want = sorted([("1", [], ""), ("2", [], ""), ("3", [(0, 10, 2)], "a b c"), ("3", [(0, 10, 2)], "a b c"), ("None", [], "x x x x x x x"),
                   ("5", [], ""), ("6", [], "w w w w w"), ("7", [(0, 6, 1)], "w")])
    assert got == want
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, exponent=1)


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", d.text or "") if x]
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 3000:            # the brute force is quadratic
            continue
        want = brute_runs(w)
        some += bool(want)
        dropped = {i for s, size, q in want for i in range(s + q, s + size)}
        r = got[d.doc_id]
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 5
