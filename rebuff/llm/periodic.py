"""Periodic runs of words: maximal stretches that repeat a unit at least so many times.

A text's words become numbers, and the text is cut at words that cannot lie in any wanted run (a word of a run
occurs in it ``exponent`` times or more; the rule is applied again to what is left until nothing changes). Runs do
not reach over such a cut, and the place before or behind a run that ends at one cannot extend it. On every stretch that is left:

1. Ukkonen's suffix trees of the stretch and of its reversal, with an Euler tour each, give the longest common
   extension of two places to the right and to the left in constant time.
2. The longest Lyndon words at every place, under the order of the symbols and under its reverse, come from the
   next smaller and next greater suffix. They are the candidates: every run has a Lyndon root that is one of them.
3. Each candidate of length p at i is extended by the common extensions of i and i + p in both directions. Where the
   stretch gets p symbols or more longer, it is a maximal run with smallest period p.

Trees, tours and candidates are linear in the stretch, so a text takes time and memory in proportion to its words.

Defined cases: null and empty texts have no words and no runs; rows that repeat an id or a text are treated one
by one; an empty table gives no rows. Only ``keep`` and the results are returned, so no other column can clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rebuff.llm.run_tree import SuffixTree

LEAST_LENGTH = 6
EXPONENT = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Maximal stretches (from, to) whose words occur ``exponent`` times or more inside their stretch, and that hold ``least`` words."""
    left, done = [(0, len(ids))], []
    while left:
        lo, hi = left.pop()
        if hi - lo < least:
            continue
        part = ids[lo:hi]
        number = np.unique(part, return_inverse=True)[1] if hi - lo < len(ids) else part
        rare = np.bincount(number)[number] < exponent
        if not rare.any():
            done.append((lo, hi))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], rare, [True])).astype(np.int8)))
        left += [(lo + a, lo + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]
    return sorted(done)


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the length."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def stretch_runs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs, of exponent 2 or more, of a sequence."""
    n = len(part)
    seq = np.unique(part, return_inverse=True)[1].tolist()
    forward, backward = SuffixTree(seq), SuffixTree(seq[::-1])
    places, found = np.arange(n), []
    for rank, last in ((forward.rank, n), ([-r for r in forward.rank], n - 1)):     # the empty suffix is least, or else greatest
        j = np.array(_next_smaller(rank), np.int64)
        i = places[j <= last]
        j = j[i]
        p = j - i
        right = forward.extension(i, j)
        left = np.zeros(len(i), np.int64)
        inner = i > 0                            # common suffixes of what lies before i and before j
        left[inner] = backward.extension(n - i[inner], n - j[inner])
        ok = left + right >= p
        found.append(np.stack([i - left, left + p + right, p])[:, ok])
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def document_runs(ids: np.ndarray, least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least ``least`` words and ``exponent`` periods, by start, then period."""
    found = [(np.empty(0, np.int64),) * 3]
    for lo, hi in stretches(ids, least, exponent):
        start, length, period = stretch_runs(ids[lo:hi])
        ok = (length >= least) & (length >= exponent * period)
        found.append((start[ok] + lo, length[ok], period[ok]))
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run's part after its first period."""
    depth = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(depth)[:n] == 0


def find_runs(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``keep``, ``runs`` (start, length, period by start, then period; word numbers from 0) and ``collapsed``,
    the words that stay joined by one space."""
    if least < 1 or exponent < 2:
        raise ValueError("a run has a word and two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for text in b.column(b.num_columns - 1):
                words = (text.as_py() or b"").split()       # of bytes: at the six ASCII white-space characters only
                seen: dict[bytes, int] = {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                start, length, period = document_runs(ids, least, exponent)
                found.append((start, length, period))
                if len(start):
                    stay = kept_words(len(words), start, length, period)
                    words = [w for w, ok in zip(words, stay.tolist()) if ok]
                texts.append(b" ".join(words).decode())
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()) for k in range(3)], fields=list(RUN))
            offsets = np.cumsum([0, *(len(f[0]) for f in found)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(texts, pa.string())], [*keep, "runs", "collapsed"])
    d = docs.select(*keep, F.col(column).cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{schema}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
