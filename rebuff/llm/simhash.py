"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has bit b set if over half of the hashes of the text's word shingles have it. Two
fingerprints link if they differ in at most ``radius`` bits; groups are connected components.

Candidates: the 64 bits are cut into ``blocks``; two fingerprints within the radius agree on at least
``blocks - radius`` of them, so every pair meets under one of the C(blocks, radius) keys. Inside a key the
fingerprints are compared bit-sliced: one plane per bit, 64 rows to a machine word, so that row i and row
i + d are compared for all i at once by shifting planes; carry-save counters add up the differing bits,
and words whose counters have all passed the radius are abandoned before the remaining planes are read.
Only spanning links leave a task, never all pairs of a group. A key held by more than ``block_rows``
fingerprints is cut into blocks, each pair of which is one group of bounded size.

Defined cases: a text without words, and a null text, has fingerprint zero and links like any other; rows
that repeat an id are one document of each of their texts; null ids belong to a group but never name it.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rebuff.llm.common import materialize, spread
from rebuff.llm.components import components

BITS = 64
SHINGLE = 4
RADIUS = 4
BLOCKS = 6
BLOCK_ROWS = 2048
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text. The words' bytes are joined by spaces, so a shingle is a slice."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    buffer = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    k = min(shingle, len(found))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(found) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):     # eight hash bytes to 64 columns of bits, a bounded number of rows at a time
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): one row per input row; the fingerprint's 64 bits are stored as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["k", "fp"])
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of every row, 64 rows to a word."""
    rows = -(-len(fps) // 64) * 64
    padded = np.zeros(rows, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes whose row i is the input's row i + d."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    n = planes.shape[-1] - words
    if n > 0:
        out[..., :n] = planes[..., words:] >> np.uint64(bits)
        if bits and n > 1:
            out[..., :n - 1] |= planes[..., words + 1:] << np.uint64(64 - bits)
    return out


def _near(planes: np.ndarray, d: int, open_: np.ndarray, radius: int) -> np.ndarray:
    """A bit for every row i, open in ``open_``, that differs from row i + d in at most ``radius`` bits."""
    result = np.zeros(planes.shape[1], np.uint64)
    live = np.flatnonzero(open_)
    if not len(live):
        return result
    depth = max(1, (radius + 1).bit_length())
    words, bits = divmod(d, 64)
    width = planes.shape[1]
    near, far = live + words, live + words + 1
    counters = [np.zeros(len(live), np.uint64) for _ in range(depth)]
    over = ~open_[live]
    for b in range(BITS):
        plane = planes[b]
        other = np.where(near < width, plane[np.minimum(near, width - 1)], 0) >> np.uint64(bits)
        if bits:
            other = other | (np.where(far < width, plane[np.minimum(far, width - 1)], 0) << np.uint64(64 - bits))
        carry = plane[live] ^ other
        for c in counters:
            carry, c[:] = carry & c, c ^ carry
        over |= carry
        if b % 8 == 7:      # abandon the words in which every open pair has passed the radius
            over |= _above(counters, radius)
            keep = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                live, near, far, over = live[keep], near[keep], far[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    return result
    result[live] = ~(over | _above(counters, radius))
    return result


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the vertical counter exceeds ``radius``."""
    more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        bit = np.uint64(0xFFFFFFFFFFFFFFFF) if radius >> k & 1 else np.uint64(0)
        more |= equal & counters[k] & ~bit
        equal &= ~(counters[k] ^ bit)
    return more


def spanning_links(fps: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (row, row) that connect, within every run of equal ``run`` values, what is within the radius
    of each other, directly or over others. Runs are contiguous."""
    n = len(fps)
    label = np.arange(n)
    planes = _planes(fps)
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, n)
    sizes = np.diff(np.concatenate(([0], ends)))
    first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)    # bounds of each row's run
    links: list[tuple[int, int]] = []
    for d in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(np.arange(n) + d < last)
        i = i[label[i] != label[i + d]]
        bits = np.zeros(planes.shape[1] * 64, np.uint8)
        bits[i] = 1
        open_ = np.packbits(bits, bitorder="little").view(np.uint64)
        hit = np.unpackbits(_near(planes, d, open_, radius).view(np.uint8), bitorder="little")
        for a in np.flatnonzero(hit).tolist():
            x, y = label[a], label[a + d]
            if x != y:
                links.append((a, a + d))
                lo, hi = (x, y) if x < y else (y, x)
                at = slice(first[a], last[a])
                label[at][label[at] == hi] = lo
    return links


def block_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """The C(blocks, radius) keys of a fingerprint: for every choice of ``blocks - radius`` blocks, its number and their bits."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c] for c in chosen)
        mask -= (mask >> 63) << 64      # as a signed long
        keys.append(F.struct(F.lit(number).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints ``fp``."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("key")).select("fp", "key.t", "key.v")
    held = keyed.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(held, ["t", "v"])
    cuts = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), cuts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    met = met.select("fp", "t", "v", F.explode(pair).alias("at"))
    met = met.repartition(spread(distinct.sparkSession), "t", "v", "at").sortWithinPartitions("t", "v", "at", "fp")
    met = met.select("fp", F.xxhash64("t", "v", "at").alias("run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def out(b: pa.Table) -> pa.RecordBatch:
            fps, runs = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = np.array(spanning_links(fps.view(np.uint64), runs, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]]), pa.array(fps[found[:, 1]])], ["a", "b"])
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            runs = t.column(1).to_numpy()
            change = np.flatnonzero(runs[1:] != runs[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:         # the last run may go on in the next batch
                yield out(t.slice(0, cut).combine_chunks())
            left = t.slice(cut).combine_chunks().to_batches()
            rest = left[0] if left else None
        if rest is not None:
            yield out(pa.Table.from_batches([rest]))
    return met.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): one row per input row; the component's name is its smallest key."""
    f = materialize(fingerprints(docs, shingle, key, text), "fingerprints")
    distinct = materialize(f.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    linked = components(materialize(links(distinct, radius), "links"), distinct.sparkSession)
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return f.join(of, "fp", "left").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows with a null id stay only where the
    whole group has none; rows that repeat the kept id stay as they are."""
    g = groups(docs, radius, shingle)
    kept = g.where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias("_k")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_k"]), "left_semi")
