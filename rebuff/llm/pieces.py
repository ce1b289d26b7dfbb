"""SentencePiece encoding and decoding with exact N-best segmentation over the piece lattice.

A piece model's pieces and scores span a lattice over the text; a segmentation's score is the sum of its
pieces' scores. Forward Viterbi scores give the best way to every position; a backward A-star search from
the end, with these scores as exact heuristics, then takes segmentations off its queue in order.

Space is written as U+2581, with one in front. No piece crosses a chunk (spaces and what follows up to the
next space; a line break by itself), so the lattice falls apart into chunks whose best ways are computed
once per task. A document's N best are exact: only the N - 1 chunks whose second way costs least can
differ from the best, so A-star runs on those and their ways are combined by total cost.

Characters that no piece spells become byte pieces, at ``BYTE_PENALTY`` below the worst score each; so do
U+2581 in the text itself, which makes decoding the exact inverse of encoding for every text.

A task's new chunks go through the forward pass together, one column of positions at a time (``viterbi_many``).

Defined cases: null text has null output; the empty text has no pieces; equal scores go to the way whose
last differing piece starts earlier.
"""
from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BYTE_PENALTY = 10.0
N_BEST = 4
SPACE = "▁"
#: Chunk ways kept per task before the memory is started anew.
CACHE = 400_000
#: Code points and rows of documents that a task encodes at once; a longer text is encoded alone.
SLICE_CHARS, SLICE_ROWS = 2_000_000, 512
#: Longer chunks take the forward pass one by one; a matrix of chunks stays within ``SLICE_CHARS`` cells.
WIDE = 48


class Model(NamedTuple):
    """Pieces by id; ``lattice``: piece or piece prefix -> (id, score), or None for a mere prefix; byte pieces' ids by
    byte; the lattice once more as ``steps``: sorted keys of (prefix number, next character), the prefix number that each
    leads to, and by prefix number the piece's id (-1: mere prefix) and score."""
    pieces: list
    lattice: dict
    byte_ids: list
    byte_score: float
    steps: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def load(path: str) -> Model:
    """Reads a model file on the driver; its vocabulary (bounded by the file) travels with the plan."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces: list = [None] * n
    scored, byte_ids = {}, [-1] * 256
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:-1], 16)] = i
            pieces[i] = int(p[3:-1], 16)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if re.search(f"[^{SPACE}]{SPACE}|\n", p):
                continue            # would cross a chunk
            scored[p] = (i, sp.get_score(i))
            pieces[i] = p
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    return build(pieces, scored, byte_ids)


def build(pieces: list, scored: dict, byte_ids: list) -> Model:
    lattice: dict = {p[:k]: None for p in scored for k in range(1, len(p))}
    lattice.update(scored)
    number = {p: k for k, p in enumerate(lattice, 1)} | {"": 0}
    keys = np.fromiter((number[p[:-1]] << 21 | ord(p[-1]) for p in lattice), np.int64, len(lattice))
    order = np.argsort(keys)
    ids = np.array([-1, *(-1 if x is None else x[0] for x in lattice.values())], np.int32)
    scores = np.array([0.0, *(0.0 if x is None else x[1] for x in lattice.values())])
    return Model(pieces, lattice, byte_ids, min((s for _, s in scored.values()), default=0.0) - BYTE_PENALTY, (keys[order], order + 1, ids, scores))


#: In a chunk U+2581 stands for a space, so a plain space can mark a literal U+2581.
_LITERAL = " "


def chunks(text: str) -> list[str]:
    """Independent parts of the lattice. A literal U+2581 is a chunk of its own, marked."""
    if SPACE in text:
        parts = text.split(SPACE)
        out = _cut(SPACE + parts[0].replace(" ", SPACE))
        for p in parts[1:]:
            out.append(_LITERAL)
            out += _cut(p.replace(" ", SPACE))
        return out
    return _cut(SPACE + text.replace(" ", SPACE))


_cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall


def edges(model: Model, chunk: str, start: int) -> list[tuple[int, tuple, float]]:
    """(end, ids, score) of the lattice edges that leave a position. The character's bytes are an edge
    only where no single-character piece exists."""
    out = []
    get, n = model.lattice.get, len(chunk)
    single = False
    for end in range(start + 1, n + 1):
        sub = chunk[start:end]
        hit = get(sub, 0)
        if hit == 0:
            break
        if hit is not None:
            single = single or end == start + 1
            out.append((end, (hit[0],), hit[1]))
    if not single:
        raw = (" " if chunk[start] == SPACE else chunk[start]).encode("utf-8", "surrogatepass")
        out.append((start + 1, tuple(model.byte_ids[b] for b in raw), model.byte_score * len(raw)))
    return out


def viterbi(model: Model, chunk: str) -> tuple[array, float, float]:
    """(ids, score, cost of the second way over the best, infinite if there is none)."""
    if chunk == _LITERAL:
        raw = SPACE.encode()
        return array("i", [model.byte_ids[b] for b in raw]), model.byte_score * len(raw), float("inf")
    n = len(chunk)
    low = float("-inf")
    best, second, back = [0.0] + [low] * n, [low] * (n + 1), [None] * (n + 1)
    get = model.lattice.get
    for s in range(n):
        at = best[s]
        single = False
        for e in range(s + 1, n + 1):
            hit = get(chunk[s:e], 0)
            if hit == 0:
                break
            if hit is None:
                continue
            if e == s + 1:
                single = True
            score = at + hit[1]
            if score > best[e]:
                second[e], best[e], back[e] = best[e], score, (s, hit[0])
            elif score > second[e]:
                second[e] = score
        if not single:
            raw = (" " if chunk[s] == SPACE else chunk[s]).encode("utf-8", "surrogatepass")
            score = at + model.byte_score * len(raw)
            e = s + 1
            if score > best[e]:
                second[e], best[e], back[e] = best[e], score, (s, raw)
            elif score > second[e]:
                second[e] = score
    ids, e, delta = [], n, float("inf")
    while e:
        gap = best[e] - second[e]
        if gap < delta:
            delta = gap
        e, i = back[e]
        if isinstance(i, bytes):
            ids += [model.byte_ids[b] for b in reversed(i)]
        else:
            ids.append(i)
    return array("i", ids[::-1]), best[n], delta


def viterbi_many(model: Model, found: list[str]) -> list[tuple[bytes, float, float]]:
    """``viterbi`` of many chunks, each with its ids as bytes of 32-bit numbers. All chunks advance from one start
    position together; a chunk that needs a byte piece goes through ``viterbi``."""
    keys, leads, piece, gain = model.steps
    n = len(found)
    out: list = [None] * n
    order = sorted((k for k, c in enumerate(found) if len(c) <= WIDE and c != _LITERAL), key=lambda k: -len(found[k]))
    for at in range(0, len(order) if len(keys) else 0, SLICE_CHARS // WIDE):
        rows = order[at:at + SLICE_CHARS // WIDE]
        size = np.fromiter((len(found[k]) for k in rows), np.int64, len(rows))
        width, m = int(size[0]), len(rows)
        chars = np.array([found[k] for k in rows], f"U{width}").view(np.uint32).reshape(m, width).astype(np.int64)
        best, second = np.full((m, width + 1), -np.inf), np.full((m, width + 1), -np.inf)
        back, ids = np.zeros((m, width + 1), np.int64), np.full((m, width + 1), -1, np.int32)
        best[:, 0] = 0.0
        spelled = np.ones(m, bool)
        for s in range(width):
            r = np.arange(np.searchsorted(-size, -s))       # the rows longer than s come first
            state = np.zeros(len(r), np.int64)
            for e in range(s + 1, width + 1):
                want = state << 21 | chars[r, e - 1]
                k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[k] == want
                r, state = r[hit], leads[k[hit]]
                if e == s + 1:      # a character without a piece of its own would be a byte edge
                    single = np.zeros(m, bool)
                    single[r[piece[state] >= 0]] = True
                    spelled &= single | (size <= s)
                ends = piece[state] >= 0
                to, node = r[ends], state[ends]
                score = best[to, s] + gain[node]
                old = best[to, e]
                more = score > old
                second[to, e] = np.where(more, old, np.maximum(second[to, e], score))
                won = to[more]
                best[won, e], back[won, e], ids[won, e] = score[more], s, piece[node[more]]
                go = size[r] > e
                r, state = r[go], state[go]
                if not len(r):
                    break
        every, end, cost = np.arange(m), size.copy(), np.full(m, np.inf)
        way, count = np.full((m, width), -1, np.int32), np.zeros(m, np.int64)
        live = every[spelled]
        while len(live):
            e = end[live]
            count[live] += 1
            way[live, width - count[live]] = ids[live, e]
            with np.errstate(invalid="ignore"):
                cost[live] = np.minimum(cost[live], best[live, e] - second[live, e])
            end[live] = back[live, e]
            live = live[end[live] > 0]
        total = best[every, size].tolist()
        for k, ok, w, c, t, d in zip(rows, spelled.tolist(), way, count.tolist(), total, cost.tolist()):
            if ok:
                out[k] = (w[width - c:].tobytes(), t, d)
    for k in range(n):
        if out[k] is None:
            i, t, d = viterbi(model, found[k])
            out[k] = (i.tobytes(), t, d)
    return out


class Ways:
    """The best ways of the chunks that a task has met, as flat arrays."""
    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.scores, self.costs = np.empty(0), np.empty(0)

    def of(self, met: list[str]) -> np.ndarray:
        """Their row numbers; what is new is worked out first."""
        if len(self.at) > CACHE:
            self.clear()
        new = [c for c in dict.fromkeys(met) if c not in self.at]
        if new:
            found = viterbi_many(self.model, new)
            size = np.fromiter((len(x[0]) // 4 for x in found), np.int64, len(found))
            self.at.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join([x[0] for x in found]), np.int32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))
            self.scores = np.concatenate((self.scores, [x[1] for x in found]))
            self.costs = np.concatenate((self.costs, [x[2] for x in found]))
        return np.fromiter(map(self.at.__getitem__, met), np.int64, len(met))


def n_best(model: Model, chunk: str, n: int = N_BEST) -> list[tuple[float, tuple]]:
    """Up to n segmentations of a chunk, best first, by backward A-star with the forward scores as
    heuristics: a state's priority is the score of its best completion, so states leave in final order."""
    if chunk == _LITERAL:
        ids, score, _ = viterbi(model, chunk)
        return [(score, tuple(ids))]
    size = len(chunk)
    ahead = [0.0] + [float("-inf")] * size
    entering: list[list] = [[] for _ in range(size + 1)]
    for s in range(size):
        for e, ids, score in edges(model, chunk, s):
            entering[e].append((s, ids, score))
            ahead[e] = max(ahead[e], ahead[s] + score)
    queue, tick, out = [(-ahead[size], 0, size, 0.0, ())], 0, []
    while queue and len(out) < n:
        _, _, at, behind, tail = heapq.heappop(queue)
        if at == 0:
            out.append((behind, tail))
            continue
        for s, ids, score in entering[at]:
            tick += 1
            heapq.heappush(queue, (-(ahead[s] + score + behind), tick, s, behind + score, ids + tail))
    return out


def combined(model: Model, parts: list[str], costs: np.ndarray, total: float, n: int) -> list[tuple[float, list[tuple[int, tuple]]]]:
    """The N best of a document: (score, [(chunk number, ids) for chunks that leave their best way])."""
    costs = np.asarray(costs, np.float64)
    bound = np.partition(costs, n - 2)[n - 2] if len(costs) >= n > 1 else np.inf
    open_ = np.flatnonzero((costs <= bound) & np.isfinite(costs)) if n > 1 else np.empty(0, np.int64)
    open_ = open_[np.argsort(costs[open_], kind="stable")][:n - 1]
    out: list[tuple[float, tuple]] = [(0.0, ())]
    for k in sorted(open_.tolist()):
        options = n_best(model, parts[k], n)
        top = options[0][0]
        out = heapq.nsmallest(n, [(cost + (top - s), swaps + (((k, ids),) if j else ())) for cost, swaps in out for j, (s, ids) in enumerate(options)], key=lambda x: (x[0], x[1]))
    return [(total - cost, list(swaps)) for cost, swaps in out]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the texts of a slice pass ``SLICE_CHARS`` or its rows ``SLICE_ROWS``."""
    size = np.cumsum([len(x) if x else 0 for x in batch.column(text).to_pylist()])
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(size, base + SLICE_CHARS, "right"))))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, model: Model, n: int = N_BEST, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``ids``, ``score``, and ``n_best``: scores in order with the chunks that differ from
    ``ids`` (chunk number, its ids). One row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Ways(model)
        for batch in batches:
            for b in slices(batch, len(keep)):
                texts = b.column(len(keep)).to_pylist()
                parts = [chunks(t) if t else [] for t in texts]
                count = np.fromiter(map(len, parts), np.int64, len(parts))
                of = seen.of([c for p in parts for c in p])
                document = np.repeat(np.arange(len(parts)), count)
                scores = np.bincount(document, seen.scores[of], len(parts)).astype(np.float64)
                first, size = seen.ends[of], seen.ends[of + 1] - seen.ends[of]
                before = np.cumsum(size) - size
                ids = seen.ids[np.repeat(first - before, size) + np.arange(int(size.sum()))]
                ends = np.concatenate(([0], np.cumsum(np.bincount(document, size, len(parts)).astype(np.int64)))).astype(np.int32)
                costs = np.split(seen.costs[of], np.cumsum(count)[:-1])
                mask = [t is None for t in texts]
                best = [None if t is None else combined(model, p, c, s, n) for t, p, c, s in zip(texts, parts, costs, scores.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=pa.array(mask, pa.bool_()))
                ways = pa.array([None if x is None else [{"score": s, "swaps": [{"chunk": k, "ids": list(i)} for k, i in w]} for s, w in x] for x in best], n_best_type)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], lists, pa.array(scores, pa.float64(), mask=np.array(mask, bool)), ways], [*keep, "ids", "score", "n_best"])
    n_best_type = pa.list_(pa.struct([("score", pa.float64()), ("swaps", pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
    d = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{schema}, ids array<int>, score double, n_best array<struct<score:double,swaps:array<struct<chunk:int,ids:array<int>>>>>")


def decode(encoded: DataFrame, model: Model, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """All columns plus the decoded text; null ids give null."""
    table = [bytes((p,)) if isinstance(p, int) else (p or "").replace(SPACE, " ").encode() for p in model.pieces]
    names = encoded.columns
    at = names.index(ids)

    def spell(x: pa.ListScalar) -> str | None:
        if not x.is_valid:
            return None
        raw = b"".join([table[i] for i in x.values.to_numpy().tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = pa.array(table, pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                b = batch.slice(k, SLICE_ROWS)
                x = b.column(at)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy()))), pa.int32()),
                                                 spelled.take(x.flatten()), mask=x.is_null())
                raw = pc.binary_join(lists, b"")
                try:
                    out = pc.replace_substring_regex(raw.cast(pa.string()), r"\A ", "")
                except pa.ArrowInvalid:     # ids of some row spell no valid UTF-8
                    out = pa.array([spell(v) for v in x], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*names, output])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{output}` string")
