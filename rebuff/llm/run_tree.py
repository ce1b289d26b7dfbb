"""Suffix trees of integer sequences (Ukkonen) with constant-time common extensions.

The tree is built left to right in linear time. An Euler tour of it turns the lowest common ancestor of two
leaves into a range minimum over string depths, which block minima answer in constant time, for whole arrays
of queries at once.
"""
from __future__ import annotations

import numpy as np

_BLOCK = 16


class RangeMinimum:
    """Minima of closed ranges in constant time each: prefix and suffix minima inside blocks, doubled minima over blocks."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        padded = np.full(-(-n // _BLOCK) * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:n] = values
        rows = padded.reshape(-1, _BLOCK)
        self.values = padded
        self.prefix = np.minimum.accumulate(rows, axis=1).ravel()
        self.suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.over = [rows.min(axis=1)]
        while 2 << (len(self.over) - 1) <= len(rows):
            half = 1 << (len(self.over) - 1)
            self.over.append(np.minimum(self.over[-1][:-half], self.over[-1][half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.suffix[lo], self.prefix[hi])
        gap = np.flatnonzero(b - a > 1)
        if len(gap):
            first, size = a[gap] + 1, b[gap] - a[gap] - 1
            level = np.frexp(size.astype(np.float64))[1] - 1        # floor of the binary logarithm
            for k in np.unique(level):
                at = gap[level == k]
                table, start, stop = self.over[k], a[at] + 1, b[at] - (1 << int(k))
                out[at] = np.minimum(out[at], np.minimum(table[start], table[stop]))
        inside = np.flatnonzero(a == b)
        if len(inside):
            at, stop = lo[inside], hi[inside]
            best = self.values[at]
            for step in range(1, _BLOCK):
                best = np.minimum(best, self.values[np.minimum(at + step, stop)])
            out[inside] = best
        return out


class SuffixTree:
    """``seq``: non-negative numbers below ``len(seq)``. ``rank`` orders the suffixes, a prefix before what it begins."""

    def __init__(self, seq: list[int]) -> None:
        self.n = len(seq)
        start, stop, child = _ukkonen([*(c + 1 for c in seq), 0], self.n + 1)
        self._tour(start, stop, child)

    def _tour(self, start: list[int], stop: list[int], child: dict[int, int]) -> None:
        n, width, nodes = self.n, self.n + 1, len(start)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        kids = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)                # by parent, then first symbol; the end mark is least
        parents, kids = keys[order] // width, kids[order]
        at = np.searchsorted(parents, np.arange(nodes + 1)).tolist()
        kids = kids.tolist()
        tour: list[int] = []                    # string depths along the Euler tour
        first = [0] * width                     # a leaf's place in it
        rank = [0] * width
        seen = 0
        stack, depth = [0], [0]
        nxt = at[:nodes]
        while stack:
            node = stack[-1]
            d = depth[-1]
            k = nxt[node]
            if k == at[node + 1]:
                stack.pop()
                depth.pop()
                if depth:
                    tour.append(depth[-1])
                continue
            if k == at[node]:
                tour.append(d)
            nxt[node] = k + 1
            kid = kids[k]
            to = stop[kid]
            if to < 0:                          # a leaf: its suffix begins where path and rest of the text meet
                suffix = start[kid] - d
                first[suffix] = len(tour)
                rank[suffix] = seen
                seen += 1
                tour.append(width - suffix)
                tour.append(d)
            else:
                stack.append(kid)
                depth.append(d + to - start[kid])
        self.first = np.array(first, np.int64)
        self.rank = rank[:n]
        self.minimum = RangeMinimum(np.array(tour, np.int32))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, different places up to n."""
        x, y = self.first[a], self.first[b]
        return self.minimum(np.minimum(x, y), np.maximum(x, y)).astype(np.int64)


def _ukkonen(text: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Edge starts and ends (-1: open, a leaf) of all nodes, and the child under ``node * width + symbol``. Node 0 is the root."""
    start, stop, link = [0], [0], [0]
    child: dict[int, int] = {}
    node = length = edge = todo = 0             # active point: node, and the edge by a place in the text
    for i, c in enumerate(text):
        todo += 1
        pending = 0
        while todo:
            if not length:
                edge = i
            key = node * width + text[edge]
            kid = child.get(key)
            if kid is None:
                child[key] = len(start)
                start.append(i)
                stop.append(-1)
                link.append(0)
                if pending:
                    link[pending] = node
                    pending = 0
            else:
                s = start[kid]
                size = (stop[kid] if stop[kid] >= 0 else i + 1) - s
                if length >= size:              # walk down
                    node = kid
                    length -= size
                    edge += size
                    continue
                if text[s + length] == c:
                    length += 1
                    if pending:
                        link[pending] = node
                    break
                split = len(start)
                start += (s, i)
                stop += (s + length, -1)
                link += (0, 0)
                child[key] = split
                child[split * width + c] = split + 1
                start[kid] = s + length
                child[split * width + text[s + length]] = kid
                if pending:
                    link[pending] = split
                pending = split
            todo -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - todo + 1
    return start, stop, child
