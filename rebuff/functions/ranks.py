"""Rank statistics of many short series at once, and exact null distributions of rank tests."""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Up to this length the distribution of Kendall's S without ties is counted out; above it is normal.
EXACT_KENDALL = 33
#: Up to this size of the smaller sample, and this product of both, the distribution of U without ties is counted out.
EXACT_U, EXACT_U_PRODUCT = 8, 1_000_000


#: Series of up to this length are compared value by value, in blocks; longer ones are merged.
SHORT, BLOCK = 2048, 256
_LATER = np.triu(np.ones((BLOCK, BLOCK), bool), 1)


def kendall_score(values: np.ndarray) -> int:
    """S of one short series: blocks of ranks against all later ones. n^2 comparisons of small integers cost
    less than n log n look-ups here."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int16)
    score = 0
    for at in range(0, len(rank), BLOCK):
        own, rest = rank[at:at + BLOCK, None], rank[None, at + BLOCK:]
        within, later = own.T, _LATER[:len(own), :len(own)]
        score += np.count_nonzero((own < within) & later) - np.count_nonzero((own > within) & later)
        score += np.count_nonzero(own < rest) - np.count_nonzero(own > rest)
    return int(score)


def kendall_scores(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """S = concordant - discordant pairs of every series ``values[bounds[k]:bounds[k + 1]]`` against its order."""
    sizes = np.diff(bounds)
    score = np.zeros(len(sizes), np.int64)
    for k in np.flatnonzero((sizes > 1) & (sizes <= SHORT)):
        score[k] = kendall_score(values[bounds[k]:bounds[k + 1]])
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        parts = [values[bounds[k]:bounds[k + 1]] for k in long]
        score[long] = merged_scores(np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes[long]))))
    return score


def merged_scores(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``kendall_scores`` of long series.

    All series are merged together, bottom up: at each level the right half of a block looks up how many values
    of its left half are smaller and larger. n log n steps take the place of n^2 pairs."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(bounds[:-1], sizes)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    top = len(values) + 1
    score = np.zeros(len(sizes), np.int64)
    for level in range(int(sizes.max(initial=1) - 1).bit_length()):
        pair = place >> (level + 1)
        key = np.unique(owner * top + pair, return_inverse=True)[1] * top      # the block, in order of series and place
        right = (place >> level) & 1 == 1
        left = np.sort(key[~right] + rank[~right])
        block, full = key[right], key[right] + rank[right]
        smaller = np.searchsorted(left, full, "left") - np.searchsorted(left, block, "left")
        larger = np.searchsorted(left, block + top, "left") - np.searchsorted(left, full, "right")
        score += np.bincount(owner[right], smaller - larger, len(sizes)).astype(np.int64)
    return score


def tie_sums(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of t(t-1) and t(t-1)(2t+5) over the groups of t equal values of every series."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rank = np.unique(values, return_inverse=True)[1]
    groups, t = np.unique(owner * (len(values) + 1) + rank, return_counts=True)
    whose, t = groups // (len(values) + 1), t.astype(float)
    return np.bincount(whose, t * (t - 1), len(bounds) - 1), np.bincount(whose, t * (t - 1) * (2 * t + 5), len(bounds) - 1)


@lru_cache(maxsize=None)
def inversion_shares(n: int) -> np.ndarray:
    """Shares of the permutations of n that have 0, 1, 2 ... inversions: each further element adds 0 to n - 1 of them."""
    if n < 2:
        return np.ones(1)
    return np.convolve(inversion_shares(n - 1), np.full(n, 1 / n))


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def kendall_p(n: int, s: int, ties: float, spread: float) -> float:
    """Two-sided p of S: exact for short series without ties, else normal with tie correction. ``ties`` and
    ``spread`` are the sums of ``tie_sums``."""
    pairs = n * (n - 1) // 2
    few = (pairs - abs(s)) // 2
    if not ties and (n <= EXACT_KENDALL or few <= 1):
        if n > EXACT_KENDALL:       # the two rarest outcomes of a long series
            return min(1.0, 2 * math.exp((math.log(n) if few else 0.0) - math.lgamma(n + 1)))
        return min(1.0, 2 * float(inversion_shares(n)[:few + 1].sum()))
    variance = (n * (n - 1) * (2 * n + 5) - spread) / 18
    return normal_tail(s / math.sqrt(variance)) if variance > 0 else 1.0


def u_shares(n1: int, n0: int) -> np.ndarray:
    """Shares of the arrangements of two samples without ties that have U = 0 .. n1 n0: the coefficients of a
    Gaussian binomial, one factor of the smaller sample at a time."""
    small, large = sorted((n1, n0))
    size = small * large + 1
    p = np.zeros(size)
    p[0] = 1.0
    for i in range(1, small + 1):
        p[large + i:] = p[large + i:] - p[:max(0, size - large - i)]        # times 1 - q^(large + i)
        for start in range(i):                                              # over 1 - q^i
            p[start::i] = np.cumsum(p[start::i])
        p *= i / (large + i)
    return np.clip(p, 0, None)


def u_p(u: float, n1: int, n0: int, ties: float) -> float:
    """Two-sided p of U: exact for a small sample without ties, else normal with continuity and tie correction.
    ``ties`` is the sum of t^3 - t."""
    if not n1 or not n0:
        return math.nan
    far = max(u, n1 * n0 - u)
    if not ties and min(n1, n0) <= EXACT_U and n1 * n0 <= EXACT_U_PRODUCT:
        return min(1.0, 2 * float(u_shares(n1, n0)[int(far):].sum()))
    n = n1 + n0
    variance = n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))
    return min(1.0, math.erfc((far - n1 * n0 / 2 - 0.5) / math.sqrt(2 * variance))) if variance > 0 else 1.0
