"""Cross-correlations of two series of one unit at all short lags, as array arithmetic inside a task.

A unit's series is one row with one value per day at most, so its size is bounded by the calendar. Positive
lag k pairs the response of day i with the friction of day i - k.
"""
from __future__ import annotations

import numpy as np

TINY = 1e-9


def standardized(x: np.ndarray) -> np.ndarray | None:
    """Centred and scaled, missing values zero; None for a series that does not vary."""
    if not np.isfinite(x).any():
        return None
    sd = np.nanstd(x)
    return np.nan_to_num((x - np.nanmean(x)) / (sd + TINY)) if sd >= TINY else None


def _windows(x: np.ndarray, lag_max: int) -> np.ndarray:
    """Row lag + lag_max holds x[i - lag] for every i, zero outside."""
    zero = np.zeros(lag_max)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((zero, x, zero)), len(x))[::-1]


def lag_curve(r: np.ndarray, f: np.ndarray, lag_max: int) -> np.ndarray | None:
    """Normalised correlations at lags -lag_max .. lag_max (nan where no day has a partner), None without variation."""
    r, f = standardized(r), standardized(f)
    if r is None or f is None:
        return None
    curve = _windows(f, lag_max) @ r / len(r)
    curve[np.abs(np.arange(-lag_max, lag_max + 1)) >= len(r)] = np.nan
    return curve


def masked_curve(r: np.ndarray, f: np.ndarray, lag_max: int, min_shared: int) -> np.ndarray:
    """Correlations over the days on which both series are observed, each lag with its own moments; nan where too
    few days are shared or one side does not vary on them. Missing days are nan in both series."""
    seen_r, seen_f = np.isfinite(r), np.isfinite(f)
    both = _windows(seen_f.astype(float), lag_max) * seen_r
    n = both.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        g = _windows(np.where(seen_f, f, 0.0), lag_max)
        h = np.where(seen_r, r, 0.0)
        dr = both * (h - (both @ h / n)[:, None])
        df = both * (g - ((both * g).sum(axis=1) / n)[:, None])
        sr, sf = np.sqrt((dr * dr).sum(axis=1) / n), np.sqrt((df * df).sum(axis=1) / n)
        curve = (dr * df).sum(axis=1) / n / (sr * sf)
    return np.where((n >= min_shared) & (sr >= TINY) & (sf >= TINY), curve, np.nan)


def rotation_peaks(r: np.ndarray, f: np.ndarray, lag_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every offset by which ``f`` can be rotated: lag and |correlation| of the strongest correlation after
    and before, as (post lag, post, pre lag, pre). Ties go to the smallest lag.

    One transform gives the circular correlation at all offsets. A lag's own correlation is that of the offset
    moved by the lag without the lag's pairs that reach around the end, which are summed up lag by lag.
    """
    n = len(r)
    circular = np.fft.irfft(np.fft.rfft(r) * np.conj(np.fft.rfft(f)), n)
    turned = np.concatenate((f, f))[::-1]           # turned[n - 1 - i + s] is f[(i - s) mod n], for i below n

    def around(i: int) -> np.ndarray:
        return r[i] * turned[n - 1 - i:2 * n - 1 - i]
    post, pre = np.empty((lag_max, n)), np.empty((lag_max, n))
    ahead, behind = circular.copy(), circular.copy()
    for k in range(1, lag_max + 1):
        ahead -= around(k - 1)
        behind -= around(n - k)
        post[k - 1] = np.roll(ahead, -k)
        pre[lag_max - k] = np.roll(behind, k)
    post, pre = np.abs(post) / n, np.abs(pre) / n
    at, to = post.argmax(axis=0), pre.argmax(axis=0)
    every = np.arange(n)
    return at + 1, post[at, every], to - lag_max, pre[to, every]
