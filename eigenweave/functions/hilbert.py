"""Analytic signal of a series, with exponential tails against edge effects."""

from __future__ import annotations

import numpy as np


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the first axis, by the one-sided spectrum."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=0) * weight.reshape(-1, *[1] * (x.ndim - 1)), axis=0)


def with_tails(x: np.ndarray, decay: float) -> np.ndarray:
    """Three times as long: the detrended ends fade out on either side along the extrapolated trend."""
    n = len(x)
    t = np.arange(n, dtype=float)
    tc = t - t.mean()
    slope = (tc[:, None] * x).sum(0) / max((tc**2).sum(), np.finfo(float).tiny)
    trend = lambda u: x.mean(0) + (u - t.mean())[:, None] * slope
    rest = x - trend(t)
    fade = np.exp(-t / n / decay)[:, None]
    tails = np.concatenate([rest[:1] * fade[::-1], rest, rest[-1:] * fade])
    return tails + trend(np.arange(-n, 2 * n, dtype=float))


def hilbert(x: np.ndarray, padding: str | None = "exp", decay: float = 0.2) -> np.ndarray:
    """Analytic signals of the columns of x, with zero mean; `padding` other than "exp" is none."""
    x = np.asarray(x, float)
    if x.ndim == 1:
        return hilbert(x[:, None], padding, decay)[:, 0]
    n = len(x)
    y = analytic(with_tails(x, decay))[n : 2 * n] if padding == "exp" else analytic(x)
    return y - y.mean(axis=0)
