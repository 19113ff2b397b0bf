"""Truncated singular value decomposition of a row matrix.

Up to `MOST_GRAM` features the Gram matrix is summed in one pass and decomposed exactly on the driver. Wider matrices are sketched: subspace
iteration in feature space, each round one pass that sums a features x modes matrix, then a Rayleigh-Ritz step. With at
least as many sketch columns as rows this too is exact. Left singular vectors are never made: X v is scores times norms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.linalg import explained_modes, signs
from .matrix import MOST_GRAM, RowMatrix


@dataclass
class SVD:
    n: int  # rows that took part
    v: np.ndarray  # features x modes
    s: np.ndarray
    total: float  # sum of squares over n - 1
    gram: np.ndarray | None  # X^H X, where it was summed

    @property
    def variance(self) -> np.ndarray:
        return self.s**2 / max(self.n - 1, 1)


def check_modes(n_modes) -> None:
    if isinstance(n_modes, str):
        if n_modes != "all":
            raise ValueError(f'n_modes is a number or "all", not {n_modes!r}')
    elif isinstance(n_modes, bool) or not isinstance(n_modes, int | float | np.integer | np.floating):
        raise TypeError("n_modes is an int, a float or 'all'")
    elif isinstance(n_modes, int | np.integer):
        if n_modes < 1:
            raise ValueError("n_modes must be 1 or more")
    elif not 0 < n_modes <= 1:
        raise ValueError("a fraction of variance lies in (0, 1]")


def decompose(x: RowMatrix, n_modes=2, init_rank_reduction: float = 0.3, solver: str = "auto", random_state: int | None = None, power: int = 4, oversample: int = 10, flip_signs: bool = True, blocks: int = 1) -> SVD:
    """The leading modes: a number of them, all, or as many as explain a fraction of the variance.

    `solver`: "full" sums the Gram matrix, "randomized" sketches, "auto" chooses by width. For a fraction of
    variance a sketch computes `init_rank_reduction` of the rank at first. With `blocks` its columns are multiplied in so many passes
    instead of one, each with as much less for a task to hold.
    """
    check_modes(n_modes)
    if solver not in ("auto", "full", "randomized"):
        raise ValueError(f"solver must be auto, full or randomized, not {solver!r}")
    p = x.p
    if p <= MOST_GRAM and solver != "randomized" or solver == "full":
        n, gram = x.moments()
        values, v = np.linalg.eigh((gram + gram.conj().T) / 2)
        values, v = np.maximum(values[::-1], 0), v[:, ::-1]
        square = float(np.real(np.trace(gram)))
    else:
        n, gram = x.count(), None
        rank = min(n, p)
        want = rank if n_modes == "all" else n_modes if isinstance(n_modes, int | np.integer) else max(1, int(rank * init_rank_reduction))
        _check_rank(want, rank)
        width = min(rank, want + oversample)
        rng = np.random.default_rng(0 if random_state is None else random_state)
        q = rng.standard_normal((p, width)) + (1j * rng.standard_normal((p, width)) if x.is_complex else 0)
        for _ in range(1 + power):
            q, _ = np.linalg.qr(np.concatenate([x.back_and_forth(part) for part in np.array_split(q, max(1, min(blocks, width)), axis=1)], axis=1))
        n, small, square = x.small_gram(q)
        values, w = np.linalg.eigh((small + small.conj().T) / 2)
        values, v = np.maximum(values[::-1], 0), q @ w[:, ::-1]
    rank = min(n, p)
    if n < 1:
        raise ValueError("no sample has data")
    total = square / max(n - 1, 1)
    s = np.sqrt(values[:rank])
    if n_modes == "all":
        k = min(rank, len(s))
    elif isinstance(n_modes, int | np.integer):
        k = int(n_modes)
        _check_rank(k, rank)
    else:
        k = explained_modes(s**2 / max(n - 1, 1), n_modes, total)
    v, s = v[:, :k], s[:k]
    if flip_signs:
        v = v * signs(v)
    return SVD(n, v, s, total, gram)


def _check_rank(k: int, rank: int) -> None:
    if k > rank:
        raise ValueError(f"{k} modes are more than the rank of the data, {rank}")
