"""Sparse principal components by variable projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.linalg import robust_loadings, sparse_loadings
from ..plans.matrix import RowMatrix
from ..plans.svd import decompose
from .base import SingleSet, by_mode


class SparsePCA(SingleSet):
    """Sparse patterns B and orthonormal A with X near X B A'.

    The loop needs only the right singular vectors and singular values of X, so it runs on the driver after one (Gram) or a few
    (sketch, whose columns can be dealt to `n_blocks` passes) passes. The robust form estimates a sparse error matrix too; it works on the compressed matrix of the leading modes.
    """

    def __init__(self, n_modes=2, alpha=1e-3, beta=1e-3, robust=False, regularizer="l1", max_iter=500, tol=1e-6, oversample=10, n_subspace=1, n_blocks=1, gamma=0.1, **params):
        if regularizer not in ("l1", "l0"):
            raise ValueError(f'regularizer must be "l1" or "l0", not {regularizer!r}')
        if robust and regularizer == "l0":
            raise NotImplementedError("the robust form has no l0 penalty")
        super().__init__(n_modes, alpha=alpha, beta=beta, robust=robust, regularizer=regularizer, max_iter=max_iter, tol=tol, oversample=oversample, n_subspace=n_subspace, n_blocks=n_blocks, gamma=gamma, **params)

    def _fit(self, m: RowMatrix) -> None:
        p = self.params
        if m.is_complex:
            raise TypeError("sparse components are made of real data")
        n = m.count()
        rank = min(n, m.p)
        k = rank if p["n_modes"] == "all" else int(p["n_modes"])
        keep = rank if p["solver"] == "full" or m.p <= 4096 and p["solver"] == "auto" else min(rank, k + p["oversample"])
        d = decompose(m, keep, solver="randomized" if p["solver"] == "randomized" else "auto", random_state=p["random_state"], power=max(1, p["n_subspace"]) + 3, blocks=p["n_blocks"])
        if p["robust"]:
            keep = min(keep, k + p["oversample"])
            b, a, s = robust_loadings((d.v[:, :keep] * d.s[:keep]).T, k, p["alpha"], p["beta"], p["gamma"], p["max_iter"], p["tol"])
        else:
            b, a, s = sparse_loadings(d.v, d.s, k, p["alpha"], p["beta"], p["regularizer"], p["max_iter"], p["tol"])
        norms = np.sqrt(((d.s[:, None] * (d.v.T @ b)) ** 2).sum(axis=0))
        self.data.update(components=b, components_normal=a, norms=norms, explained_variance=s / (d.n - 1), total_variance=d.total, n_samples=d.n)

    def _project(self, m: RowMatrix) -> RowMatrix:
        return m.times(self.data["components"])

    def _rebuild(self, scores: RowMatrix, modes: slice) -> RowMatrix:
        return scores.times(self.data["components_normal"].T)

    def explained_variance(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["explained_variance"])

    def explained_variance_ratio(self) -> DataFrame:
        data = self._ready()
        return by_mode(self._session(), data["explained_variance"] / data["total_variance"])
