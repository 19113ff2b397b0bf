"""Regularised canonical correlation analysis of any number of views."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import generalised_eigh
from ..plans.field import as_dims
from ..plans.matrix import MOST_GRAM, RowMatrix, X
from ..plans.order import SID, indexed
from ..plans.preprocess import Preprocessor
from ..plans.svd import decompose
from .base import Model, by_mode


def per_view(name: str, value, n: int) -> list:
    if isinstance(value, list | tuple):
        if len(value) != n:
            raise ValueError(f"{name} needs one value or {n}, not {len(value)}")
        return list(value)
    return [value] * n


class MultiCCA(Model):
    """Solves C w = l D w: C the covariances between views, D those within, shrunk towards the identity by `c`.

    Views are paired by position and, with `pca`, reduced first; one pass over the paired views sums all products.
    """

    def __init__(self, n_modes=2, use_coslat=False, check_nans=True, c=0.0, pca=True, variance_fraction=0.99, init_pca_modes=0.75, compute=True, eps=1e-6):
        super().__init__(n_modes=n_modes, use_coslat=use_coslat, check_nans=check_nans, c=c, pca=pca, variance_fraction=variance_fraction, init_pca_modes=init_pca_modes, compute=compute, eps=eps)
        self.preprocessors: list[Preprocessor] = []
        self.views: list[RowMatrix] = []

    def fit(self, views, dim):
        """Fit to a list of fields with as many samples each."""
        dims = as_dims(dim)

        def work():
            n, p = len(views), self.params
            if n < 2:
                raise ValueError("need two views or more")
            coslat = per_view("use_coslat", p["use_coslat"], n)
            self.preprocessors = [Preprocessor(True, False, coslat[i], p["check_nans"]) for i in range(n)]
            self.views = [q.fit(v, dims).persist() for q, v in zip(self.preprocessors, views, strict=True)]
            self.spark = self.preprocessors[0].spark
            if any(v.is_complex for v in self.views):
                raise TypeError("views must be real")
            for v in self.views:
                if v.p < p["n_modes"]:
                    raise ValueError(f"a view of {v.p} features has no {p['n_modes']} modes")
            self._fit()

        return self._run(work)

    def _bases(self) -> list[np.ndarray]:
        p = self.params
        if not p["pca"]:
            if sum(v.p for v in self.views) > MOST_GRAM:
                raise ValueError(f"more than {MOST_GRAM} features: pca is needed")
            return [np.eye(v.p) for v in self.views]
        out = []
        for v, first in zip(self.views, per_view("init_pca_modes", p["init_pca_modes"], len(self.views)), strict=True):
            rank = min(v.count(), v.p)
            if isinstance(first, float) and 0 < first <= 1:
                k = max(1, int(first * rank))
            elif isinstance(first, int) and first > 1:
                k = min(first, rank)
            else:
                raise ValueError("init_pca_modes is a fraction up to 1 or a number above 1")
            d = decompose(v, k)
            share = np.cumsum(d.variance / d.total) - 1e-6
            if share[-1] <= min(p["variance_fraction"], 0.9999):
                warnings.warn(f"{k} modes explain {share[-1]:.4f} of a view's variance, not {p['variance_fraction']}", stacklevel=2)
            keep = max(int((share <= p["variance_fraction"]).sum()) + 1, 2)
            out.append(d.v[:, :keep])
        return out

    def _gram(self, parts: list[RowMatrix]) -> tuple[int, np.ndarray]:
        joined = None
        for k, m in enumerate(parts):
            placed = indexed(m.rows(), m.keys).select(SID, F.col(X).alias(f"x{k}"))
            joined = placed if joined is None else joined.join(placed, SID, "full")
        joined = joined.persist()
        if joined.where(" or ".join(f"x{k} is null" for k in range(len(parts)))).limit(1).count():
            joined.unpersist()
            raise ValueError("all views must have the same number of samples")
        out = RowMatrix(joined.select(F.concat(*[f"x{k}" for k in range(len(parts))]).alias(X)), (), sum(m.p for m in parts)).moments()
        joined.unpersist()
        return out

    def _fit(self) -> None:
        p, n_views = self.params, len(self.views)
        bases = self._bases()
        reduced = [v.times(b) for v, b in zip(self.views, bases, strict=True)]
        n, gram = self._gram(reduced)
        cov = gram / (n - 1)
        cuts = np.cumsum([0, *[b.shape[1] for b in bases]])
        spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        c = cov.copy()
        d = np.zeros_like(cov)
        shrink = per_view("c", p["c"], n_views)
        for s, k in zip(spans, shrink, strict=True):
            c[s, s] = 0
            d[s, s] = (1 - k) * cov[s, s] + k * np.eye(s.stop - s.start)
        d -= (min(0.0, np.linalg.eigvalsh(d).min()) - p["eps"]) * np.eye(len(d))
        k = p["n_modes"]
        values, vectors = generalised_eigh(c / n_views, d / n_views, k)
        vectors = vectors / np.linalg.norm(vectors, axis=0)
        flip = np.where(np.abs(vectors.max(0)) >= np.abs(vectors.min(0)), 1.0, -1.0)
        vectors = vectors * flip
        inner = [vectors[s] for s in spans]
        weights = [b @ w for b, w in zip(bases, inner, strict=True)]
        loads = [w / np.linalg.norm(w, axis=0) for w in weights]
        # variances of the latent series, divided by n; totals by n - 1
        inner_loads = [b.T @ v for b, v in zip(bases, loads, strict=True)]
        explained = [np.einsum("ik,ij,jk->k", v, gram[s, s] / n, v) for v, s in zip(inner_loads, spans, strict=True)]
        total = [float(np.trace(cov[s, s])) for s in spans]
        between = []
        for j in range(k):
            m = np.zeros((n_views, n_views))
            for a in range(n_views):
                for b in range(n_views):
                    if a != b:
                        m[a, b] = inner_loads[a][:, j] @ cov[spans[a], spans[b]] @ inner_loads[b][:, j]
            between.append(np.linalg.svd(m, compute_uv=False)[0])
        all_between = np.linalg.svd(c, compute_uv=False)[::2][: min(s.stop - s.start for s in spans)].sum()
        canonical, correlation = [], []
        for v, s, w, i in zip(self.views, spans, inner, range(n_views), strict=True):
            loading = self._canonical(v, bases[i], gram[s, s], w)
            spread = np.sqrt(np.diag(self._feature_gram(v, bases[i], gram[s, s])) / n)
            size = np.sqrt(np.einsum("ik,ij,jk->k", w, gram[s, s] / n, w))
            canonical.append(loading)
            with np.errstate(divide="ignore", invalid="ignore"):
                correlation.append(np.clip(loading / n / spread[:, None] / size, -1, 1))
        self.data.update(
            n_samples=n, eigenvalues=values, weights=weights, canonical_loadings=canonical, correlations=correlation, explained_variance=explained, total_variance=total,
            explained_covariance=np.array(between), total_explained_covariance=float(all_between),
        )

    def _feature_gram(self, v: RowMatrix, basis: np.ndarray, gram: np.ndarray) -> np.ndarray:
        if basis.shape[0] == basis.shape[1]:
            return basis @ gram @ basis.T
        if not hasattr(self, "_spreads"):
            self._spreads: dict[int, np.ndarray] = {}
        if id(v) not in self._spreads:  # the truncated components do not hold all the variance of the features
            from ..plans.matrix import block, total

            p = v.p
            self._spreads[id(v)] = np.diag(total(v.only(), (p,), lambda b: (block(b, p, False) ** 2).sum(axis=0)))
        return self._spreads[id(v)]

    def _canonical(self, v: RowMatrix, basis: np.ndarray, gram: np.ndarray, w: np.ndarray) -> np.ndarray:
        """X' X W: the leading components are orthogonal to what the reduction left out."""
        return basis @ gram @ w

    def transform(self, views) -> list[DataFrame]:
        """Canonical variates of further samples, a table a view."""
        data = self._ready()
        if len(views) != len(self.preprocessors):
            raise ValueError(f"need {len(self.preprocessors)} views")
        return [q.transform(v).times(w).long() for q, v, w in zip(self.preprocessors, views, data["weights"], strict=True)]

    def scores(self) -> list[DataFrame]:
        return [v.times(w).long() for v, w in zip(self.views, self._ready()["weights"], strict=True)]

    def weights(self) -> list:
        return [q.components(w) for q, w in zip(self.preprocessors, self._ready()["weights"], strict=True)]

    def components(self, normalize: bool = True) -> list:
        """Canonical loadings: correlations of features and variates, or their products."""
        data = self._ready()
        return [q.components(v) for q, v in zip(self.preprocessors, data["correlations" if normalize else "canonical_loadings"], strict=True)]

    def explained_variance(self) -> list[DataFrame]:
        return [by_mode(self._session(), v) for v in self._ready()["explained_variance"]]

    def explained_variance_ratio(self) -> list[DataFrame]:
        data = self._ready()
        return [by_mode(self._session(), v / t) for v, t in zip(data["explained_variance"], data["total_variance"], strict=True)]

    def explained_covariance(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["explained_covariance"])

    def explained_covariance_ratio(self) -> DataFrame:
        data = self._ready()
        return by_mode(self._session(), data["explained_covariance"] / data["total_explained_covariance"])

    def _parts(self, save_data: bool) -> dict:
        return {"preprocessors": [q.state() for q in self.preprocessors]}

    def _restore(self, parts: dict) -> None:
        self.preprocessors = [Preprocessor.from_state(q, self.spark) for q in parts["preprocessors"]]
