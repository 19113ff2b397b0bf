"""Models of time: lag-embedded EOF, principal oscillation patterns, optimal persistence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import herm, inverse
from ..plans.matrix import RowMatrix, X
from ..plans.series import embed, lagged_products, means, shifted
from ..plans.svd import check_modes, decompose
from .base import SingleSet, by_mode, row_amplitude, row_phase
from .single import EOF


class ExtendedEOF(EOF):
    """EOF of samples with their successors at `embedding` lags, `tau` positions apart.

    Patterns have a further dim `embedding`, the lag in positions. The last (embedding - 1) * tau samples have no score.
    """

    def __init__(self, n_modes, tau, embedding, n_pca_modes=None, **params):
        if tau < 1 or embedding < 1:
            raise ValueError("tau and embedding must be 1 or more")
        super().__init__(n_modes, tau=tau, embedding=embedding, n_pca_modes=n_pca_modes, **params)

    def _fit(self, m: RowMatrix) -> None:
        p = self.params
        basis = None
        if p["n_pca_modes"]:
            basis = decompose(m, p["n_pca_modes"], solver=p["solver"], random_state=p["random_state"]).v
            m = m.times(basis)
        wide = embed(m, p["embedding"], p["tau"])
        _, mean = means(wide)
        wide = self._all_samples(shifted(wide, mean), m).persist()
        d = decompose(wide, p["n_modes"], solver=p["solver"], random_state=p["random_state"], **p["solver_kwargs"])
        lags = d.v.reshape(p["embedding"], m.p, -1)
        full = lags if basis is None else np.einsum("fk,ekm->efm", basis, lags)
        self._embedded = wide
        self.data.update(components=full, embedded=d.v, norms=d.s, explained_variance=d.variance, total_variance=d.total, n_samples=d.n)

    @staticmethod
    def _all_samples(wide: RowMatrix, m: RowMatrix) -> RowMatrix:
        """The embedded rows and, without data, those that had none before."""
        rest = m.df.where(F.col(X).isNull()).select(*m.keys, *[F.lit(None).cast(wide.df.schema[c].dataType).alias(c) for c in wide.df.columns if c not in m.keys])
        return RowMatrix(wide.df.unionByName(rest), m.keys, wide.p, wide.is_complex)

    def _own_scores(self) -> RowMatrix:
        if getattr(self, "_embedded", None) is None:
            raise ValueError("the model was saved without its input")
        return self._embedded.times(self.data["embedded"])

    def _project(self, m: RowMatrix) -> RowMatrix:
        raise NotImplementedError("ExtendedEOF does not transform")

    def components(self, normalized: bool = True):
        data = self._ready()
        v = data["components"] if normalized else data["components"] * data["norms"]
        e, f, k = v.shape
        labels = {"embedding": np.repeat(np.arange(e) * self.params["tau"], k), "mode": np.tile(np.arange(1, k + 1), e)}
        return self.preprocessor.components(np.moveaxis(v, 0, 1).reshape(f, e * k), labels)

    def _rebuild(self, scores: RowMatrix, modes: slice) -> RowMatrix:
        return scores.times(self.data["components"][0].conj().T)

    _keeps_complex = False


class POP(SingleSet):
    """Principal oscillation patterns: eigenvectors of the feedback matrix of a first-order autoregression, in the space of the leading PCs."""

    def __init__(self, n_modes=2, center=True, standardize=False, use_coslat=False, use_pca=True, n_pca_modes=0.999, pca_init_rank_reduction=0.3, truncate=False, **params):
        super().__init__(n_modes, center, standardize, use_coslat, use_pca=use_pca, n_pca_modes=n_pca_modes, pca_init_rank_reduction=pca_init_rank_reduction, truncate=truncate, **params)
        check_modes(n_pca_modes)

    def _fit(self, m: RowMatrix) -> None:
        p = self.params
        if m.is_complex:
            raise TypeError("oscillation patterns are made of real data")
        if p["use_pca"]:
            d = decompose(m, p["n_pca_modes"], p["pca_init_rank_reduction"], p["solver"], p["random_state"], **p["solver_kwargs"])
            basis = d.v
        else:
            basis = np.eye(m.p)
        x = m.times(basis)
        # X0: all but the last sample, X1: all but the first
        n, gram = x.moments()
        lags = lagged_products(x, [0, 1])
        last = self._last_row(x)
        g0 = gram - np.outer(last.conj(), last)
        feedback = herm(lags[1][1]) @ inverse(g0)
        values, patterns = np.linalg.eig(feedback)
        values, patterns = values.astype(complex), patterns.astype(complex)
        with np.errstate(divide="ignore", invalid="ignore"):
            damping = -1 / np.log(np.abs(values))
            period = 2 * np.pi / np.angle(values)
        weights = self._coefficient_weights(patterns)
        cov = gram / n
        norms = np.sqrt(np.real(np.einsum("ik,ij,jk->k", weights.conj(), cov, weights)))
        order = np.argsort(-norms, kind="stable")
        if p["truncate"] and isinstance(p["n_modes"], int):
            order = order[: p["n_modes"]]
        self.data.update(
            components=(basis @ patterns)[:, order], pc_components=patterns[:, order], pc_weights=weights[:, order], basis=basis, norms=norms[order], eigenvalues=values[order],
            damping_times=damping[order], periods=period[order], total_variance=float(np.trace(gram).real / (n - 1)), n_samples=n,
        )

    @staticmethod
    def _last_row(x: RowMatrix) -> np.ndarray:
        row = x.rows().orderBy(*[F.col(k).desc_nulls_last() for k in x.keys]).select(X).first()
        return np.array(row[0])

    @staticmethod
    def _coefficient_weights(patterns: np.ndarray) -> np.ndarray:
        """Column k gives the complex coefficient of mode k as x @ column: least squares on the real and imaginary parts."""
        out = np.empty_like(patterns)
        for k, v in enumerate(patterns.T):
            parts = np.stack([v.real, v.imag])
            a, b = np.linalg.pinv(parts @ parts.T) @ parts
            out[:, k] = a + 1j * b
        return out

    def _project(self, m: RowMatrix) -> RowMatrix:
        return m.times(self.data["basis"]).times(self.data["pc_weights"])

    def _rebuild(self, scores: RowMatrix, modes: slice) -> RowMatrix:
        return scores.times(self.data["pc_components"].T).times(self.data["basis"].T)

    def components(self, normalized: bool = False):
        """Patterns times norms."""
        return self.preprocessor.components(self._patterns(normalized))

    def eigenvalues(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["eigenvalues"])

    def damping_times(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["damping_times"])

    def periods(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["periods"])

    def components_amplitude(self):
        return self.preprocessor.components(np.abs(self._patterns(True)))

    def components_phase(self):
        return self.preprocessor.components(np.angle(self._patterns(True)))

    def scores_amplitude(self, normalized: bool = True) -> DataFrame:
        return row_amplitude(self._score_matrix(normalized))

    def scores_phase(self) -> DataFrame:
        return row_phase(self._score_matrix(False))


class OPA(SingleSet):
    """Optimal persistence: patterns of greatest integrated autocorrelation up to lag `tau_max`."""

    def __init__(self, n_modes, tau_max, center=True, standardize=False, use_coslat=False, check_nans=True, n_pca_modes=100, **params):
        if isinstance(n_pca_modes, int) and isinstance(n_modes, int) and n_modes > n_pca_modes:
            raise ValueError("n_modes cannot exceed n_pca_modes")
        super().__init__(n_modes, center, standardize, use_coslat, check_nans, tau_max=tau_max, n_pca_modes=n_pca_modes, **params)

    def _fit(self, m: RowMatrix) -> None:
        p = self.params
        if m.is_complex:
            raise TypeError("persistence patterns are made of real data")
        d = decompose(m, p["n_pca_modes"], solver=p["solver"], random_state=p["random_state"], **p["solver_kwargs"])
        unit = np.sqrt(d.n - 1)
        to_scores = d.v / unit
        x = m.times(to_scores)
        tau = p["tau_max"]
        products = lagged_products(x, range(tau + 1))
        cov = {k: c / (n - 1) for k, (n, c) in products.items()}
        c0 = np.diag(np.diag(cov[0]))
        half = 0.5 * c0 + sum((cov[k] for k in range(1, tau)), np.zeros_like(c0)) + (0.5 * cov[tau] if tau else 0)
        g = np.diag(1 / np.sqrt(np.diag(c0)))
        target = 0.5 * g @ (half + half.T) @ g
        u, lam, _ = np.linalg.svd(target)
        k = len(lam) if p["n_modes"] == "all" else int(p["n_modes"])
        u, lam = u[:, :k], lam[:k]
        filters, patterns = g @ u, c0 @ g @ u
        comps = d.v * unit
        flip = np.where(np.abs((comps @ patterns).max(0)) >= np.abs((comps @ patterns).min(0)), 1.0, -1.0)
        filters, patterns = filters * flip, patterns * flip
        n = products[0][0]
        norms = np.sqrt(np.einsum("ik,ij,jk->k", filters, products[0][1], filters))
        self.data.update(components=comps @ patterns, filter_patterns=comps @ filters, projection=to_scores @ filters, decorrelation_time=lam, norms=norms, n_samples=n, c0=c0, u=u)

    def _own_scores(self) -> RowMatrix:
        if self.input is None:
            raise ValueError("the model was saved without its input")
        return self.input.times(self.data["projection"])

    def components(self, normalized: bool = True):
        return self.preprocessor.components(self._ready()["components"])

    def filter_patterns(self):
        return self.preprocessor.components(self._ready()["filter_patterns"])

    def decorrelation_time(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["decorrelation_time"])

    def transform(self, x, normalized: bool = False):
        raise NotImplementedError("OPA does not transform")

    def inverse_transform(self, scores, normalized: bool = False):
        raise NotImplementedError("OPA does not invert")
