"""Models of two fields: continuum power CCA and its special cases MCA, CCA and RDA.

Samples are paired by position. Either field is reduced to its leading principal components; one pass over the paired
components sums all products, and everything else (whitening, singular vectors, fractions, correlation patterns) is algebra
on these small matrices. Scores are row-wise products, made when asked for.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import explained_modes, herm, matrix_power, signs
from ..functions.stats import corrected, p_values
from ..plans.field import as_dims
from ..plans.matrix import MOST_GRAM, XI, RowMatrix, to_matrix
from ..plans.matrix import X as REAL
from ..plans.order import SID, indexed
from ..plans.preprocess import Preprocessor
from ..plans.series import analytic_rows
from ..plans.svd import check_modes, decompose
from .base import Model, by_mode, by_pair, matrix_from, matrix_state, row_amplitude, row_phase

EPS = np.finfo(float).eps


def pair(name: str, value) -> list:
    """A parameter for both sets."""
    if isinstance(value, list | tuple):
        if len(value) != 2:
            raise ValueError(f"{name} needs one value or two, not {len(value)}")
        return list(value)
    return [value, value]


def whitening(c: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(T, its inverse) with T = C^((alpha - 1) / 2); the identity from alpha 1 on."""
    if 1 - alpha < EPS:
        return np.eye(len(c)), np.eye(len(c))
    t = matrix_power(c, (alpha - 1) / 2)
    return t, matrix_power(c, (1 - alpha) / 2)


class Side:
    """One of the two sets: preprocessing, principal components, whitening."""

    def __init__(self, preprocessor: Preprocessor):
        self.preprocessor = preprocessor
        self.basis: np.ndarray | None = None
        self.t: np.ndarray | None = None
        self.t_inv: np.ndarray | None = None
        self.reduced: RowMatrix | None = None
        self.full: RowMatrix | None = None

    def state(self, save: bool) -> dict:
        return {"preprocessor": self.preprocessor.state(), "basis": self.basis, "t": self.t, "t_inv": self.t_inv, "reduced": matrix_state(self.reduced, save)}

    @classmethod
    def from_state(cls, state: dict, spark) -> Side:
        out = cls(Preprocessor.from_state(state["preprocessor"], spark))
        out.basis, out.t, out.t_inv = state["basis"], state["t"], state["t_inv"]
        out.reduced = matrix_from(state["reduced"])
        return out

    def physical(self, q: np.ndarray) -> np.ndarray:
        """Patterns of the whitened components in feature space."""
        return self.basis @ (herm(self.t_inv) @ q)


class CPCCA(Model):
    """Continuum power CCA: alpha (1: MCA, 0: CCA) sets how strongly each set is whitened."""

    _complex = False
    #: Of the special cases, for which it is no parameter.
    _alpha: tuple[float, float] | None = None

    def __init__(self, n_modes=2, alpha=0.2, standardize=False, use_coslat=False, use_pca=True, n_pca_modes=0.999, pca_init_rank_reduction=0.3, check_nans=True, compute=True, solver="auto", random_state=None, solver_kwargs=None, **more):
        check_modes(n_modes)
        alpha = alpha if self._alpha is None else list(self._alpha)
        given = {"standardize": standardize, "use_coslat": use_coslat, "use_pca": use_pca, "n_pca_modes": n_pca_modes, "pca_init_rank_reduction": pca_init_rank_reduction, "check_nans": check_nans, "alpha": alpha}
        both = {k: pair(k, v) for k, v in given.items()}
        if any(a < 0 for a in both["alpha"]):
            raise ValueError("alpha must be 0 or more")
        super().__init__(n_modes=n_modes, compute=compute, solver=solver, random_state=random_state, solver_kwargs=dict(solver_kwargs or {}), **both, **more)
        self.sides = [Side(Preprocessor(True, both["standardize"][i], both["use_coslat"][i], both["check_nans"][i])) for i in (0, 1)]

    # -- fit ----------------------------------------------------------------------------------------------------------
    def fit(self, X, Y, dim, weights_X=None, weights_Y=None):  # noqa: N803
        """Fit to two fields with as many samples; `dim` names the sample dims of both."""
        dims = as_dims(dim)

        def work():
            for i, (side, data, weights) in enumerate(zip(self.sides, (X, Y), (weights_X, weights_Y), strict=True)):
                m = side.preprocessor.fit(data, dims, weights)
                self.spark = side.preprocessor.spark
                self._reduce(side, m, i)
            self._fit()
            for side in self.sides:  # the reduced components are cached by now
                if side.full is not None:
                    side.full.df.unpersist()
                    side.full = None

        return self._run(work)

    def _reduce(self, side: Side, m: RowMatrix, i: int) -> None:
        p = self.params
        if self._complex and not m.is_complex and type(self).__name__.startswith("Complex"):
            warnings.warn("the data are real: the models without Complex in their names are meant for these", stacklevel=2)
        if p["use_pca"][i]:
            side.full = m.persist()
            side.basis = decompose(side.full, p["n_pca_modes"][i], p["pca_init_rank_reduction"][i], p["solver"], p["random_state"], **p["solver_kwargs"]).v
            reduced = m.times(side.basis)
        else:
            if m.p > MOST_GRAM:
                raise ValueError(f"{m.p} features: use_pca is needed beyond {MOST_GRAM}")
            side.basis, reduced = np.eye(m.p), m
        side.reduced = self._augment(reduced, i).persist()

    def _augment(self, m: RowMatrix, i: int) -> RowMatrix:
        return m

    def _joint(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of pairs, X^H X, Y^H Y and X^H Y, of samples paired by position."""
        a, b = (s.reduced for s in self.sides)
        is_complex = a.is_complex or b.is_complex

        def side(m: RowMatrix, name: str) -> DataFrame:
            placed = indexed(m.rows(), m.keys)
            cols = [F.col(SID), F.col(REAL).alias(f"{name}{REAL}")]
            if is_complex:
                cols.append((F.col(XI) if m.is_complex else F.array_repeat(F.lit(0.0), m.p)).alias(f"{name}{XI}"))
            return placed.select(*cols)

        both = side(a, "a").join(side(b, "b"), SID, "full").persist()
        odd = both.where(F.col(f"a{REAL}").isNull() | F.col(f"b{REAL}").isNull()).limit(1).count()
        if odd:
            both.unpersist()
            raise ValueError("both sets must have the same number of samples")
        parts = [F.concat(F.col(f"a{c}"), F.col(f"b{c}")).alias(c) for c in ([REAL, XI] if is_complex else [REAL])]
        n, gram = RowMatrix(both.select(*parts), (), a.p + b.p, is_complex).moments()
        both.unpersist()
        return n, gram[: a.p, : a.p], gram[a.p :, a.p :], gram[: a.p, a.p :]

    def _fit(self) -> None:
        p = self.params
        n, cxx, cyy, cxy = self._joint()
        for side, c, alpha in zip(self.sides, (cxx, cyy), p["alpha"], strict=True):
            if n < len(c):
                warnings.warn(f"{n} samples are fewer than {len(c)} features: whitening is not well defined", stacklevel=2)
            side.t, side.t_inv = whitening(c / n, alpha)
        tx, ty = self.sides[0].t, self.sides[1].t
        c = herm(tx) @ cxy @ ty / (n - 1)
        u, s, vt = np.linalg.svd(c, full_matrices=False)
        rank = len(s)
        k = p["n_modes"]
        if k == "all":
            k = rank
        elif isinstance(k, float):
            k = explained_modes(s**2, k, (s**2).sum())
        if k > rank:
            raise ValueError(f"{k} modes are more than the rank of the cross-covariance, {rank}")
        q1, q2 = u[:, :k], herm(vt)[:, :k]
        flip = signs(q2)
        q1, q2, s = q1 * flip, q2 * flip, s[:k]
        self.data.update(n_samples=n, cxx=cxx, cyy=cyy, cxy=cxy, components1=q1, components2=q2, singular_values=s, squared_covariance=s**2, total_squared_covariance=float((np.abs(cxy / (n - 1)) ** 2).sum()))
        self._projections(tx @ q1, ty @ q2)

    def _projections(self, w1: np.ndarray, w2: np.ndarray, norms: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Keep the matrices that make scores of principal components, and the scores' norms."""
        grams = self.data["cxx"], self.data["cyy"]
        size = [np.sqrt(np.real(np.einsum("ik,ij,jk->k", w.conj(), g, w))) for w, g in zip((w1, w2), grams, strict=True)]
        self.data.update(weights1=w1, weights2=w2, norm1=size[0] if norms is None else norms[0], norm2=size[1] if norms is None else norms[1])

    def unpersist(self):
        """Let go of the cached components of both sets."""
        for side in self.sides:
            if side.reduced is not None:
                side.reduced.df.unpersist()
        return self

    # -- scores and data ----------------------------------------------------------------------------------------------
    def _score_matrices(self, normalized: bool = False) -> list[RowMatrix]:
        data = self._ready()
        out = []
        for k, side in enumerate(self.sides, 1):
            if side.reduced is None:
                raise ValueError("the model was saved without its input: pass data to transform()")
            w = data[f"weights{k}"]
            out.append(side.reduced.times(w / data[f"norm{k}"] if normalized else w))
        return out

    def scores(self, normalized: bool = False) -> tuple[DataFrame, DataFrame]:
        a, b = self._score_matrices(normalized)
        return a.long(), b.long()

    def _pattern_pair(self, normalized: bool = True) -> list[np.ndarray]:
        data = self._ready()
        out = []
        for k, side in enumerate(self.sides, 1):
            q = data[f"components{k}"]
            out.append(side.physical(q if normalized else q * data[f"norm{k}"]))
        return out

    def components(self, normalized: bool = True) -> tuple:
        return tuple(s.preprocessor.components(v) for s, v in zip(self.sides, self._pattern_pair(normalized), strict=True))

    def transform(self, X=None, Y=None, normalized: bool = False):  # noqa: N803
        """Scores of further samples of either set or both."""
        data = self._ready()
        if X is None and Y is None:
            raise ValueError("give X, Y or both")
        out = []
        for k, (side, d) in enumerate(zip(self.sides, (X, Y), strict=True), 1):
            if d is not None:
                w = side.basis @ data[f"weights{k}"]
                out.append(side.preprocessor.transform(d).times(w / data[f"norm{k}"] if normalized else w).long())
        return out[0] if len(out) == 1 else out

    def inverse_transform(self, X: DataFrame | None = None, Y: DataFrame | None = None):  # noqa: N803
        """Data of either set or both from scores."""
        data = self._ready()
        if X is None and Y is None:
            raise ValueError("give X, Y or both")
        out = []
        for k, (side, d) in enumerate(zip(self.sides, (X, Y), strict=True), 1):
            if d is not None:
                q = data[f"components{k}"]
                m = to_matrix(d, side.preprocessor.sample_dims, "mode", q.shape[1], "re" in d.columns)
                back = herm(q) @ side.t_inv @ herm(side.basis)
                out.append(side.preprocessor.data(m.times(back), self._keeps_complex))
        return out[0] if len(out) == 1 else out

    _keeps_complex = True

    def predict(self, X) -> DataFrame:  # noqa: N803
        """Pseudo-scores of the second set from the first one."""
        data = self._ready()
        w1, w2 = data["weights1"], data["weights2"]
        size = np.real(np.einsum("ik,ij,jk->k", w1.conj(), data["cxx"], w1))
        g = herm(w1) @ data["cxy"] @ w2 / size
        side = self.sides[0]
        return side.preprocessor.transform(X).times(side.basis @ w1 @ g).long()

    # -- measures -----------------------------------------------------------------------------------------------------
    def singular_values(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["singular_values"])

    def squared_covariance(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["squared_covariance"])

    def _score_grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self._ready()
        w1, w2 = d["weights1"], d["weights2"]
        return herm(w1) @ d["cxx"] @ w1, herm(w2) @ d["cyy"] @ w2, herm(w1) @ d["cxy"] @ w2

    @staticmethod
    def _correlation(c: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        # deviations divide by n, covariances by n - 1
        sa, sb = (np.sqrt(np.real(np.diag(x)) / n) for x in (a, b))
        return c / (n - 1) / sa[:, None] / sb[None, :]

    def cross_correlation_coefficients(self) -> DataFrame:
        a, b, c = self._score_grams()
        return by_mode(self._session(), np.diag(self._correlation(c, a, b, self.data["n_samples"])).copy())

    def correlation_coefficients_X(self) -> DataFrame:
        a, _, _ = self._score_grams()
        return by_pair(self._session(), self._correlation(a, a, a, self.data["n_samples"]))

    def correlation_coefficients_Y(self) -> DataFrame:
        _, b, _ = self._score_grams()
        return by_pair(self._session(), self._correlation(b, b, b, self.data["n_samples"]))

    def _residuals(self, side: int, k: int) -> np.ndarray:
        """I - w q^H T^-1: what row-wise reconstruction by mode k leaves of the components."""
        d, s = self._ready(), self.sides[side]
        w, q = d[f"weights{side + 1}"][:, [k]], d[f"components{side + 1}"][:, [k]]
        return np.eye(len(w)) - w @ herm(q) @ s.t_inv

    def _modes(self) -> int:
        return self._ready()["components1"].shape[1]

    def _squared_covariance_fraction(self) -> np.ndarray:
        d = self._ready()
        out = []
        for k in range(self._modes()):
            left = herm(self._residuals(0, k)) @ d["cxy"] @ self._residuals(1, k) / (d["n_samples"] - 1)
            out.append(max(0.0, 1 - (np.abs(left) ** 2).sum() / d["total_squared_covariance"]))
        return np.array(out)

    def squared_covariance_fraction(self) -> DataFrame:
        return by_mode(self._session(), self._squared_covariance_fraction())

    def _own_fraction(self, side: int) -> np.ndarray:
        c = self._ready()["cxx" if side == 0 else "cyy"]
        total = np.real(np.trace(c))
        return np.array([1 - np.real(np.trace(herm(r) @ c @ r)) / total for r in (self._residuals(side, k) for k in range(self._modes()))])

    def fraction_variance_X_explained_by_X(self) -> DataFrame:
        return by_mode(self._session(), self._own_fraction(0))

    def fraction_variance_Y_explained_by_Y(self) -> DataFrame:
        return by_mode(self._session(), self._own_fraction(1))

    def fraction_variance_Y_explained_by_X(self) -> DataFrame:
        d = self._ready()
        n = d["n_samples"]
        root = matrix_power(d["cxx"] / (n - 1), -0.5)
        total = (np.abs(root @ d["cxy"] / (n - 1)) ** 2).sum()
        out = []
        for k in range(self._modes()):
            left = root @ herm(self._residuals(0, k)) @ d["cxy"] @ self._residuals(1, k) / (n - 1)
            out.append(1 - (np.abs(left) ** 2).sum() / total)
        return by_mode(self._session(), np.array(out))

    def _patterns_of(self, side: int, of: int, correction: str | None, alpha: float):
        """Correlation of every feature of `side` with every score of `of`, and p-values."""
        d, s = self._ready(), self.sides[side]
        n = d["n_samples"]
        own = d["cxx"] if side == 0 else d["cyy"]
        cross = own if side == of else (d["cxy"] if side == 0 else herm(d["cxy"]))
        w = d[f"weights{of + 1}"]
        other = d["cxx"] if of == 0 else d["cyy"]
        covariance = s.basis.conj() @ cross @ w / n
        spread = np.sqrt(np.maximum(np.real(np.einsum("ik,kl,il->i", s.basis.conj(), own, s.basis)) / n, 0))
        scale = np.sqrt(np.real(np.einsum("ik,ij,jk->k", w.conj(), other, w)) / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = covariance / spread[:, None] / scale
        r = np.where(np.isfinite(r), r, np.nan)
        p = p_values(np.abs(r), n)
        if correction:
            p = np.stack([corrected(p[:, k], correction, alpha) for k in range(p.shape[1])], axis=1)
        return s.preprocessor.components(r), s.preprocessor.components(p)

    def homogeneous_patterns(self, correction: str | None = None, alpha: float = 0.05):
        """((patterns of x, of y), (their p-values)): correlations of each set with its own scores."""
        (a, pa), (b, pb) = self._patterns_of(0, 0, correction, alpha), self._patterns_of(1, 1, correction, alpha)
        return (a, b), (pa, pb)

    def heterogeneous_patterns(self, correction: str | None = None, alpha: float = 0.05):
        """The same with the scores of the other set."""
        (a, pa), (b, pb) = self._patterns_of(0, 1, correction, alpha), self._patterns_of(1, 0, correction, alpha)
        return (a, b), (pa, pb)

    # -- storage ------------------------------------------------------------------------------------------------------
    def _parts(self, save_data: bool) -> dict:
        return {"sides": [s.state(save_data) for s in self.sides]}

    def _restore(self, parts: dict) -> None:
        self.sides = [Side.from_state(s, self.spark) for s in parts["sides"]]


class ComplexCPCCA(CPCCA):
    """For complex fields."""

    _complex = True

    def components_amplitude(self, normalized: bool = True) -> tuple:
        return tuple(s.preprocessor.components(np.abs(v)) for s, v in zip(self.sides, self._pattern_pair(normalized), strict=True))

    def components_phase(self, normalized: bool = True) -> tuple:
        return tuple(s.preprocessor.components(np.angle(v)) for s, v in zip(self.sides, self._pattern_pair(normalized), strict=True))

    def scores_amplitude(self, normalized: bool = False) -> tuple:
        return tuple(row_amplitude(m) for m in self._score_matrices(normalized))

    def scores_phase(self, normalized: bool = False) -> tuple:
        return tuple(row_phase(m) for m in self._score_matrices(normalized))


class HilbertCPCCA(ComplexCPCCA):
    """For the analytic signals of two real fields, made of their principal components."""

    _keeps_complex = False

    def __init__(self, n_modes=2, alpha=0.2, padding="exp", decay_factor=0.2, **params):
        super().__init__(n_modes, alpha=alpha, padding=pair("padding", padding), decay_factor=pair("decay_factor", decay_factor), **params)

    def _augment(self, m: RowMatrix, i: int) -> RowMatrix:
        return analytic_rows(m, self.params["padding"][i], self.params["decay_factor"][i])

    def transform(self, X=None, Y=None, normalized: bool = False):  # noqa: N803
        raise NotImplementedError("an analytic signal needs the whole series: Hilbert models do not transform")

    def predict(self, X):  # noqa: N803
        raise NotImplementedError("an analytic signal needs the whole series: Hilbert models do not predict")


class MCA(CPCCA):
    """Maximum covariance analysis."""

    _alpha = (1.0, 1.0)

    def covariance_fraction_CD95(self) -> DataFrame:
        """Each singular value's share of the sum of those kept."""
        s = np.sqrt(self._ready()["squared_covariance"])
        share = s / s.sum()
        if len(s) > 1 and share[-1] > 0.001:
            warnings.warn("the shares depend on the number of modes: use more", stacklevel=2)
        return by_mode(self._session(), share)


class ComplexMCA(ComplexCPCCA, MCA):
    """Maximum covariance analysis of complex fields."""

    _alpha = (1.0, 1.0)


class HilbertMCA(HilbertCPCCA, ComplexMCA):
    """Maximum covariance analysis of analytic signals."""

    _alpha = (1.0, 1.0)


class CCA(CPCCA):
    """Canonical correlation analysis."""

    _alpha = (0.0, 0.0)


class ComplexCCA(ComplexCPCCA, CCA):
    """Canonical correlation analysis of complex fields."""

    _alpha = (0.0, 0.0)


class HilbertCCA(HilbertCPCCA, ComplexCCA):
    """Canonical correlation analysis of analytic signals."""

    _alpha = (0.0, 0.0)


class RDA(CPCCA):
    """Redundancy analysis: only the first set is whitened."""

    _alpha = (0.0, 1.0)


class ComplexRDA(ComplexCPCCA, RDA):
    """Redundancy analysis of complex fields."""

    _alpha = (0.0, 1.0)


class HilbertRDA(HilbertCPCCA, ComplexRDA):
    """Redundancy analysis of analytic signals."""

    _alpha = (0.0, 1.0)
