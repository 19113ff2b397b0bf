"""Varimax and promax rotation of models of two fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.linalg import herm, promax, rotation_inverse, signs
from .base import by_pair
from .cross import CPCCA, MCA, ComplexCPCCA, ComplexMCA, HilbertCPCCA, HilbertMCA


class CPCCARotator(CPCCA):
    """Rotates the singular vectors of both sets together, in feature space and times the root of the singular values; modes are ordered by squared covariance."""

    def __init__(self, n_modes=10, power=1, max_iter=None, rtol=1e-8, compute=True, **params):
        params = {k: v for k, v in params.items() if k not in ("alpha", "padding", "decay_factor")}
        CPCCA.__init__(self, n_modes, compute=compute, power=power, max_iter=1000 if max_iter is None else max_iter, rtol=rtol, **params)

    def fit(self, model: CPCCA):
        """Rotate a fitted model."""
        return self._run(lambda: self._rotate(model))

    def _rotate(self, model: CPCCA) -> None:
        old, p = model._ready(), self.params
        self.sides, self.spark = model.sides, model.spark
        k = min(p["n_modes"], len(old["singular_values"]))
        root = np.sqrt(old["singular_values"][:k])
        q = [old[f"components{i}"][:, :k] for i in (1, 2)]
        loadings, turn, phi = promax(np.concatenate([s.physical(v) for s, v in zip(self.sides, q, strict=True)]) * root, p["power"], p["max_iter"], p["rtol"])
        cut = len(self.sides[0].basis)
        back = [herm(s.t) @ (herm(s.basis) @ part) for s, part in zip(self.sides, (loadings[:cut], loadings[cut:]), strict=True)]
        norms = [np.linalg.norm(v, axis=0) for v in back]
        squared = (norms[0] * norms[1]) ** 2
        sign, order = signs(loadings), np.argsort(-squared, kind="stable")
        inverse = rotation_inverse(turn, p["power"])
        weights = [(s.t @ v / root) @ inverse * n * sign for s, v, n in zip(self.sides, q, norms, strict=True)]
        parts = [v / n * sign for v, n in zip(back, norms, strict=True)]
        self.data.update(
            n_samples=old["n_samples"], cxx=old["cxx"], cyy=old["cyy"], cxy=old["cxy"], total_squared_covariance=old["total_squared_covariance"], singular_values=old["singular_values"],
            components1=parts[0][:, order], components2=parts[1][:, order], squared_covariance=squared[order], rotation_matrix=turn, phi_matrix=phi,
        )
        self._projections(weights[0][:, order], weights[1][:, order], (norms[0][order], norms[1][order]))

    def rotation_matrix(self) -> DataFrame:
        return by_pair(self._session(), self._ready()["rotation_matrix"])

    def phi_matrix(self) -> DataFrame:
        return by_pair(self._session(), self._ready()["phi_matrix"])


class ComplexCPCCARotator(CPCCARotator, ComplexCPCCA):
    """For ComplexCPCCA."""


class HilbertCPCCARotator(CPCCARotator, HilbertCPCCA):
    """For HilbertCPCCA; does not transform."""


class MCARotator(CPCCARotator, MCA):
    """For MCA."""


class ComplexMCARotator(ComplexCPCCARotator, ComplexMCA):
    """For ComplexMCA."""


class HilbertMCARotator(HilbertCPCCARotator, HilbertMCA):
    """For HilbertMCA; does not transform."""
