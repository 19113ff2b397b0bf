"""Varimax and promax rotation of EOF models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.linalg import promax, rotation_inverse, signs
from ..plans.matrix import RowMatrix
from .base import by_pair, matrix_from, matrix_state
from .single import EOF, ComplexEOF, HilbertEOF


class EOFRotator(EOF):
    """Rotates the loadings (patterns times the root of their variance) of a fitted model; modes are ordered by rotated variance.

    power=1 is varimax, more is promax.
    """

    def __init__(self, n_modes=2, power=1, max_iter=None, rtol=1e-8, compute=True, **params):
        super().__init__(n_modes, power=power, max_iter=1000 if max_iter is None else max_iter, rtol=rtol, compute=compute, **params)

    def fit(self, model: EOF):
        """Rotate a fitted model."""
        return self._run(lambda: self._rotate(model))

    def fit_transform(self, *args, **kwargs):
        raise NotImplementedError("a rotator is fitted to a model, not to data")

    def _rotate(self, model: EOF) -> None:
        old, p = model._ready(), self.params
        self.preprocessor, self.spark, self.input = model.preprocessor, model.spark, model.input
        k = min(p["n_modes"], len(old["norms"]))
        v, s, variance = old["components"][:, :k], old["norms"][:k], old["explained_variance"][:k]
        loadings, turn, phi = promax(v * np.sqrt(variance), p["power"], p["max_iter"], p["rtol"])
        rotated = (np.abs(loadings) ** 2).sum(axis=0)
        parts = loadings / np.sqrt(rotated)
        norms = np.sqrt(rotated * (old["n_samples"] - 1))
        sign = signs(parts)
        back = rotation_inverse(turn, p["power"])
        order = np.argsort(-rotated, kind="stable")
        # X V / s, turned, scaled and signed: one matrix in feature space
        self.data.update(
            components=(parts * sign)[:, order], norms=norms[order], explained_variance=rotated[order], total_variance=old["total_variance"], n_samples=old["n_samples"],
            rotation_matrix=turn, phi_matrix=phi, projection=((v / s) @ back * norms * sign)[:, order],
        )

    def _project(self, m: RowMatrix) -> RowMatrix:
        return m.times(self.data["projection"])

    def rotation_matrix(self) -> DataFrame:
        return by_pair(self._session(), self._ready()["rotation_matrix"])

    def phi_matrix(self) -> DataFrame:
        """Correlations of the rotated factors: the identity for varimax."""
        return by_pair(self._session(), self._ready()["phi_matrix"])

    def _parts(self, save_data: bool) -> dict:
        return {"preprocessor": self.preprocessor.state(), "input": matrix_state(self.input, save_data)}

    def _restore(self, parts: dict) -> None:
        super()._restore(parts)
        self.input = matrix_from(parts["input"])


class ComplexEOFRotator(EOFRotator, ComplexEOF):
    """For ComplexEOF."""


class HilbertEOFRotator(EOFRotator, HilbertEOF):
    """For HilbertEOF; does not transform."""

    def __init__(self, n_modes=2, power=1, max_iter=None, rtol=1e-8, compute=True, **params):
        params.pop("padding", None), params.pop("decay_factor", None)
        ComplexEOF.__init__(self, n_modes, power=power, max_iter=1000 if max_iter is None else max_iter, rtol=rtol, compute=compute, **params)

    transform = HilbertEOF.transform


class RotatorFactory:
    """The rotator that belongs to a model."""

    def __init__(self, **params):
        self.params = params

    def create_rotator(self, model):
        from . import cross, cross_rotator

        known = {
            EOF: EOFRotator, ComplexEOF: ComplexEOFRotator, HilbertEOF: HilbertEOFRotator,
            cross.CPCCA: cross_rotator.CPCCARotator, cross.ComplexCPCCA: cross_rotator.ComplexCPCCARotator, cross.HilbertCPCCA: cross_rotator.HilbertCPCCARotator,
            cross.MCA: cross_rotator.MCARotator, cross.ComplexMCA: cross_rotator.ComplexMCARotator, cross.HilbertMCA: cross_rotator.HilbertMCARotator,
        }
        if type(model) not in known:
            raise TypeError(f"no rotator for {type(model).__name__}")
        return known[type(model)](**self.params)
