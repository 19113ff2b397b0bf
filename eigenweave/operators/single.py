"""Empirical orthogonal functions of real, complex and analytic data."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame

from ..plans.matrix import RowMatrix
from ..plans.series import analytic_rows
from ..plans.svd import decompose
from .base import SingleSet, by_mode, row_amplitude, row_phase


class EOF(SingleSet):
    """Principal components: patterns V of unit length, scores X V, variances s^2 / (n - 1).

    A mode's sign makes its pattern's greatest entry in modulus positive. Components are the same on any partitioning up to rounding.
    """

    def _augment(self, m: RowMatrix) -> RowMatrix:
        return m

    def _fit(self, m: RowMatrix) -> None:
        own = self._augment(m)
        if own is not m:
            self.input = own = own.persist()
        p = self.params
        d = decompose(own, p["n_modes"], solver=p["solver"], random_state=p["random_state"], **p["solver_kwargs"])
        self.data.update(components=d.v, norms=d.s, explained_variance=d.variance, total_variance=d.total, n_samples=d.n)

    def _project(self, m: RowMatrix) -> RowMatrix:
        return m.times(self.data["components"])

    def _rebuild(self, scores: RowMatrix, modes: slice) -> RowMatrix:
        return scores.times(self.data["components"].conj().T)

    def singular_values(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["norms"])

    def explained_variance(self) -> DataFrame:
        return by_mode(self._session(), self._ready()["explained_variance"])

    def explained_variance_ratio(self) -> DataFrame:
        data = self._ready()
        return by_mode(self._session(), data["explained_variance"] / data["total_variance"])


class ComplexEOF(EOF):
    """EOF of complex fields (`re` and `im` columns)."""

    def _fit(self, m: RowMatrix) -> None:
        if not m.is_complex and type(self) is ComplexEOF:
            warnings.warn("the data are real: EOF is meant for these", stacklevel=2)
        super()._fit(m)

    def components_amplitude(self, normalized: bool = True):
        return self.preprocessor.components(np.abs(self._patterns(normalized)))

    def components_phase(self):
        return self.preprocessor.components(np.angle(self._patterns(True)))

    def scores_amplitude(self, normalized: bool = True) -> DataFrame:
        return row_amplitude(self._score_matrix(normalized))

    def scores_phase(self) -> DataFrame:
        return row_phase(self._score_matrix(False))


class HilbertEOF(ComplexEOF):
    """EOF of the analytic signal along the order of the samples. It reconstructs real data and does not transform."""

    _keeps_complex = False

    def __init__(self, n_modes=2, padding="exp", decay_factor=0.2, **params):
        super().__init__(n_modes, padding=padding, decay_factor=decay_factor, **params)

    def _augment(self, m: RowMatrix) -> RowMatrix:
        return analytic_rows(m, self.params["padding"], self.params["decay_factor"])

    def transform(self, x, normalized: bool = False):
        raise NotImplementedError("an analytic signal needs the whole series: HilbertEOF does not transform")
