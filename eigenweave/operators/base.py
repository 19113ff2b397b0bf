"""What all models share: parameters, lazy fitting, results by name, storage."""

from __future__ import annotations

import datetime
import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..plans.field import as_dims
from ..plans.matrix import RowMatrix, to_matrix
from ..plans.preprocess import Preprocessor
from ..plans.svd import check_modes
from ..sources.store import read_state, write_state

VERSION = "0.1.0"


class Results(dict):
    """Results by name."""

    def __missing__(self, key):
        raise KeyError(f"no result {key!r}: fit the model first")


def small(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A table the driver holds: integer and double columns; a complex column becomes `re` and `im`."""
    table, fields = {}, []
    for name, v in columns.items():
        v = np.asarray(v)
        parts = [("re", v.real), ("im", v.imag)] if np.iscomplexobj(v) else [(name, v)]
        for n, x in parts:
            whole = np.issubdtype(x.dtype, np.integer)
            table[n] = pa.array(x.astype(np.int32) if whole else x.astype(float))
            fields.append(StructField(n, IntegerType() if whole else DoubleType()))
    return spark.createDataFrame(pa.table(table), StructType(fields))


def by_mode(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return small(spark, mode=np.arange(1, len(values) + 1), value=values)


def by_pair(spark: SparkSession, m: np.ndarray) -> DataFrame:
    rows, cols = m.shape
    return small(spark, mode_m=np.repeat(np.arange(1, rows + 1), cols), mode_n=np.tile(np.arange(1, cols + 1), rows), value=m.ravel())


class Model:
    """Parameters in `params`, driver results in `data`.

    With `compute=False` a fit is only prepared; the first accessor, or `compute()`, runs it. Parameters that no class of the model has are an error.
    """

    def __init__(self, **params):
        known = {n for c in type(self).__mro__ if "__init__" in vars(c) for n in inspect.signature(c.__init__).parameters}
        if odd := sorted(set(params) - known):
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(odd)}")
        self.params = params
        self.data = Results()
        self.attrs = {"model": type(self).__name__, "version": VERSION, "date": datetime.datetime.now().isoformat(timespec="seconds")}
        self.spark: SparkSession | None = None
        self._todo: Callable[[], None] | None = None

    def get_params(self) -> dict:
        return dict(self.params)

    def _run(self, work: Callable[[], None]):
        self._todo = work
        if self.params.get("compute", True):
            self.compute()
        return self

    def compute(self):
        """Run what is still to be done."""
        if self._todo is not None:
            work, self._todo = self._todo, None
            work()
        return self

    def _ready(self) -> Results:
        self.compute()
        if not self.data:
            raise ValueError("fit the model first")
        return self.data

    # -- storage ------------------------------------------------------------------------------------------------------
    def serialize(self, save_data: bool = False) -> dict:
        """The model as nested dicts of scalars, arrays and DataFrames. The input is a placeholder unless `save_data`."""
        self._ready()
        params = {k: v for k, v in self.params.items() if not callable(v)}
        return {"class": type(self).__name__, "params": params, "attrs": self.attrs, "data": dict(self.data), "parts": self._parts(save_data)}

    def _parts(self, save_data: bool) -> dict:
        return {}

    def _restore(self, parts: dict) -> None:
        pass

    def save(self, path: str, overwrite: bool = False, save_data: bool = False, engine: str = "parquet") -> None:
        """Write the model; without `save_data` the input is left out and only new data can be transformed."""
        if engine != "parquet":
            raise ValueError(f"models are stored as parquet, not {engine!r}")
        write_state(self._session(), self.serialize(save_data), path, overwrite)

    def _session(self) -> SparkSession:
        self._ready()
        return self.spark

    @classmethod
    def deserialize(cls, state: dict, spark: SparkSession):
        if state["class"] != cls.__name__:
            raise ValueError(f"a saved {state['class']} is no {cls.__name__}")
        out = cls(**{k: tuple(v) if isinstance(v, list) and k in cls._tuples else v for k, v in state["params"].items()})
        out.spark, out.attrs = spark, state["attrs"]
        out.data = Results(state["data"])
        out._restore(state["parts"])
        return out

    _tuples: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None):
        spark = spark or SparkSession.getActiveSession()
        return cls.deserialize(read_state(spark, path), spark)


def matrix_state(m: RowMatrix | None, save: bool):
    if m is None or not save:
        return {"placeholder": True}
    return {"df": m.df, "keys": m.keys, "p": m.p, "is_complex": m.is_complex}


def matrix_from(state: dict) -> RowMatrix | None:
    return None if state.get("placeholder") else RowMatrix(state["df"], tuple(state["keys"]), state["p"], state["is_complex"])


class SingleSet(Model):
    """A model of one data set: preprocessing, patterns by feature, scores by sample."""

    def __init__(self, n_modes=2, center=True, standardize=False, use_coslat=False, check_nans=True, compute=True, random_state=None, solver="auto", solver_kwargs=None, **more):
        check_modes(n_modes)
        super().__init__(n_modes=n_modes, center=center, standardize=standardize, use_coslat=use_coslat, check_nans=check_nans, compute=compute, random_state=random_state, solver=solver, solver_kwargs=dict(solver_kwargs or {}), **more)
        self.preprocessor = Preprocessor(center, standardize, use_coslat, check_nans)
        self.input: RowMatrix | None = None

    def fit(self, X, dim, weights=None):  # noqa: N803
        """Fit to a field, a DataFrame or a list of these; `dim` names the sample dims, all other dims are features."""
        dims = as_dims(dim)

        def work():
            m = self.preprocessor.fit(X, dims, weights)
            self.spark = self.preprocessor.spark
            self.input = m.persist()
            self._fit(self.input)

        return self._run(work)

    def unpersist(self):
        """Let go of the cached matrix and of cached results."""
        for df in (self.input and self.input.df, getattr(self, "_result", None)):
            if df is not None:
                df.unpersist()
        return self

    def fit_transform(self, X, dim, weights=None, **kwargs):  # noqa: N803
        return self.fit(X, dim, weights).transform(X, **kwargs)

    def _fit(self, m: RowMatrix) -> None:
        raise NotImplementedError

    def _project(self, m: RowMatrix) -> RowMatrix:
        raise NotImplementedError(f"{type(self).__name__} does not transform")

    def _rebuild(self, scores: RowMatrix, modes: slice) -> RowMatrix:
        raise NotImplementedError(f"{type(self).__name__} does not invert")

    def _scaled(self, m: RowMatrix, by: np.ndarray) -> RowMatrix:
        return m.times(np.diag(by))

    def transform(self, x, normalized: bool = False) -> DataFrame:
        """Scores of further samples, long: sample dims, mode, value."""
        data = self._ready()
        m = self._project(self.preprocessor.transform(x))
        return (self._scaled(m, 1 / data["norms"]) if normalized else m).long()

    def inverse_transform(self, scores: DataFrame, normalized: bool = False):
        """Data from scores (sample dims, mode, value or re and im) of any of the modes."""
        data = self._ready()
        is_complex = "re" in scores.columns
        m = to_matrix(scores, self.preprocessor.sample_dims, "mode", len(data["norms"]), is_complex)
        if normalized:
            m = self._scaled(m, data["norms"])
        return self.preprocessor.data(self._rebuild(m, slice(None)), self._keeps_complex)

    _keeps_complex = True

    def _patterns(self, normalized: bool) -> np.ndarray:
        data = self._ready()
        return data["components"] if normalized else data["components"] * data["norms"]

    def _score_matrix(self, normalized: bool) -> RowMatrix:
        data = self._ready()
        m = self._own_scores()
        return self._scaled(m, 1 / data["norms"]) if normalized else m

    def _own_scores(self) -> RowMatrix:
        if self.input is None:
            raise ValueError("the model was saved without its input: pass data to transform()")
        return self._project(self.input)

    def components(self, normalized: bool = True):
        """Patterns, long: feature dims, mode, value; one table a field."""
        return self.preprocessor.components(self._patterns(normalized))

    def scores(self, normalized: bool = False) -> DataFrame:
        return self._score_matrix(normalized).long()

    def _parts(self, save_data: bool) -> dict:
        return {"preprocessor": self.preprocessor.state(), "input": matrix_state(self.input, save_data)}

    def _restore(self, parts: dict) -> None:
        self.preprocessor = Preprocessor.from_state(parts["preprocessor"], self.spark)
        self.input = matrix_from(parts["input"])


def amplitude_phase(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.abs(v), np.angle(v)


def row_amplitude(m: RowMatrix) -> DataFrame:
    """Moduli of a complex matrix, long."""
    return m.long().select(*m.keys, "mode", F.hypot("re", "im").alias("value"))


def row_phase(m: RowMatrix) -> DataFrame:
    return m.long().select(*m.keys, "mode", F.atan2("im", "re").alias("value"))
