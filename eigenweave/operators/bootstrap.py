"""Bootstrap of EOF models: how certain variances, patterns and scores are.

A replicate draws as many samples as there are, with replacement. Draws are made block by block: the seed gives each block of rows its
number of draws, a block's own stream gives its rows theirs, so no list of all rows is drawn on the driver. All replicates' weighted products come from one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import signs
from ..plans.matrix import MOST_GRAM, RowMatrix, X, block, tasks, to_matrix, tree
from ..plans.order import SID, indexed
from .base import Model, small
from .single import EOF

ROWS = 8192


class EOFBootstrapper(Model):
    """Replicates of an EOF model along a further dim `n`."""

    def __init__(self, n_bootstraps=20, seed=None, compute=True):
        super().__init__(n_bootstraps=n_bootstraps, seed=seed, compute=compute)
        self.model: EOF | None = None

    def fit(self, model: EOF):
        """Resample the data of a fitted EOF."""
        return self._run(lambda: self._resample(model))

    def _resample(self, model: EOF) -> None:
        base = model._ready()
        if model.input is None:
            raise ValueError("the model was saved without its input")
        m, reps = model.input, self.params["n_bootstraps"]
        if m.is_complex:
            raise TypeError("a bootstrap is made of real data")
        if m.p > MOST_GRAM:
            raise ValueError(f"a bootstrap takes at most {MOST_GRAM} features; reduce them first")
        self.model, self.spark = model, model.spark
        n, k = base["n_samples"], len(base["norms"])
        seed = self.params["seed"]
        seed = int(np.random.default_rng(seed).integers(2**31)) if seed is None else seed
        placed = indexed(m.rows(), m.keys).select(F.floor(F.col(SID) / ROWS).alias("__b"), SID, X).persist()
        sizes = np.full(-(-n // ROWS), ROWS)
        sizes[-1] = n - ROWS * (len(sizes) - 1)
        draws = np.random.default_rng(seed).multinomial(n, sizes / n, size=reps)
        at_once = max(1, (64 << 20) // (8 * m.p * m.p))
        grams, means = np.zeros((reps, m.p, m.p)), np.zeros((reps, m.p))
        for first in range(0, reps, at_once):
            for r, g, s in self._pass(placed, m.p, draws, seed, range(first, min(reps, first + at_once))):
                grams[r], means[r] = g, s
        placed.unpersist()
        parts, variance, totals, norms = np.zeros((reps, m.p, k)), np.zeros((reps, k)), np.zeros(reps), np.zeros((reps, k))
        v0, gram0 = base["components"], None
        for r in range(reps):
            cov = (grams[r] - np.outer(means[r], means[r]) / n) / (n - 1)
            values, vectors = np.linalg.eigh((cov + cov.T) / 2)
            v = vectors[:, ::-1][:, :k]
            v = v * signs(v)
            variance[r], totals[r] = np.maximum(values[::-1][:k], 0), np.trace(cov)
            norms[r] = np.sqrt(variance[r] * (n - 1))
            parts[r] = v
        _, gram0 = m.moments()
        for r in range(reps):  # signs by the correlation with the scores of the model
            agree = np.sign(np.einsum("ik,ij,jk->k", parts[r], gram0, v0))
            parts[r] *= np.where(agree == 0, 1, agree)
        self.data.update(components=parts, explained_variance=variance, total_variance=totals, norms=base["norms"], n_samples=n)

    @staticmethod
    def _pass(placed: DataFrame, p: int, draws: np.ndarray, seed: int, which: range):
        which = list(which)

        def weigh(key, t):
            t = t.combine_chunks().sort_by(SID)
            x = block(t.to_batches()[0], p, False)
            b = int(key[0].as_py())
            out = []
            for r in which:
                rng = np.random.default_rng([seed, r, b])
                times = np.bincount(rng.integers(0, len(x), draws[r, b]), minlength=len(x)).astype(float)
                out.append(np.concatenate([(x.T @ (times[:, None] * x)).ravel(), times @ x]).tobytes())
            return pa.table({"r": pa.array(which, pa.int32()), "part": pa.array(out, pa.binary())})

        def fold(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for q in b.to_pylist():
                    v = np.frombuffer(q["part"])
                    sums[q["r"]] = v if q["r"] not in sums else sums[q["r"]] + v
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array([TaskContext.get().partitionId()] * len(sums), pa.int64())], names=["r", "part", "task"])

        def add(t):
            out = sum(np.frombuffer(v.as_py()) for v in t.column("part"))
            return pa.table({"r": t.column("r")[:1], "part": pa.array([out.tobytes()], pa.binary())})

        kind = "r int, part binary"
        weighed = placed.groupBy("__b").applyInArrow(weigh, kind)
        for q in tree(weighed.mapInArrow(fold, f"{kind}, task long"), tasks(weighed), "r", add, kind).collect():  # a small matrix a replicate
            v = np.frombuffer(q["part"])
            yield q["r"], v[: p * p].reshape(p, p), v[p * p :]

    def _by_n(self, v: np.ndarray) -> DataFrame:
        reps, k = v.shape
        return small(self._session(), n=np.repeat(np.arange(1, reps + 1), k), mode=np.tile(np.arange(1, k + 1), reps), value=v.ravel())

    def explained_variance(self) -> DataFrame:
        return self._by_n(self._ready()["explained_variance"])

    def explained_variance_ratio(self) -> DataFrame:
        data = self._ready()
        return self._by_n(data["explained_variance"] / data["total_variance"][:, None])

    def singular_values(self) -> DataFrame:
        data = self._ready()
        return self._by_n(np.sqrt(data["explained_variance"] * (data["n_samples"] - 1)))

    def components(self, normalized: bool = True):
        data = self._ready()
        v = data["components"] if normalized else data["components"] * data["norms"]
        reps, p, k = v.shape
        labels = {"n": np.repeat(np.arange(1, reps + 1), k), "mode": np.tile(np.arange(1, k + 1), reps)}
        return self.model.preprocessor.components(np.moveaxis(v, 0, 1).reshape(p, reps * k), labels)

    def scores(self, normalized: bool = False) -> DataFrame:
        """The model's own samples projected on every replicate: sample dims, n, mode, value."""
        data = self._ready()
        reps, p, k = data["components"].shape
        v = data["components"] / (data["norms"] if normalized else 1)
        return self._by_replicate(self.model.input.times(np.moveaxis(v, 0, 1).reshape(p, reps * k)), k)

    def fit_transform(self, model: EOF, x, normalized: bool = False) -> DataFrame:
        """Fit to a model and project data on every replicate."""
        return self.fit(model).transform(x, normalized)

    def transform(self, x, normalized: bool = False) -> DataFrame:
        """Scores of further samples on every replicate: sample dims, n, mode, value."""
        data = self._ready()
        reps, p, k = data["components"].shape
        v = data["components"] / (data["norms"] if normalized else 1)
        return self._by_replicate(self.model.preprocessor.transform(x).times(np.moveaxis(v, 0, 1).reshape(p, reps * k)), k)

    def inverse_transform(self, scores: DataFrame, normalized: bool = False):
        """Data from the scores of every replicate (sample dims, n, mode, value): a table with the further dim n, or one a field."""
        data, keys = self._ready(), self.model.preprocessor.sample_dims
        reps, p, k = data["components"].shape
        v = data["components"] * (data["norms"] if normalized else 1)
        placed = scores.select(*keys, ((F.col("n") - 1) * k + F.col("mode")).cast("int").alias("mode"), "value")
        m = to_matrix(placed, keys, "mode", reps * k, False)
        out = []
        for r in range(reps):
            only = np.zeros((reps * k, p))
            only[r * k : (r + 1) * k] = v[r].T
            got = self.model.preprocessor.data(m.times(only))
            fields = got if isinstance(got, list) else [got]
            fields = [f.withColumn("n", F.lit(r + 1)) for f in fields]
            out = fields if not out else [a.unionByName(b) for a, b in zip(out, fields, strict=True)]
        return out if isinstance(got, list) else out[0]

    def _by_replicate(self, m: RowMatrix, k: int) -> DataFrame:
        number = F.col("__k") - 1
        return m.long("__k").select(*self.model.preprocessor.sample_dims, (F.floor(number / k) + 1).cast("int").alias("n"), (number % k + 1).cast("int").alias("mode"), "value")

    def _parts(self, save_data: bool) -> dict:
        return {"model": self.model.serialize(save_data)}

    def _restore(self, parts: dict) -> None:
        self.model = EOF.deserialize(parts["model"], self.spark)
