"""A matrix dealt out by rows, and the passes over it.

A row is its key columns, a dense array `x` and, for complex data, its imaginary part `xi`; a row whose cells were all
missing has a null array and takes part in nothing. All sums are of bounded size: p x l matrices that the
driver holds, added up within tasks and then across tasks as a tree: by chunks, FAN parts of a chunk at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

X, XI = "__x", "__xi"
ROWS, CHUNK_BYTES = 4096, 4 << 20
#: Parts that one task of a sum adds up at most; more tasks than that add up in levels.
FAN = 32
#: No job has more tasks than this; a plan that does not tell its size gets as many levels.
MOST_TASKS = 1 << 18
#: A Gram matrix of at most so many columns is summed whole (128 MB); wider matrices are sketched.
MOST_GRAM = 4096


def block(batch: pa.RecordBatch, p: int, is_complex: bool) -> np.ndarray:
    """Dense rows of an Arrow batch without nulls."""

    def part(name):
        a = batch.column(batch.schema.get_field_index(name))
        return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), p)

    return part(X) + 1j * part(XI) if is_complex else part(X)


def arrays(m: np.ndarray, is_complex: bool) -> list[pa.Array]:
    """Array columns of the rows of m."""

    def part(v):
        v = np.ascontiguousarray(v, np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))

    return [part(m.real), part(m.imag)] if is_complex else [part(m)]


def slices(batches, most: int = ROWS):
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def tasks(df: DataFrame) -> int:
    """How many tasks will compute df, as far as its plan tells: the partitions it ends in, else those its size makes."""
    plan = df._jdf.queryExecution()
    physical = plan.executedPlan()
    if physical.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        physical = physical.initialPlan()
    known = physical.outputPartitioning().numPartitions()
    if known:
        return min(known, MOST_TASKS)
    per = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(1, min(MOST_TASKS, int(str(plan.optimizedPlan().stats().sizeInBytes())) // per))


def tree(parts: DataFrame, n: int, by: str, add: Callable, schema: str) -> DataFrame:
    """One row for each value of `by`: parts of n tasks (column `task`), added up by `add`, a function of an Arrow table, FAN tasks' at a time."""
    while n > FAN:
        n = -(-n // FAN)
        up = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("long"))

        def level(key, t):
            return add(t.drop_columns("task")).append_column("task", t.column("task")[:1])

        parts = up.groupBy(by, "task").applyInArrow(level, f"{schema}, task long")
    return parts.drop("task").groupBy(by).applyInArrow(add, schema)


def total(df: DataFrame, shape: tuple[int, ...], work: Callable, dtype=np.float64) -> np.ndarray:
    """Sum over all batches of `work(batch)`, arrays of `shape`; tasks add up their own, then chunks are added across tasks."""
    size = int(np.prod(shape)) if shape else 1
    width = max(1, CHUNK_BYTES // np.dtype(dtype).itemsize)

    def run(batches):
        out, task = None, TaskContext.get().partitionId()
        for b in slices(batches):
            if b.num_rows:
                add = work(b)
                out = add.astype(dtype) if out is None else out + add
        if out is not None:
            flat = np.ascontiguousarray(out, dtype).ravel()
            cuts = range(0, size, width)
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int64()), pa.array([flat[c : c + width].tobytes() for c in cuts], pa.binary()), pa.array([task] * len(cuts), pa.int64())], names=["at", "part", "task"])

    def add(t):
        out = None
        for part in t.column("part"):
            v = np.frombuffer(part.as_py(), dtype)
            out = v.copy() if out is None else out + v
        return pa.table({"at": t.column("at")[:1], "part": pa.array([out.tobytes()], pa.binary())})

    parts = tree(df.mapInArrow(run, "at long, part binary, task long"), tasks(df), "at", add, "at long, part binary").collect()  # size of `shape`
    out = np.zeros(size, dtype)
    for r in parts:
        v = np.frombuffer(r["part"], dtype)
        out[r["at"] : r["at"] + len(v)] = v
    return out.reshape(shape)


@dataclass
class RowMatrix:
    df: DataFrame
    keys: tuple[str, ...]
    p: int
    is_complex: bool = False

    @property
    def dtype(self):
        return np.complex128 if self.is_complex else np.float64

    def rows(self) -> DataFrame:
        return self.df.where(F.col(X).isNotNull())

    def only(self) -> DataFrame:
        return self.rows().select(X, *([XI] if self.is_complex else []))

    def count(self) -> int:
        return self.rows().count()

    def persist(self) -> RowMatrix:
        self.df = self.df.persist()
        return self

    def schema(self, p: int | None = None, extra: Sequence[str] = ()) -> StructType:
        kinds = {f.name: f for f in self.df.schema.fields}
        more = [StructField(c, ArrayType(DoubleType())) for c in (X, *([XI] if self.is_complex else []))]
        return StructType([*[StructField(k, kinds[k].dataType) for k in (*self.keys, *extra)], *more])

    def moments(self) -> tuple[int, np.ndarray]:
        """Number of rows and X^H X."""
        p, is_complex = self.p, self.is_complex

        def work(b):
            m = block(b, p, is_complex)
            out = np.empty((p + 1, p), m.dtype)
            out[:p], out[p] = m.conj().T @ m, len(m)
            return out

        out = total(self.only(), (p + 1, p), work, self.dtype)
        return int(round(out[p, 0].real)) if p else 0, out[:p]

    def back_and_forth(self, q: np.ndarray) -> np.ndarray:
        """X^H (X q)."""
        p, is_complex = self.p, self.is_complex

        def work(b):
            m = block(b, p, is_complex)
            return m.conj().T @ (m @ q)

        return total(self.only(), q.shape, work, self.dtype)

    def small_gram(self, q: np.ndarray) -> tuple[int, np.ndarray, float]:
        """Rows, (X q)^H (X q), and the sum of squares of X."""
        p, is_complex, k = self.p, self.is_complex, q.shape[1]

        def work(b):
            m = block(b, p, is_complex)
            y = m @ q
            out = np.empty((k + 1, k), np.complex128)
            out[:k], out[k] = y.conj().T @ y, (np.abs(m) ** 2).sum() + 1j * len(m)
            return out

        out = total(self.only(), (k + 1, k), work, np.complex128)
        gram = out[:k] if self.is_complex or np.iscomplexobj(q) else out[:k].real
        return int(round(out[k, 0].imag)), gram, float(out[k, 0].real)

    def times(self, v: np.ndarray, extra: Sequence[str] = ()) -> RowMatrix:
        """X v, row by row; rows that take no part stay so."""
        p, is_complex, keys = self.p, self.is_complex, (*self.keys, *extra)
        becomes = is_complex or np.iscomplexobj(v)
        out = RowMatrix(self.df, self.keys, v.shape[1], becomes)

        def run(batches):
            for b in slices(batches):
                known = b.column(b.schema.get_field_index(X)).is_valid()
                own = b.filter(known)
                cols = arrays(block(own, p, is_complex) @ v, becomes)
                if own.num_rows < b.num_rows:
                    at = np.cumsum(known.to_numpy(zero_copy_only=False)) - 1
                    at = pa.array(at, pa.int64(), mask=~known.to_numpy(zero_copy_only=False))
                    cols = [c.take(at) for c in cols]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], *cols], names=[*keys, X, *([XI] if becomes else [])])

        cols = [*keys, X, *([XI] if is_complex else [])]
        out.df = self.df.select(*cols).mapInArrow(run, out.schema(extra=extra))
        return out

    def long(self, column: str = "mode", first: int = 1, scale: np.ndarray | None = None) -> DataFrame:
        """Keys, a 1-based number and `value` (or `re`, `im`); a row that takes no part gives nulls."""
        empty = lambda: F.array_repeat(F.lit(None).cast("double"), self.p)
        x = F.coalesce(F.col(X), empty())
        if self.is_complex:
            cells = F.arrays_zip(x.alias("re"), F.coalesce(F.col(XI), empty()).alias("im"))
            return self.df.select(*self.keys, F.posexplode(cells).alias("__k", "__v")).select(*self.keys, (F.col("__k") + first).cast("int").alias(column), F.col("__v.re").alias("re"), F.col("__v.im").alias("im"))
        return self.df.select(*self.keys, F.posexplode(x).alias("__k", "value")).select(*self.keys, (F.col("__k") + first).cast("int").alias(column), "value")


def to_matrix(df: DataFrame, keys: Sequence[str], number: str, k: int, is_complex: bool) -> RowMatrix:
    """Long scores (keys, 1-based number, value or re, im) as a matrix of k columns; absent numbers are 0."""
    cells = F.struct(F.col(number).cast("int").alias("k"), F.col("re" if is_complex else "value").alias("a"), *([F.col("im").alias("b")] if is_complex else []))
    packed = df.groupBy(*keys).agg(F.collect_list(F.when(F.col("re" if is_complex else "value").isNotNull(), cells)).alias("__c"))
    by = F.map_from_entries(F.transform("__c", lambda c: F.struct(c["k"], c["a"])))
    slots = F.sequence(F.lit(1), F.lit(k))
    x = F.transform(slots, lambda j: F.coalesce(F.element_at(by, j), F.lit(0.0)))
    some = F.size("__c") > 0
    out = packed.select(*keys, F.when(some, x).alias(X), *([F.when(some, F.transform(slots, lambda j: F.coalesce(F.element_at(F.map_from_entries(F.transform("__c", lambda c: F.struct(c["k"], c["b"]))), j), F.lit(0.0)))).alias(XI)] if is_complex else []))
    return RowMatrix(out, tuple(keys), k, is_complex)
