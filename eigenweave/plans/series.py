"""Passes along the sample axis: analytic signals, lagged products, lag embedding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hilbert import hilbert
from .matrix import XI, RowMatrix, X, arrays, block, slices, tasks, total, tree
from .order import SID, indexed, with_halo

#: A series of one feature is transformed in one task, as its spectrum needs all of it: at most so many samples (half a gigabyte, padded).
MOST_SERIES = 1 << 24
_SPAN = 1024


def positions(m: RowMatrix) -> DataFrame:
    """Rows that take part, with `__sid`, their position in the order of the keys."""
    return indexed(m.rows(), m.keys)


def analytic_rows(m: RowMatrix, padding: str | None = "exp", decay: float = 0.2) -> RowMatrix:
    """The analytic signal of every column along the order of the keys.

    Spans of rows are transposed to one piece a feature, pieces of a feature meet, and the result is transposed back; what moves is
    compact binary. Rows that take no part are left out.
    """
    if m.is_complex:
        raise TypeError("an analytic signal is made of real data")
    placed, p, keys = positions(m), m.p, m.keys
    n = placed.count()
    if n > MOST_SERIES:
        raise ValueError(f"{n} samples are more than the {MOST_SERIES} of which one series may consist")
    spans = placed.withColumn("__b", F.floor(F.col(SID) / _SPAN))

    def transpose(t):
        t = t.combine_chunks().sort_by(SID)
        x = block(t.to_batches()[0], p, False)
        return pa.table({"_f": pa.array(np.arange(p, dtype=np.int32)), "__b": pa.array([t.column("__b")[0].as_py()] * p, pa.int64()), "v": pa.array([c.tobytes() for c in np.ascontiguousarray(x.T)], pa.binary())})

    def transform(t):
        t = t.sort_by("__b")
        pieces = [np.frombuffer(v.as_py()) for v in t.column("v")]
        y = hilbert(np.concatenate(pieces), padding, decay)
        cuts = np.split(y, np.cumsum([len(v) for v in pieces])[:-1])
        return pa.table({"_f": t.column("_f"), "__b": t.column("__b"), "v": pa.array([c.tobytes() for c in cuts], pa.binary())})

    def restore(left, right):
        left, right = left.sort_by(SID), right.sort_by("_f")
        y = np.stack([np.frombuffer(v.as_py(), complex) for v in right.column("v")], axis=1)
        return pa.table([*[left.column(k) for k in keys], *arrays(y, True)], names=[*keys, X, XI])

    pieces = spans.select("__b", SID, X).groupBy("__b").applyInArrow(transpose, "_f int, __b long, v binary")
    series = pieces.groupBy("_f").applyInArrow(transform, "_f int, __b long, v binary")
    out = RowMatrix(spans, keys, p, True)
    out.df = spans.select("__b", SID, *keys).groupBy("__b").cogroup(series.groupBy("__b")).applyInArrow(restore, out.schema())
    return out


def lagged_products(m: RowMatrix, lags: Sequence[int]) -> dict[int, tuple[int, np.ndarray]]:
    """For each lag: the number of pairs (t, t + lag) and the sum of x_t^H x_(t+lag), all in one pass over groups of consecutive rows."""
    lags, p, is_complex = sorted(set(lags)), m.p, m.is_complex
    groups = with_halo(positions(m).select(SID, X, *([XI] if is_complex else [])), max(lags))
    dtype = complex if is_complex else float

    def work(t):
        t = t.combine_chunks().sort_by(SID)
        b = t.to_batches()[0]
        x, own = block(b, p, is_complex), t.column("__own").to_numpy().astype(bool)
        mine = int(own.sum())
        parts = []
        for lag in lags:
            n = min(mine, len(x) - lag)
            parts.append((lag, max(n, 0), (x[: max(n, 0)].conj().T @ x[lag : lag + max(n, 0)]).astype(dtype).tobytes()))
        return pa.table({"lag": pa.array([q[0] for q in parts], pa.int32()), "n": pa.array([q[1] for q in parts], pa.int64()), "part": pa.array([q[2] for q in parts], pa.binary())})

    def fold(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["part"], dtype)
                if r["lag"] in sums:
                    sums[r["lag"]][0] += r["n"]
                    sums[r["lag"]][1] = sums[r["lag"]][1] + v
                else:
                    sums[r["lag"]] = [r["n"], v]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary()), pa.array([TaskContext.get().partitionId()] * len(sums), pa.int64())], names=["lag", "n", "part", "task"])

    def add(t):
        total = sum(np.frombuffer(v.as_py(), dtype) for v in t.column("part"))
        return pa.table({"lag": t.column("lag")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    kind = "lag int, n long, part binary"
    products = groups.groupBy("__g").applyInArrow(work, kind)
    found = tree(products.mapInArrow(fold, f"{kind}, task long"), tasks(products), "lag", add, kind).collect()  # one small matrix a lag
    return {r["lag"]: (r["n"], np.frombuffer(r["part"], dtype).reshape(p, p)) for r in found}


def embed(m: RowMatrix, copies: int, tau: int) -> RowMatrix:
    """Rows with the rows tau, 2 tau, ... positions on beside them; the last (copies - 1) * tau rows have none and come out empty."""
    p, is_complex, keys = m.p, m.is_complex, m.keys
    reach = (copies - 1) * tau
    groups = with_halo(positions(m), reach)
    out = RowMatrix(m.df, keys, p * copies, is_complex)

    def work(t):
        t = t.combine_chunks().sort_by(SID)
        b = t.to_batches()[0]
        x, mine = block(b, p, is_complex), int(t.column("__own").to_numpy().astype(bool).sum())
        full = max(0, min(mine, len(x) - reach))
        wide = np.concatenate([x[k * tau : k * tau + full] for k in range(copies)], axis=1)
        at = pa.array(np.arange(mine), pa.int64(), mask=np.arange(mine) >= full)
        return pa.table([*[t.column(k).slice(0, mine) for k in keys], *[c.take(at) for c in arrays(wide, is_complex)]], names=[*keys, X, *([XI] if is_complex else [])])

    out.df = groups.groupBy("__g").applyInArrow(work, out.schema())
    return out


def shifted(m: RowMatrix, by: np.ndarray) -> RowMatrix:
    """Every row less `by`; rows that take no part stay so."""
    p, is_complex, keys = m.p, m.is_complex, m.keys
    parts = [X, *([XI] if is_complex else [])]

    def run(batches):
        for b in slices(batches):
            known = b.column(b.schema.get_field_index(X)).is_valid()
            cols = arrays(block(b.filter(known), p, is_complex) - by, is_complex)
            if known.false_count:
                known = known.to_numpy(zero_copy_only=False)
                cols = [c.take(pa.array(np.cumsum(known) - 1, pa.int64(), mask=~known)) for c in cols]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], *cols], names=[*keys, *parts])

    return RowMatrix(m.df.select(*keys, *parts).mapInArrow(run, m.schema()), keys, p, is_complex)


def means(m: RowMatrix) -> tuple[int, np.ndarray]:
    p, is_complex = m.p, m.is_complex

    def work(b):
        x = block(b, p, is_complex)
        return np.concatenate([[len(x)], x.sum(axis=0)])

    out = total(m.only(), (p + 1,), work, m.dtype)
    n = int(round(out[0].real))
    return n, out[1:] / max(n, 1)
