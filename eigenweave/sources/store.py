"""Fitted models on storage: one Parquet table of arrays, one of each DataFrame, and a JSON document that ties them together."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_CHUNK = 32 << 20


def _split(node, path: str, arrays: dict, frames: dict):
    if isinstance(node, np.ndarray):
        arrays[path] = node
        return {"@array": path}
    if isinstance(node, DataFrame):
        frames[path] = node
        return {"@frame": path}
    if isinstance(node, dict):
        return {k: _split(v, f"{path}.{k}" if path else k, arrays, frames) for k, v in node.items()}
    if isinstance(node, list | tuple):
        return [_split(v, f"{path}.{i}", arrays, frames) for i, v in enumerate(node)]
    if isinstance(node, np.generic):
        return node.item()
    return node


def _join(node, arrays: dict, frames):
    if isinstance(node, dict):
        if "@array" in node:
            return arrays[node["@array"]]
        if "@frame" in node:
            return frames(node["@frame"])
        return {k: _join(v, arrays, frames) for k, v in node.items()}
    if isinstance(node, list):
        return [_join(v, arrays, frames) for v in node]
    return node


def write_state(spark: SparkSession, state: dict, path: str, overwrite: bool = False) -> None:
    """Write nested dicts and lists of scalars, arrays and DataFrames. Without `overwrite` an existing path is an error."""
    mode = "overwrite" if overwrite else "errorifexists"
    arrays: dict[str, np.ndarray] = {}
    frames: dict[str, DataFrame] = {}
    tree = _split(state, "", arrays, frames)
    rows = []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        for k, at in enumerate(range(0, max(len(raw), 1), _CHUNK)):
            rows.append((name, a.dtype.str, list(a.shape), k, bytearray(raw[at : at + _CHUNK])))
    spark.createDataFrame([(json.dumps(tree),)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")
    spark.createDataFrame(rows, "name string, dtype string, shape array<long>, k long, data binary").write.mode(mode).parquet(f"{path}/arrays")
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{path}/frames/{name}")


def read_state(spark: SparkSession, path: str) -> dict:
    """Read what `write_state` wrote; DataFrames are read lazily."""
    tree = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
    parts: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/arrays").collect():  # what a driver held when it was written
        parts.setdefault(r["name"], []).append(r)
    arrays = {}
    for name, rows in parts.items():
        raw = b"".join(bytes(r["data"]) for r in sorted(rows, key=lambda r: r["k"]))
        arrays[name] = np.frombuffer(raw, np.dtype(rows[0]["dtype"])).reshape(rows[0]["shape"]).copy()
    return _join(tree, arrays, lambda name: spark.read.parquet(f"{path}/frames/{name}"))
