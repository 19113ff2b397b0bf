"""Geographically weighted PCA: at every sample, the PCA of all samples weighted by a kernel of their distance.

Samples are dealt to blocks of at most `BLOCK` rows: cells of a grid no smaller than the bandwidth where the kernel ends there, split by salt where
they are crowded, else plain blocks. Block pairs that can be in reach are found on the small table of blocks; each pair
gives every sample of the first block its weighted sums over the second one. Sums of a block meet and are decomposed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.geo import CARTESIAN_X, CARTESIAN_Y, EARTH_KM, KERNELS, LATITUDES, LONGITUDES, METRICS, bounding_halfwidth, distances_np, kernel_weight_np
from ..plans.lineage import checkpoint
from ..plans.matrix import RowMatrix, X, block
from ..plans.order import SID, indexed
from .base import SingleSet

BLOCK = 512
#: Bytes of the products of features that a block's rows hold: with many features blocks have fewer rows.
BLOCK_BYTES = 64 << 20


class GWPCA(SingleSet):
    """Local components, variances and ratios by sample and mode; no scores."""

    def __init__(self, n_modes, bandwidth, metric="haversine", kernel="bisquare", center=True, standardize=False, use_coslat=False, check_nans=True, coords=None, **params):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}, not {kernel!r}")
        if bandwidth <= 0:
            raise ValueError("the bandwidth must be positive")
        super().__init__(n_modes, center, standardize, use_coslat, check_nans, bandwidth=float(bandwidth), metric=metric, kernel=kernel, coords=list(coords) if coords else None, **params)

    def _coords(self, keys) -> tuple[str, str]:
        """(longitude or x, latitude or y) among the sample dims, by name."""
        if self.params["coords"]:
            x, y = self.params["coords"]
        else:
            xs, ys = (LONGITUDES, LATITUDES) if self.params["metric"] == "haversine" else (CARTESIAN_X, CARTESIAN_Y)
            found = [[k for k in keys if k.lower() in names] for names in (xs, ys)]
            if any(len(f) != 1 for f in found):
                raise ValueError(f"sample dims {list(keys)} do not name one {xs[0]} and one {ys[0]}: pass coords")
            x, y = found[0][0], found[1][0]
        missing = [c for c in (x, y) if c not in keys]
        if missing:
            raise ValueError(f"{missing} are not among the sample dims {list(keys)}")
        return x, y

    def _fit(self, m: RowMatrix) -> None:
        if m.is_complex:
            raise TypeError("local components are made of real data")
        if not isinstance(self.params["n_modes"], int):
            raise ValueError("GWPCA needs a number of modes")
        x, y = self._coords(m.keys)
        placed = indexed(m.rows(), m.keys).withColumns({"__px": F.col(x).cast("double"), "__py": F.col(y).cast("double")})
        n = placed.count()
        placed = self._blocks(placed, m.p).persist()
        self._result = self._local(placed, m.p).persist()
        self._keys = placed.select(SID, *m.keys)
        self.data.update(n_samples=n)

    def _blocks(self, placed: DataFrame, features: int) -> DataFrame:
        """Add a block number `_b`, the same for rows that are near one another."""
        p, rows = self.params, max(1, min(BLOCK, BLOCK_BYTES // (8 * features**2)))
        if p["kernel"] != "bisquare":
            return placed.withColumn("__b", F.floor(F.col(SID) / rows).cast("long"))
        size = self._cell_size()
        cell = placed.withColumn("__c", F.xxhash64(F.floor(F.col("__px") / size), F.floor(F.col("__py") / size)))
        crowd = cell.groupBy("__c").agg((F.floor((F.count("*") - 1) / rows) + 1).alias("__parts"))
        return cell.join(crowd, "__c").withColumn("__b", F.xxhash64("__c", F.pmod(F.xxhash64(SID), F.col("__parts")))).drop("__c", "__parts")

    def _cell_size(self) -> float:
        """Side of the grid's cells: the bandwidth, in degrees of latitude (111 km) where that is the unit."""
        return self.params["bandwidth"] / 111.0 if self.params["metric"] == "haversine" else self.params["bandwidth"]

    def _pairs(self, packed: DataFrame) -> DataFrame:
        """(a, b): blocks of which some points can be in reach of each other.

        A block is sent to every grid cell that its box, widened by the bandwidth, touches, and meets the blocks of that cell.
        """
        p = self.params
        boxes = packed.select("__b", "x0", "x1", "y0", "y1")
        if p["kernel"] != "bisquare":  # a kernel without an end needs all rows at every row, in blocks
            return boxes.select(F.col("__b").alias("a__b")).join(F.broadcast(boxes.select("__b")), F.lit(True)).select("a__b", "__b")
        size = self._cell_size()
        if p["metric"] == "euclidean":
            wide, high, turns = F.lit(p["bandwidth"]), F.lit(p["bandwidth"]), [0.0]
        else:
            dlat = bounding_halfwidth(0.0, p["bandwidth"])[1]
            top = F.greatest(F.abs("y0"), F.abs("y1"))
            sine = math.sin(min(p["bandwidth"] / EARTH_KM, math.pi / 2))
            # the widest longitude reached from the latitude nearest a pole
            wide = F.when(top + dlat >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(sine) / F.cos(F.radians(top))))))
            high, turns = F.lit(dlat), [-360.0, 0.0, 360.0]
        cells = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
        sent = boxes.select(F.col("__b").alias("a__b"), "x0", "x1", (F.col("y0") - high).alias("lo"), (F.col("y1") + high).alias("hi"), wide.alias("w"), F.explode(F.array(*[F.lit(t) for t in turns])).alias("t"))
        sent = sent.select("a__b", "lo", "hi", (F.col("x0") - F.col("w") + F.col("t")).alias("left"), (F.col("x1") + F.col("w") + F.col("t")).alias("right"))
        sent = sent.withColumn("cx", F.explode(cells(F.col("left"), F.col("right")))).withColumn("cy", F.explode(cells(F.col("lo"), F.col("hi"))))
        own = boxes.withColumn("cx", F.floor(F.col("x0") / size)).withColumn("cy", F.floor(F.col("y0") / size))
        touch = (F.col("left") <= F.col("x1")) & (F.col("right") >= F.col("x0")) & (F.col("lo") <= F.col("y1")) & (F.col("hi") >= F.col("y0"))
        return sent.join(own, ["cx", "cy"]).where(touch).select("a__b", "__b").distinct()

    def _local(self, placed: DataFrame, p: int) -> DataFrame:
        par = self.params
        k, metric, kernel, width = min(par["n_modes"], p), par["metric"], par["kernel"], par["bandwidth"]

        def pack(key, t):
            t = t.combine_chunks().sort_by(SID)
            b = t.to_batches()[0]
            xy = np.stack([t.column(c).to_numpy() for c in ("__px", "__py")], axis=1)
            return pa.table({"__b": pa.array([key[0].as_py()], pa.int64()), "ids": [t.column(SID).to_numpy().tobytes()], "xy": [xy.tobytes()], "v": [np.ascontiguousarray(block(b, p, False)).tobytes()], "x0": [xy[:, 0].min()], "x1": [xy[:, 0].max()], "y0": [xy[:, 1].min()], "y1": [xy[:, 1].max()]})

        kinds = "__b long, ids binary, xy binary, v binary, x0 double, x1 double, y0 double, y1 double"
        packed = checkpoint(placed.groupBy("__b").applyInArrow(pack, kinds))
        other = packed.select("__b", F.col("xy").alias("bxy"), F.col("v").alias("bv"))
        met = self._pairs(packed).join(other, "__b").drop("__b").join(packed.select(F.col("__b").alias("a__b"), "xy"), "a__b")

        def moments(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    a, b = np.frombuffer(r["xy"]).reshape(-1, 2), np.frombuffer(r["bxy"]).reshape(-1, 2)
                    v = np.frombuffer(r["bv"]).reshape(-1, p)
                    w = kernel_weight_np(distances_np(a, b, metric), width, kernel)
                    square = (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)
                    out = np.concatenate([w.sum(1, keepdims=True), w @ v, w @ square], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([r["a__b"]], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["a__b", "part"])

        schema = StructType([StructField(SID, LongType()), StructField("__k", IntegerType()), StructField("component", ArrayType(DoubleType())), StructField("variance", DoubleType()), StructField("ratio", DoubleType())])

        def solve(left, right):
            out = None
            for part in right.column("part"):
                v = np.frombuffer(part.as_py()).reshape(-1, 1 + p + p * p)
                out = v.copy() if out is None else out + v
            ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
            w, mean = out[:, :1], out[:, 1 : 1 + p] / out[:, :1]
            cov = out[:, 1 + p :].reshape(-1, p, p) / w[:, :, None] - mean[:, :, None] * mean[:, None, :]
            values, vectors = np.linalg.eigh((cov + cov.transpose(0, 2, 1)) / 2)
            values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
            total = values.sum(axis=1)
            top = vectors[:, :, :k]
            flip = np.where(np.abs(top.max(1)) >= np.abs(top.min(1)), 1.0, -1.0)
            comp = (top * flip[:, None, :]).transpose(0, 2, 1).reshape(-1, p)
            variance = values[:, :k].ravel()
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (values[:, :k] / total[:, None]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(comp) + 1, dtype=np.int32) * p), pa.array(comp.ravel()))
            return pa.table({SID: pa.array(np.repeat(ids, k)), "__k": pa.array(np.tile(np.arange(1, k + 1), len(ids)).astype(np.int32)), "component": lists, "variance": pa.array(variance), "ratio": pa.array(ratio)})

        sums = met.mapInArrow(moments, "a__b long, part binary")
        owners = packed.select(F.col("__b").alias("a__b"), "ids")
        return owners.groupBy("a__b").cogroup(sums.groupBy("a__b")).applyInArrow(solve, schema)

    def _table(self, column: str) -> DataFrame:
        self._ready()
        if getattr(self, "_result", None) is None:
            raise ValueError("the model was saved without its results")
        keys = self.preprocessor.sample_dims
        return self._keys.join(self._result, SID).select(*keys, F.col("__k").alias("mode"), F.col(column).alias("value"))

    def explained_variance(self) -> DataFrame:
        return self._table("variance")

    def explained_variance_ratio(self) -> DataFrame:
        return self._table("ratio")

    def components(self, normalized: bool = True):
        """Long: sample dims, feature dims, mode, value; one table a field."""
        rows = self._table("component").select(*self.preprocessor.sample_dims, "mode", F.posexplode("value").alias("__f", "value"))
        out = []
        for b in self.preprocessor.blocks:
            names = self.preprocessor._feature_frame(b).where("__f >= 0")
            cols = [*self.preprocessor.sample_dims, *(["variable"] if b.is_dataset else []), *b.feature_dims, "mode", "value"]
            out.append(rows.join(F.broadcast(names), "__f").select(*cols))
        return self.preprocessor._one(out)

    def largest_locally_weighted_components(self) -> DataFrame:
        """For every sample and mode, the coordinates of the feature of greatest loading in modulus."""
        top = self._table("component").select(*self.preprocessor.sample_dims, "mode", F.transform("value", lambda v: F.abs(v)).alias("__a"))
        top = top.withColumn("__f", (F.array_position("__a", F.array_max("__a")) - 1).cast("int")).drop("__a")
        names = None
        for b in self.preprocessor.blocks:
            own = self.preprocessor._feature_frame(b).where("__f >= 0")
            names = own if names is None else names.unionByName(own, allowMissingColumns=True)
        single = not any(b.is_dataset for b in self.preprocessor.blocks)
        out = top.join(F.broadcast(names), "__f").drop("__f")
        return out.drop("variable") if single else out

    def scores(self, normalized: bool = False):
        raise NotImplementedError("GWPCA has no scores")

    def transform(self, x, normalized: bool = False):
        raise NotImplementedError("GWPCA does not transform")

    def inverse_transform(self, scores, normalized: bool = False):
        raise NotImplementedError("GWPCA does not invert")
