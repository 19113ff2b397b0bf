"""From labelled fields to a row matrix and back.

Stages, in order: centre, divide by the standard deviation, weight by the root of cos(latitude), weight by the user's weights; lay cells out by
feature number; drop features and samples without any value and refuse isolated gaps; put blocks side by side. One aggregation by
feature gives all the statistics; one shuffle by sample packs the cells. Feature tables are brought to the driver (at most
`MOST_FEATURES` rows), sample tables never are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.geo import latitude_dim, sqrt_cos_lat_np
from .field import IM, RE, VALUE, Field, Packed, as_fields, same
from .matrix import XI, RowMatrix, X, arrays, block, slices, total

MOST_FEATURES = 2_000_000
#: Standard deviations count as this much at least.
LEAST_STD = float(np.finfo(np.float32).eps)
ISOLATED = "isolated missing values: a sample must have all features or none; drop or fill them, or pass check_nans=False"


def frame(spark: SparkSession, table: pa.Table, schema: StructType) -> DataFrame:
    """A driver table as a DataFrame, through Arrow."""
    return spark.createDataFrame(table, schema)


def _dense(b: pa.RecordBatch, p: int) -> np.ndarray:
    """Rows of the array column of a batch; a null array, or element, is not a number."""
    c = b.column(b.schema.get_field_index("__c"))
    known = c.is_valid().to_numpy(zero_copy_only=False)
    flat = c.drop_null().flatten()
    if len(flat) != known.sum() * p or not (np.diff(c.drop_null().offsets.to_numpy()) == p).all():
        raise ValueError(f"an array is not of length {p}")
    out = np.full((len(c), p), np.nan)
    out[known] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, p)
    return out


def _row_batch(b: pa.RecordBatch, keys, m: np.ndarray, some: np.ndarray, is_complex: bool) -> pa.RecordBatch:
    """Rows of m with the keys of the batch; where `some` is false the array is null."""
    cols = arrays(m[some], is_complex)
    if not some.all():
        at = pa.array(np.cumsum(some) - 1, pa.int64(), mask=~some)
        cols = [x.take(at) for x in cols]
    return pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], *cols], names=[*keys, X, *([XI] if is_complex else [])])


def _in_order(table: pa.Table, rank: dict[str, int], dims: Sequence[str]) -> pa.Table:
    """By variable, then coordinates; a null coordinate comes first."""
    ranks = pa.array([rank[v] for v in table.column("variable").to_pylist()], pa.int32())
    keyed = table.append_column("_rank", ranks)
    return table.take(pc.sort_indices(keyed, sort_keys=[("_rank", "ascending"), *[(d, "ascending") for d in dims]], null_placement="at_start"))


@dataclass
class Block:
    """What is known of one field's features, in order of variable, then coordinates."""

    variables: tuple[tuple[str, str, str | None], ...]
    dims: tuple[str, ...]
    feature_dims: tuple[str, ...]
    is_dataset: bool
    features: pa.Table  # variable, feature dims
    schema: StructType
    count: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    sizes: tuple[int, int] = (0, 0)  # first number and number of the valid features

    @property
    def valid(self) -> np.ndarray:
        return self.count > 0


@dataclass
class Preprocessor:
    with_center: bool = True
    with_std: bool = False
    with_coslat: bool = False
    check_nans: bool = True
    sample_dims: tuple[str, ...] = ()
    blocks: list[Block] = field(default_factory=list)
    many: bool = False
    is_complex: bool = False
    spark: SparkSession | None = None

    # -- fit ----------------------------------------------------------------------------------------------------------
    def fit(self, x, sample_dims: Sequence[str], weights=None) -> RowMatrix:
        """Learn the features and their statistics; the matrix of x."""
        fields, self.many = as_fields(x)
        self.sample_dims, self.spark = tuple(sample_dims), fields[0].df.sparkSession
        weights = weights if isinstance(weights, list | tuple) else [weights] * len(fields)
        if len(weights) != len(fields):
            raise ValueError(f"{len(weights)} weights for {len(fields)} fields")
        self.is_complex = any(f.is_complex for f in fields)
        if any(isinstance(f, Packed) for f in fields) and (len(fields) > 1 or set(fields[0].sample_dims) != set(sample_dims)):
            raise ValueError("packed samples are fitted by themselves, along their own sample dims")
        self.blocks = [self._describe(f, w) for f, w in zip(fields, weights, strict=True)]
        at = 0
        for b in self.blocks:
            n = int(b.valid.sum())
            b.sizes, at = (at, n), at + n
        if at == 0:
            raise ValueError("no feature has a value")
        return self._matrix(fields)

    def _describe_packed(self, f: Packed, weights) -> Block:
        """As `_describe`, from sums over rows; values are taken from those of one sample, so that no digits are lost."""
        first = f.rows().where(F.col("__c").isNotNull()).select("__c").first()
        if first is None:
            raise ValueError("no feature has a value")
        p = len(first[0])
        pilot = np.nan_to_num(np.array(first[0], float), nan=0.0)

        def work(b):
            m = _dense(b, p) - pilot
            known = ~np.isnan(m)
            m[~known] = 0
            return np.stack([known.sum(0), m.sum(0), (m * m).sum(0)])

        n, one, two = total(f.rows().select("__c").where(F.col("__c").isNotNull()), (3, p), work)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = one / n
            std = np.sqrt(np.maximum(two / n - mean**2, 0))
        schema = StructType([StructField("variable", StringType()), StructField(f.feature_dim, IntegerType())])
        table = pa.table({"variable": [VALUE] * p, f.feature_dim: pa.array(np.arange(p, dtype=np.int32))})
        return Block(f.variables, f.dims, (f.feature_dim,), False, table, schema, n, mean + pilot, np.maximum(np.nan_to_num(std), LEAST_STD), self._weights(table, (f.feature_dim,), weights))

    def _describe(self, f: Field | Packed, weights) -> Block:
        if isinstance(f, Packed):
            return self._describe_packed(f, weights)
        _, feature_dims = f.split(self.sample_dims)
        long = f.long()
        parts = [RE, *([IM] if f.is_complex else [])]
        stats = [F.count(RE).alias("n")]
        for c in parts:
            stats += [F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}")]
        found = long.groupBy("variable", *feature_dims).agg(*stats).limit(MOST_FEATURES + 1)
        schema = StructType([x for x in found.schema.fields if x.name in ("variable", *feature_dims)])
        table = found.toArrow()
        if table.num_rows > MOST_FEATURES:
            raise ValueError(f"more than {MOST_FEATURES} features")
        table = _in_order(table, {v: k for k, (v, _, _) in enumerate(f.variables)}, feature_dims)
        num = lambda c: table.column(c).to_numpy().astype(float)
        mean = num("mean_re") + (1j * num("mean_im") if f.is_complex else 0)
        std = np.sqrt(num("var_re") + (num("var_im") if f.is_complex else 0))
        return Block(f.variables, f.dims, feature_dims, f.is_dataset, table.select(["variable", *feature_dims]), schema, num("n"), mean, np.maximum(std, LEAST_STD), self._weights(table, feature_dims, weights))

    def _weights(self, table: pa.Table, feature_dims, weights) -> np.ndarray:
        out = np.ones(table.num_rows)
        if self.with_coslat:
            out *= sqrt_cos_lat_np(table.column(latitude_dim(feature_dims)).to_numpy().astype(float))
        if weights is not None:
            if isinstance(weights, DataFrame):
                on = [d for d in weights.columns if d in ("variable", *feature_dims)]
                given = weights.select(*on, "weight").limit(MOST_FEATURES + 1).toArrow()
                known = dict(zip(zip(*[given.column(d).to_pylist() for d in on], strict=True), given.column("weight").to_pylist(), strict=True))
                keys = list(zip(*[table.column(d).to_pylist() for d in on], strict=True))
                missing = [k for k in keys if k not in known]
                if missing:
                    raise ValueError(f"no weight for {missing[0]} and {len(missing) - 1} more features")
                out *= np.array([known[k] for k in keys], float)
            else:
                out *= np.asarray(weights, float)
        return out

    # -- cells to rows ------------------------------------------------------------------------------------------------
    @property
    def p(self) -> int:
        return sum(b.sizes[1] for b in self.blocks)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and factor of every valid feature: (x - offset) * factor."""
        mean = np.concatenate([b.mean[b.valid] if self.with_center else np.zeros(b.sizes[1]) for b in self.blocks])
        std = np.concatenate([b.std[b.valid] if self.with_std else np.ones(b.sizes[1]) for b in self.blocks])
        return mean, np.concatenate([b.weight[b.valid] for b in self.blocks]) / std

    def _feature_frame(self, b: Block) -> DataFrame:
        """The features with their numbers, -1 for those without data."""
        number = np.full(b.features.num_rows, -1, np.int32)
        number[b.valid] = np.arange(b.sizes[1]) + b.sizes[0]
        return frame(self.spark, b.features.append_column("__f", pa.array(number)), StructType([*b.schema.fields, StructField("__f", IntegerType())]))

    def _packed_matrix(self, f: Packed) -> RowMatrix:
        out = RowMatrix(f.rows(), self.sample_dims, self.p, False)
        offset, factor = self.factors()
        p, keys, strict, valid = self.p, self.sample_dims, self.check_nans, np.flatnonzero(self.blocks[0].valid)
        width = len(self.blocks[0].valid)

        def run(batches):
            for b in slices(batches, max(1, min(4096, (64 << 20) // max(1, 8 * width)))):
                m = _dense(b, width)[:, valid]
                filled = (~np.isnan(m)).sum(axis=1)
                if strict and ((filled > 0) & (filled < p)).any():
                    raise ValueError(ISOLATED)
                yield _row_batch(b, keys, (m - offset) * factor, filled > 0, False)

        out.df = f.rows().mapInArrow(run, out.schema())
        return out

    def _matrix(self, fields: list[Field | Packed], fitting: bool = True) -> RowMatrix:
        if isinstance(fields[0], Packed):
            return self._packed_matrix(fields[0])
        cells = None
        for f, b in zip(fields, self.blocks, strict=True):
            long = f.long()
            if self.is_complex and not f.is_complex:
                long = long.withColumn(IM, F.lit(0.0))
            names = self._feature_frame(b).select(*[F.col(c).alias(f"__dim_{c}") for c in ("variable", *b.feature_dims)], "__f")
            on = [same(F.col(c), F.col(f"__dim_{c}")) for c in ("variable", *b.feature_dims)]
            joined = long.join(F.broadcast(names), on, "inner" if fitting else "left")  # at most MOST_FEATURES rows
            part = joined.select(*self.sample_dims, "__f", RE, *([IM] if self.is_complex else []))
            cells = part if cells is None else cells.unionByName(part)
        known = F.col(RE).isNotNull() & (F.isnull("__f") | (F.col("__f") >= 0)) if fitting else F.col(RE).isNotNull()
        cell = F.struct(F.coalesce("__f", F.lit(-1)).alias("f"), F.col(RE).alias("a"), *([F.coalesce(IM, F.lit(0.0)).alias("b")] if self.is_complex else []))
        packed = cells.groupBy(*self.sample_dims).agg(F.collect_list(F.when(known, cell)).alias("__c"))
        out = RowMatrix(packed, self.sample_dims, self.p, self.is_complex)
        offset, factor = self.factors()
        p, is_complex, keys, strict = self.p, self.is_complex, self.sample_dims, self.check_nans

        def run(batches):
            for b in slices(batches, max(1, min(4096, (64 << 20) // max(1, 8 * p)))):
                c = b.column(b.schema.get_field_index("__c"))
                n = np.diff(c.offsets.to_numpy())
                flat = c.flatten()
                row, f = np.repeat(np.arange(len(n)), n), flat.field("f").to_numpy(zero_copy_only=False)
                v = flat.field("a").to_numpy(zero_copy_only=False) + (1j * flat.field("b").to_numpy(zero_copy_only=False) if is_complex else 0)
                if (f < 0).any():
                    raise ValueError("features differ from those of the fit")
                m = np.full((len(n), p), np.nan, complex if is_complex else float)
                m[row, f] = v
                filled = (~np.isnan(m)).sum(axis=1)
                if (filled != n).any():
                    raise ValueError("a sample has two values for one feature")
                if strict and ((filled > 0) & (filled < p)).any():
                    raise ValueError(ISOLATED)
                yield _row_batch(b, keys, (m - offset) * factor, filled > 0, is_complex)

        out.df = packed.mapInArrow(run, out.schema())
        return out

    def transform(self, x) -> RowMatrix:
        """The matrix of further samples of the same features."""
        fields, many = as_fields(x)
        if len(fields) != len(self.blocks):
            raise ValueError(f"the model was fitted on {len(self.blocks)} fields, not {len(fields)}")
        for f, b in zip(fields, self.blocks, strict=True):
            if f.is_dataset != b.is_dataset or [v[0] for v in f.variables] != [v[0] for v in b.variables]:
                raise TypeError("the variables differ from those of the fit")
            if set(f.dims) != set(b.dims):
                raise ValueError(f"dims {f.dims} differ from those of the fit, {b.dims}")
        self._same_features(fields)
        return self._matrix(fields, fitting=False)

    def _same_features(self, fields: list[Field]) -> None:
        for f, b in zip(fields, self.blocks, strict=True):
            if isinstance(f, Packed):
                if self.check_nans:
                    width = len(b.valid)
                    n = total(f.rows().where(F.col("__c").isNotNull()).select("__c"), (width,), lambda x, w=width: (~np.isnan(_dense(x, w))).sum(0))
                    if ((n > 0) != b.valid).any():
                        raise ValueError("features are missing here but not in the fit, or the other way round")
                continue
            cols = ["variable", *b.feature_dims]
            got = f.long().groupBy(*cols).agg(F.count(RE).alias("_n"))
            want = self._feature_frame(b).select(*[F.col(c).alias(f"__dim_{c}") for c in cols], (F.col("__f") >= 0).cast("int").alias("_valid"))
            both = got.join(F.broadcast(want), [same(F.col(c), F.col(f"__dim_{c}")) for c in cols], "full")
            odd = both.agg(F.count_if(F.col("_n").isNull() | F.col("_valid").isNull()).alias("other"), F.count_if((F.col("_n") > 0) != (F.col("_valid") == 1)).alias("gaps"), F.count("*").alias("n")).first()
            if odd["other"]:
                raise ValueError(f"{odd['other']} feature coordinates differ from those of the fit")
            if self.check_nans and odd["gaps"]:
                raise ValueError(f"{odd['gaps']} features are missing here but not in the fit, or the other way round")

    # -- and back -----------------------------------------------------------------------------------------------------
    def _one(self, frames: list):
        return frames if self.many else frames[0]

    def components(self, v: np.ndarray, extra: dict[str, np.ndarray] | None = None, column: str = "mode"):
        """Patterns (features x modes) as long tables with the feature dims; features without data are null. One table a field.

        `extra`: labels of the columns of v, in place of a 1-based `column`.
        """
        k, cplx = v.shape[1], np.iscomplexobj(v)
        labels = extra if extra is not None else {column: np.arange(1, k + 1)}
        out = []
        for b in self.blocks:
            n = b.features.num_rows
            full = np.full((n, k), np.nan, v.dtype)
            full[b.valid] = v[b.sizes[0] : b.sizes[0] + b.sizes[1]]
            rows = b.features.take(pa.array(np.repeat(np.arange(n), k)))
            kinds = [x for x in b.schema.fields if b.is_dataset or x.name != "variable"]
            rows = rows.select([x.name for x in kinds])
            for c, values in labels.items():
                rows, kinds = rows.append_column(c, pa.array(np.tile(values, n).astype(np.int32))), [*kinds, StructField(c, IntegerType())]
            for c, part in [("re", full.real), ("im", full.imag)] if cplx else [("value", full)]:
                flat = np.ascontiguousarray(part).ravel()
                rows, kinds = rows.append_column(c, pa.array(flat, mask=np.isnan(flat))), [*kinds, StructField(c, DoubleType())]
            out.append(frame(self.spark, rows, StructType(kinds)))
        return self._one(out)

    def data(self, m: RowMatrix, keep_complex: bool = True):
        """Row matrices in the space of the fit as fields in the units of the input. One table a field."""
        offset, factor = self.factors()
        safe = np.where(factor == 0, np.nan, factor)
        p, is_complex, keys = m.p, m.is_complex, m.keys
        result_complex = is_complex and keep_complex
        back = RowMatrix(m.df, m.keys, p, result_complex)

        def run(batches):
            for b in slices(batches, max(1, min(4096, (64 << 20) // max(1, 8 * p)))):
                x = block(b, p, is_complex)
                x = x / safe + offset
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], *arrays(x if result_complex else x.real, result_complex)], names=[*keys, X, *([XI] if result_complex else [])])

        back.df = m.rows().mapInArrow(run, back.schema())
        long = back.long("__f", first=0)
        out = []
        for b in self.blocks:
            names = self._feature_frame(b).where("__f >= 0")
            got = long.where((F.col("__f") >= b.sizes[0]) & (F.col("__f") < b.sizes[0] + b.sizes[1])).join(F.broadcast(names), "__f").drop("__f")
            cols = [*keys, *([] if not b.is_dataset else ["variable"]), *b.feature_dims, *(["re", "im"] if result_complex else ["value"])]
            out.append(got.select(*cols))
        return self._one(out)

    # -- state --------------------------------------------------------------------------------------------------------
    def state(self) -> dict:
        blocks = []
        for b in self.blocks:
            blocks.append({"variables": b.variables, "dims": b.dims, "feature_dims": b.feature_dims, "is_dataset": b.is_dataset, "schema": b.schema.json(), "sizes": b.sizes, "arrays": {n: getattr(b, n) for n in ("count", "mean", "std", "weight")}, "features": self._feature_frame(b).drop("__f")})
        return {"params": {n: getattr(self, n) for n in ("with_center", "with_std", "with_coslat", "check_nans", "sample_dims", "many", "is_complex")}, "blocks": blocks}

    @classmethod
    def from_state(cls, state: dict, spark: SparkSession) -> Preprocessor:
        out = cls(**{k: tuple(v) if k == "sample_dims" else v for k, v in state["params"].items()})
        out.spark = spark
        for b in state["blocks"]:
            schema = StructType.fromJson(json.loads(b["schema"]))
            dims = tuple(b["feature_dims"])
            table = _in_order(b["features"].toArrow(), {v[0]: k for k, v in enumerate(b["variables"])}, dims)
            out.blocks.append(Block(tuple(tuple(v) for v in b["variables"]), tuple(b["dims"]), dims, b["is_dataset"], table, schema, **b["arrays"], sizes=tuple(b["sizes"])))
        return out
