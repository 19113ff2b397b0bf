"""Fields from tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.field import VALUE, Field, Packed


def read_field(spark: SparkSession, path: str, dims: Sequence[str] | None = None, variables: Sequence[str] | None = None, fmt: str = "parquet", **options) -> Field:
    """A long table in any format Spark reads, as a field."""
    return Field.of(spark.read.format(fmt).options(**options).load(path), dims, variables)


def from_wide(df: DataFrame, sample_dims: Sequence[str], features: Sequence[str] | None = None, feature_dim: str = "feature") -> Field:
    """One row a sample, one column a feature: each column name becomes a coordinate of `feature_dim`."""
    features = list(features) if features is not None else [c for c in df.columns if c not in sample_dims]
    cells = F.array(*[F.struct(F.lit(c).alias(feature_dim), F.col(c).cast("double").alias(VALUE)) for c in features])
    return Field.of(df.select(*sample_dims, F.inline(cells)), (*sample_dims, feature_dim), (VALUE,))


def from_arrays(df: DataFrame, sample_dims: Sequence[str], array: str, feature_dim: str = "feature") -> Packed:
    """One row a sample with an array column: the position (from 0) is the coordinate of `feature_dim`. No shuffle makes a matrix of it."""
    return Packed(df, tuple(sample_dims), array, feature_dim)


def from_events(df: DataFrame, sample: dict[str, object], feature: dict[str, object], value) -> Field:
    """Events summed to cells: `sample` and `feature` name expressions; a cell without an event is absent, that is missing."""
    cells = df.groupBy(*[e.alias(k) for k, e in {**sample, **feature}.items()]).agg(F.sum(value).alias(VALUE))
    return Field.of(cells, (*sample, *feature), (VALUE,))
