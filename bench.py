"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenweave import operators as O
from eigenweave import queries as Q
from eigenweave.sources.tables import from_arrays

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def field(spark: SparkSession, n: int, side: int, seed: int) -> DataFrame:
    """A synthetic field of n samples on a side x side grid, made by the executors."""
    cells = spark.range(n * side * side, numPartitions=int(CPUS)).withColumn("time", F.floor(F.col("id") / (side * side)))
    cell = F.col("id") % (side * side)
    return cells.select("time", (F.floor(cell / side) * 180.0 / side - 89).alias("lat"), (cell % side * 360.0 / side).alias("lon"), (F.randn(seed) + F.sin(F.col("time") / 20) * F.cos(cell / 50)).alias("value"))


def vectors(spark: SparkSession, n: int, p: int) -> DataFrame:
    """n samples of p features as arrays."""
    wave = F.transform(F.sequence(F.lit(1), F.lit(p)), lambda k: F.sin(F.col("time") * k / 977.0) + (F.xxhash64("time", k) % 1000) / 1000.0)
    return spark.range(n, numPartitions=int(CPUS)).select(F.col("id").alias("time")).select("time", wave.alias("v"))


def queries() -> dict:
    out = {name: Q.QUERIES[name] for name in ("eof_explained_variance", "eof_components", "eof_scores", "eof_inverse_transform", "eof_embeddings", "hilbert_eof", "extended_eof", "pop_eigenvalues", "opa_decorrelation_time", "gwpca_components", "eof_varimax", "complex_mca_singular_values", "hilbert_cca_singular_values", "sparse_pca_components", "eof_promax", "eof_bootstrap", "mca_singular_values", "cca_singular_values", "mca_rotator", "multi_cca_correlations")}
    out["eof_grid_2000x2500"] = lambda spark, _: O.EOF(10, use_coslat=True).fit(field(spark, 2000, 50, 1), "time").scores()
    out["mca_grid_2000x900"] = lambda spark, _: O.MCA(5, n_pca_modes=50).fit(field(spark, 2000, 30, 2), field(spark, 2000, 30, 3), "time").scores()[0]
    out["eof_packed_10000x6000"] = lambda spark, _: O.EOF(2).fit(from_arrays(vectors(spark, 10_000, 6000), ("time",), "v"), "time").scores()
    out["eof_packed_10000x2000"] = lambda spark, _: O.EOF(2).fit(from_arrays(vectors(spark, 10_000, 2000), ("time",), "v"), "time").scores()
    return out


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    np.seterr(all="ignore")
    took = {}
    for name, run in queries().items():
        best = float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
            spark.catalog.clearCache()
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
