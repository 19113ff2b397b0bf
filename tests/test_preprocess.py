import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenweave.functions.geo import sqrt_cos_lat_np
from eigenweave.plans.field import Field, as_dims
from eigenweave.plans.preprocess import Preprocessor
from eigenweave.sources.tables import from_arrays, from_wide, read_field

from .data import LAT, grid, long, pivot, table


def matrix(m):
    return np.array([r["__x"] for r in m.df.orderBy(*m.keys).collect() if r["__x"] is not None])


def test_center_standardize_coslat(spark):
    x = grid()
    flat = x.reshape(25, 20)
    got = matrix(Preprocessor(True, True, True).fit(long(spark, x), ("time",)))
    want = (flat - flat.mean(0)) / flat.std(0) * np.repeat(sqrt_cos_lat_np(LAT), 4)
    assert np.allclose(got, want)


def test_two_sample_dims_and_weights(spark):
    x = grid()
    w = spark.createDataFrame([(lat, 1.0 + k) for k, lat in enumerate(LAT)], "lat double, weight double")
    pre = Preprocessor(with_center=False)
    got = matrix(pre.fit(long(spark, x), ("time",), w))
    assert np.allclose(got, (x * (1 + np.arange(5))[None, :, None]).reshape(25, 20))
    with pytest.raises(ValueError, match="no weight"):
        Preprocessor().fit(long(spark, x), ("time",), w.where("lat > 20"))
    m = Preprocessor().fit(long(spark, x), ("lat", "lon"))
    assert m.p == 25 and m.count() == 20


def test_missing_values(spark):
    x = grid()
    full = x.copy()
    full[:, 1] = np.nan
    full[3] = np.nan
    pre = Preprocessor()
    m = pre.fit(long(spark, full), ("time",))
    assert m.p == 16 and m.count() == 24 and m.df.count() == 25
    kept = np.delete(np.delete(full, 1, 1), 3, 0).reshape(24, 16)
    assert np.allclose(matrix(m), kept - kept.mean(0))
    lone = x.copy()
    lone[0, 1, 0] = np.nan
    with pytest.raises(Exception, match="isolated"):
        Preprocessor().fit(long(spark, lone), ("time",)).count()
    # an absent row is as good as a null one
    with pytest.raises(Exception, match="isolated"):
        Preprocessor().fit(long(spark, lone).where("value is not null"), ("time",)).count()
    assert Preprocessor(check_nans=False).fit(long(spark, lone), ("time",)).count() == 25


def test_nan_counts_as_missing_and_repeats_are_refused(spark):
    df = long(spark, grid())
    nan = df.withColumn("value", F.when(F.col("lat") == 20, F.lit(float("nan"))).otherwise(F.col("value")))
    assert Preprocessor().fit(nan, ("time",)).p == 16
    with pytest.raises(Exception, match="two values"):
        Preprocessor().fit(df.union(df.limit(1)), ("time",)).count()


def test_null_coordinates_are_coordinates(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "b", 2.0), (None, None, 3.0), (None, "b", 5.0)], "t long, f string, value double")
    m = Preprocessor().fit(df, ("t",))
    assert m.p == 2 and m.count() == 2
    assert np.allclose(matrix(m), [[1, 1.5], [-1, -1.5]])


def test_names_that_clash(spark):
    x = np.random.default_rng(0).normal(size=(6, 3))
    df = table(spark, x, ("x", "_f")).withColumnRenamed("value", "value")
    m = Preprocessor().fit(df, ("x",))
    assert np.allclose(matrix(m), x - x.mean(0))


def test_list_of_fields_and_dataset(spark):
    x = grid()
    a, b = long(spark, x), long(spark, x**2)
    pre = Preprocessor()
    assert np.allclose(matrix(pre.fit([a, b], ("time",))), np.concatenate([v.reshape(25, 20) - v.reshape(25, 20).mean(0) for v in (x, x**2)], axis=1))
    both = a.withColumnRenamed("value", "t2m").withColumn("prcp", F.col("t2m") ** 2)
    pre = Preprocessor()
    m = pre.fit(Field.of(both, ("time", "lat", "lon"), ("t2m", "prcp")), ("time",))
    assert m.p == 40
    back = pre.data(m)
    assert back.select("variable").distinct().count() == 2
    assert np.allclose(pivot(back.where("variable = 'prcp'"), ["time"], ["lat", "lon"]), (x**2).reshape(25, 20))


def test_transform_checks(spark):
    x = grid()
    df = long(spark, x)
    pre = Preprocessor()
    pre.fit(df, ("time",))
    assert pre.transform(df.limit(20 * 25)).count() == 25
    with pytest.raises(ValueError, match="coordinates differ"):
        pre.transform(df.withColumn("lat", F.col("lat") + 1))
    with pytest.raises(ValueError, match="missing here"):
        pre.transform(df.withColumn("value", F.when(F.col("lat") != 20, F.col("value"))))
    with pytest.raises(ValueError, match="fields"):
        pre.transform([df, df])
    with pytest.raises(ValueError, match="dims"):
        pre.transform(df.withColumnRenamed("lat", "latitude"))


def test_arguments(spark):
    df = long(spark, grid())
    with pytest.raises(TypeError):
        as_dims(3)
    with pytest.raises(ValueError, match="sample dims"):
        Preprocessor().fit(df, ("day",))
    with pytest.raises(ValueError, match="feature dim"):
        Preprocessor().fit(df, ("time", "lat", "lon"))
    with pytest.raises(TypeError):
        Preprocessor().fit("data", ("time",))
    with pytest.raises(ValueError, match="latitude"):
        Preprocessor(with_coslat=True).fit(df.withColumnRenamed("lat", "y"), ("time",))
    with pytest.raises(ValueError, match="no feature"):
        Preprocessor().fit(df.limit(0), ("time",))


def test_readers(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(5, 3))
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t long, a double, b double, c double")
    assert np.allclose(matrix(Preprocessor().fit(from_wide(wide, ("t",)), ("t",))), x - x.mean(0))
    packed = wide.select("t", F.array("a", "b", "c").alias("v"))
    assert np.allclose(matrix(Preprocessor().fit(from_arrays(packed, ("t",), "v"), ("t",))), x - x.mean(0))
    with_gap = packed.union(spark.createDataFrame([(7, None)], "t long, v array<double>"))
    pre = Preprocessor(with_std=True)
    m = pre.fit(from_arrays(with_gap, ("t",), "v", "k"), ("t",))
    assert m.count() == 5 and m.df.count() == 6 and np.allclose(matrix(m), (x - x.mean(0)) / x.std(0))
    assert "Exchange" not in m.df._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(pivot(pre.data(m), ["t"], ["k"]), x)
    assert np.allclose(matrix(pre.transform(from_arrays(packed, ("t",), "v", "k"))), matrix(m))
    short = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "t long, v array<double>")
    with pytest.raises(Exception, match="length"):
        Preprocessor().fit(from_arrays(short, ("t",), "v"), ("t",)).count()
    dead = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, [2.0, float("nan"), 5.0])], "t long, v array<double>")
    pre = Preprocessor()
    m = pre.fit(from_arrays(dead, ("t",), "v"), ("t",))
    assert m.p == 2 and np.allclose(matrix(m), [[-0.5, -1], [0.5, 1]])
    lone = spark.createDataFrame([(1, [1.0, None]), (2, [2.0, 4.0])], "t long, v array<double>")
    with pytest.raises(Exception, match="isolated"):
        Preprocessor().fit(from_arrays(lone, ("t",), "v"), ("t",)).count()
    with pytest.raises(ValueError, match="packed"):
        Preprocessor().fit([from_arrays(dead, ("t",), "v"), from_arrays(dead, ("t",), "v")], ("t",))
    path = str(tmp_path / "cells")
    table(spark, x).write.parquet(path)
    assert Preprocessor().fit(read_field(spark, path), ("time",)).p == 3
