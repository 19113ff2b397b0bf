import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eigenweave import operators as O
from eigenweave.plans import matrix as M

from .data import grid, long, pivot, table


def test_no_group_of_a_sum_has_more_parts_than_the_fan(spark):
    n, fan = 2000, M.FAN

    def add(t):
        if t.num_rows > fan:
            raise RuntimeError(f"{t.num_rows} parts in one group")
        parts = [np.frombuffer(p.as_py()) for p in t.column("part")]
        return pa.table({"at": t.column("at")[:1], "part": pa.array([sum(parts).tobytes()], pa.binary())})

    def make(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in (0, 7):
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(ids), pa.int64()), pa.array([np.array([float(i), at]).tobytes() for i in ids], pa.binary()), b.column(0)], names=["at", "part", "task"])

    parts = spark.range(n, numPartitions=4).mapInArrow(make, "at long, part binary, task long")
    got = {r["at"]: np.frombuffer(r["part"]) for r in M.tree(parts, n, "at", add, "at long, part binary").collect()}
    assert set(got) == {0, 7} and all(np.allclose(v, [n * (n - 1) / 2, n * at]) for at, v in got.items())


def test_tasks_are_told_by_the_plan(spark, tmp_path):
    assert M.tasks(spark.range(10, numPartitions=2000)) == 2000
    assert M.tasks(spark.range(10).repartition(300)) == 300
    spark.range(10).write.parquet(str(tmp_path / "t"))
    assert M.tasks(spark.read.parquet(str(tmp_path / "t"))) >= 1


def test_a_sum_over_many_partitions(spark):
    x = np.random.default_rng(0).normal(size=(300, 3))
    m = O.EOF("all").fit(table(spark, x).repartition(150), "time")
    assert np.allclose(m.data["explained_variance"], np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 299)
    out = M.total(spark.range(500, numPartitions=100), (2,), lambda b: np.array([float(b.num_rows), np.asarray(b.column(0)).sum()]))
    assert out.tolist() == [500, 499 * 250]


@pytest.mark.parametrize("make", [lambda: O.EOF(n_modez=9), lambda: O.MCA(2, alhpa=1), lambda: O.EOF(sample_name="s"), lambda: O.EOFRotator(2, powre=2), lambda: O.SparsePCA(2, alfa=1), lambda: O.HilbertCCA(2, paddding="exp")])
def test_unknown_parameters_are_refused(make):
    with pytest.raises(TypeError, match="has no parameter"):
        make()


def test_bootstrap_projects_and_rebuilds(spark):
    df = long(spark, grid()).cache()
    base = O.EOF(20).fit(df, "time")
    m = O.EOFBootstrapper(3, seed=2).fit(base)
    s, t = (pivot(d, ["time"], ["n", "mode"]) for d in (m.scores(), m.transform(df)))
    assert np.allclose(s, t) and np.allclose(pivot(O.EOFBootstrapper(3, seed=2).fit_transform(base, df), ["time"], ["n", "mode"]), s)
    back = m.inverse_transform(m.scores())
    assert back.count() == 3 * df.count()
    want = pivot(df, ["time"], ["lat", "lon"])
    for n in (1, 2, 3):
        v = m.data["components"][n - 1]
        c = want - want.mean(0)
        assert np.allclose(pivot(back.where(F.col("n") == n), ["time"], ["lat", "lon"]), c @ v @ v.T + want.mean(0))


def test_a_sketch_in_blocks_is_the_same(spark):
    x = np.random.default_rng(1).normal(size=(60, 8)) @ np.diag([9, 7, 5, 3, 1, 1, 1, 1])
    df = table(spark, x).cache()
    a, b = (O.SparsePCA(2, alpha=1e-4, solver="randomized", n_blocks=n).fit(df, "time") for n in (1, 3))
    assert np.allclose(a.data["components"], b.data["components"], atol=1e-6)
