import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenweave import operators as O
from eigenweave.functions import geo
from eigenweave.functions.stats import CORRECTIONS, corrected, incomplete_beta, p_values
from eigenweave.streaming.scores import transform_stream, window_fields

from .data import grid, long, pivot, table, values


@pytest.fixture(scope="module")
def df(spark):
    return long(spark, grid()).cache()


def test_multi_cca_of_two_views_is_cca(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(80, 3))
    b = a[:, :2] @ rng.normal(size=(2, 2)) + rng.normal(size=(80, 2))
    views = [table(spark, a, ("t", "f")), table(spark, b, ("t", "g"))]
    m = O.MultiCCA(2, pca=False, eps=1e-9).fit(views, "t")
    cov = np.cov(a.T, b.T)
    k = np.linalg.inv(cov[:3, :3]) @ cov[:3, 3:] @ np.linalg.inv(cov[3:, 3:]) @ cov[3:, :3]
    rho = np.sqrt(np.sort(np.linalg.eigvals(k).real)[::-1][:2])
    assert np.allclose(m.data["eigenvalues"], rho, atol=1e-5)
    s = [pivot(d, ["t"]) for d in m.scores()]
    assert np.allclose([abs(np.corrcoef(s[0][:, j], s[1][:, j])[0, 1]) for j in range(2)], rho, atol=1e-5)
    assert all(np.allclose(pivot(d, ["t"]), e) for d, e in zip(m.transform(views), s))
    loads = pivot(m.components()[0], ["f"])
    c = a - a.mean(0)
    assert np.allclose(loads, [[np.corrcoef(c[:, i], s[0][:, j])[0, 1] for j in range(2)] for i in range(3)], atol=1e-8)
    assert m.explained_covariance_ratio().count() == 2 and m.explained_variance_ratio()[1].count() == 2 and m.weights()[0].count() == 6
    three = O.MultiCCA(2, c=0.1).fit([*views, table(spark, a + b[:, :1], ("t", "h"))], "t")
    assert len(three.scores()) == 3
    with pytest.raises(ValueError, match="samples"):
        O.MultiCCA(1, pca=False).fit([views[0], views[1].where("t > 3")], "t")
    with pytest.raises(ValueError):
        O.MultiCCA(1).fit(views[:1], "t")


def test_bootstrap(spark, df):
    base = O.EOF(2).fit(df, "time")
    a, b, c = (O.EOFBootstrapper(6, seed=s).fit(base) for s in (3, 3, 4))
    va, vb, vc = (m.explained_variance().orderBy("n", "mode").toPandas()["value"].to_numpy() for m in (a, b, c))
    assert np.array_equal(va, vb) and not np.allclose(va, vc)
    assert (a.explained_variance_ratio().toPandas()["value"] <= 1).all()
    s = a.scores().toPandas()
    own = pivot(base.scores(), ["time"])
    for n in range(1, 7):
        one = s[s.n == n].sort_values(["time", "mode"])["value"].to_numpy().reshape(25, 2)
        assert ((one * own).sum(0) > 0).all()
    assert a.components().count() == 6 * 40


def test_bootstrap_draws_every_row_once_on_average(spark, monkeypatch):
    from eigenweave.operators import bootstrap

    monkeypatch.setattr(bootstrap, "ROWS", 10)
    x = np.random.default_rng(1).normal(size=(45, 2))
    m = O.EOFBootstrapper(200, seed=1).fit(O.EOF(2).fit(table(spark, x), "time"))
    assert np.isclose(m.data["total_variance"].mean(), np.var(x, axis=0, ddof=1).sum(), rtol=0.1)


@pytest.mark.parametrize("kind", ["eof", "rotator", "hilbert", "mca", "extended", "pop", "sparse", "multi", "bootstrap"])
def test_save_and_load(spark, df, tmp_path, kind):
    path = str(tmp_path / kind)
    if kind == "mca":
        m = O.MCA(2).fit(df, df.withColumn("value", F.col("value") ** 2), "time")
    elif kind == "multi":
        m = O.MultiCCA(2).fit([df, df.withColumn("value", F.col("value") ** 2)], "time")
    else:
        base = O.EOF(3, use_coslat=True).fit(df, "time")
        m = {"eof": lambda: base, "rotator": lambda: O.EOFRotator(2).fit(base), "hilbert": lambda: O.HilbertEOF(2).fit(df, "time"), "extended": lambda: O.ExtendedEOF(2, 1, 2).fit(df, "time"), "pop": lambda: O.POP(n_pca_modes=3).fit(df, "time"), "sparse": lambda: O.SparsePCA(2).fit(df, "time"), "bootstrap": lambda: O.EOFBootstrapper(3, seed=1).fit(base)}[kind]()
    m.save(path)
    with pytest.raises(Exception, match="(?i)exist"):
        m.save(path)
    m.save(path, overwrite=True, save_data=True)
    back = type(m).load(path, spark)
    assert back.get_params().keys() == m.get_params().keys()
    if kind == "mca":
        assert np.allclose(pivot(back.transform(df), ["time"]), pivot(m.scores()[0], ["time"]))
        assert np.allclose(pivot(back.scores()[1], ["time"]), pivot(m.scores()[1], ["time"]))
    elif kind == "multi":
        assert np.allclose(pivot(back.components()[0], ["lat", "lon"]), pivot(m.components()[0], ["lat", "lon"]))
    elif kind == "bootstrap":
        assert np.allclose(back.data["components"], m.data["components"]) and back.components().count() == 180
    else:
        value = "complex" if kind in ("hilbert", "pop") else "value"
        rows = ["embedding", "lat", "lon"] if kind == "extended" else ["lat", "lon"]
        assert np.allclose(pivot(back.components(), rows, value=value), pivot(m.components(), rows, value=value))
        if kind not in ("hilbert", "extended"):
            assert np.allclose(pivot(back.transform(df), ["time"], value=value), pivot(m.scores(), ["time"], value=value))
    with pytest.raises(ValueError):
        O.OPA.load(path, spark)


def test_saved_without_data(spark, df, tmp_path):
    path = str(tmp_path / "m")
    O.EOF(2).fit(df, "time").save(path)
    with pytest.raises(ValueError, match="without its input"):
        O.EOF.load(path, spark).scores()


def test_beta_and_p_values():
    x = np.linspace(0.01, 0.99, 25)
    for a in (1, 2, 7, 14):
        exact = [sum(math.comb(2 * a - 1, j) * v**j * (1 - v) ** (2 * a - 1 - j) for j in range(a, 2 * a)) for v in x]
        assert np.allclose(incomplete_beta(a, a, x), exact)
    assert np.allclose(p_values([0, 1, -1], 30), [1, 0, 0])
    assert np.isnan(p_values([0.5], 2)).all()


def test_corrections():
    p = np.array([0.01, 0.04, np.nan, 0.03, 0.005])
    for method in CORRECTIONS:
        q = corrected(p, method)
        known = ~np.isnan(p)
        assert np.isnan(q[2]) and (q[known] <= 1).all()
        if not method.startswith("fdr_ts"):
            assert (q[known] >= p[known]).all()
    assert np.allclose(corrected(p, "holm")[[4, 0, 3, 1]], [0.02, 0.03, 0.06, 0.06])
    assert np.allclose(corrected(p, "fdr_bh")[[4, 0, 3, 1]], [0.02, 0.02, 0.04, 0.04])
    # Hommel's values are the least level at which closed Simes tests reject
    from itertools import combinations

    q = np.array([0.01, 0.02, 0.03, 0.2])
    closed = []
    for i in range(4):
        worst = 0.0
        for r in range(1, 5):
            for s in combinations(range(4), r):
                if i in s:
                    v = np.sort(q[list(s)])
                    worst = max(worst, (len(v) * v / np.arange(1, len(v) + 1)).min())
        closed.append(worst)
    assert np.allclose(corrected(q, "hommel"), closed)
    with pytest.raises(ValueError):
        corrected(p, "none")


def test_geography(spark):
    pts = np.array([[0.0, 0.0], [90.0, 0.0], [0.0, 90.0]])
    d = geo.distances_np(pts, pts, "haversine")
    assert np.allclose(d[0, 1:], geo.EARTH_KM * np.pi / 2)
    row = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)), geo.euclidean(F.lit(0), F.lit(0), F.lit(3), F.lit(4)), geo.sqrt_cos_lat(F.lit(60.0)), geo.kernel_weight(F.lit(1.0), 2.0, "bisquare")).first()
    assert np.allclose(row, [d[0, 1], 5, np.sqrt(0.5), 0.5625])
    w, h = geo.bounding_halfwidth(60.0, 500.0)
    assert w > h
    assert geo.latitude_dim(["Lat", "lon"]) == "Lat"
    with pytest.raises(ValueError):
        geo.latitude_dim(["lat", "lats"])


def test_stream(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(20, 3))
    m = O.EOF(2).fit(table(spark, x), "time")
    packed = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + [(98, None), (99, [1.0])], "time long, v array<double>")
    packed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time long, v array<double>").parquet(str(tmp_path / "in"))
    q = transform_stream(m, stream, ["time"], "v").writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("scored").orderBy("time").collect()
    assert len(got) == 22 and got[20]["scores"] is None and got[21]["scores"] is None
    assert np.allclose([r["scores"] for r in got[:20]], pivot(m.scores(), ["time"]))
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert [r["value"] for r in window_fields(events, "ts", ["kind"], "v", "1 hour", "10 minutes").collect()] == [3.0]
    assert values(m.explained_variance()).shape == (2,)
