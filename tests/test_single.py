import numpy as np
import pytest

from eigenweave import operators as O
from eigenweave.functions.hilbert import hilbert
from eigenweave.plans.matrix import RowMatrix
from eigenweave.plans.preprocess import Preprocessor
from eigenweave.plans.series import analytic_rows, embed, lagged_products
from eigenweave.plans.svd import decompose

from .data import grid, long, pivot, same_up_to_sign, table, values


@pytest.fixture(scope="module")
def x():
    return grid()


@pytest.fixture(scope="module")
def df(spark, x):
    return long(spark, x).cache()


@pytest.fixture(scope="module")
def eof(df):
    return O.EOF(3).fit(df, "time")


def centred(x):
    f = x.reshape(len(x), -1)
    return f - f.mean(0)


def test_eof_equals_svd(x, eof):
    u, s, vt = np.linalg.svd(centred(x), full_matrices=False)
    assert np.allclose(values(eof.singular_values()), s[:3])
    assert np.allclose(values(eof.explained_variance()), s[:3] ** 2 / 24)
    assert np.allclose(values(eof.explained_variance_ratio()), s[:3] ** 2 / (s**2).sum())
    v = pivot(eof.components(), ["lat", "lon"])
    assert same_up_to_sign(v, vt[:3].T)
    assert (np.abs(v.max(0)) >= np.abs(v.min(0))).all()
    assert same_up_to_sign(pivot(eof.scores(), ["time"]), u[:, :3] * s[:3])
    assert same_up_to_sign(pivot(eof.scores(normalized=True), ["time"]), u[:, :3])
    assert same_up_to_sign(pivot(eof.components(normalized=False), ["lat", "lon"]), vt[:3].T * s[:3])


def test_eof_transform_and_inverse(spark, x, df, eof):
    assert np.allclose(pivot(eof.transform(df), ["time"]), pivot(eof.scores(), ["time"]))
    full = O.EOF("all", standardize=True, use_coslat=True).fit(df, "time")
    assert np.allclose(pivot(full.inverse_transform(full.scores()), ["time"], ["lat", "lon"]), x.reshape(25, 20))
    one = eof.inverse_transform(eof.scores().where("mode = 1"))
    v, s = pivot(eof.components(), ["lat", "lon"])[:, :1], pivot(eof.scores(), ["time"])[:, :1]
    assert np.allclose(pivot(one, ["time"], ["lat", "lon"]), s @ v.T + x.reshape(25, 20).mean(0))


def test_missing_samples_come_back_as_null(spark, x):
    y = x.copy()
    y[3] = np.nan
    y[:, 2] = np.nan
    m = O.EOF(2).fit(long(spark, y), "time")
    s, c = m.scores().toPandas(), m.components().toPandas()
    assert s["value"].isna().sum() == 2 and len(s) == 50
    assert c["value"].isna().sum() == 8 and len(c) == 40


def test_modes(df):
    with pytest.raises(ValueError, match="rank"):
        O.EOF(21).fit(df, "time")
    with pytest.raises(ValueError):
        O.EOF(0)
    with pytest.raises(ValueError):
        O.EOF(1.5)
    with pytest.raises(ValueError):
        O.EOF("most")
    m = O.EOF(0.5).fit(df, "time")
    share = values(m.explained_variance_ratio()).cumsum()
    assert share[-1] >= 0.5 and (len(share) == 1 or share[-2] < 0.5)


def test_randomised_agrees(x, df):
    m = Preprocessor().fit(df, ("time",))
    a, b = decompose(m, 4), decompose(m, 4, solver="randomized", random_state=3)
    assert np.allclose(a.s, b.s) and np.allclose(a.v, b.v, atol=1e-3) and np.isclose(a.total, b.total)
    with pytest.raises(ValueError):
        decompose(m, 2, solver="fast")


def test_lazy(df):
    m = O.EOF(2, compute=False).fit(df, "time")
    assert not m.data
    assert m.explained_variance().count() == 2
    with pytest.raises(ValueError, match="fit"):
        O.EOF(2).components()
    assert m.get_params()["n_modes"] == 2


def test_complex_eof(spark):
    t, p = np.linspace(0, 4 * np.pi, 40), np.linspace(-5, 5, 8)
    z = 1 / np.cosh(p + 3) * np.exp(2.3j * t[:, None]) + 2 / np.cosh(p) * np.tanh(p) * np.exp(2.8j * t[:, None])
    cells = spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(z)], "time long, x long, re double, im double")
    m = O.ComplexEOF(2).fit(cells, "time")
    c = z - z.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(values(m.singular_values()), s[:2])
    v, score = pivot(m.components(), ["x"], value="complex"), pivot(m.scores(), ["time"], value="complex")
    assert np.allclose(score, c @ v)
    assert np.allclose(pivot(m.components_amplitude(), ["x"]), np.abs(v)) and np.allclose(pivot(m.components_phase(), ["x"]), np.angle(v))
    assert np.allclose(pivot(m.scores_amplitude(normalized=False), ["time"]), np.abs(score)) and np.allclose(pivot(m.scores_phase(), ["time"]), np.angle(score))
    assert np.allclose(pivot(m.inverse_transform(m.scores()), ["time"], ["x"], "complex"), z, atol=1e-6)
    with pytest.warns(UserWarning, match="real"):
        O.ComplexEOF(1).fit(long(spark, grid()), "time")


def test_hilbert(spark, x, df):
    m = Preprocessor().fit(df, ("time",))
    got = analytic_rows(m, "exp", 0.2)
    rows = got.df.orderBy("time").collect()
    y = np.array([r["__x"] for r in rows]) + 1j * np.array([r["__xi"] for r in rows])
    assert np.allclose(y, hilbert(centred(x), "exp", 0.2))
    assert np.allclose(hilbert(centred(x), None).real, centred(x))
    h = O.HilbertEOF(2).fit(df, "time")
    assert np.allclose(values(h.singular_values()), np.linalg.svd(y, compute_uv=False)[:2])
    assert "value" in h.inverse_transform(h.scores()).columns
    with pytest.raises(NotImplementedError):
        h.transform(df)


def test_hilbert_of_a_wave():
    t = np.arange(64)
    y = hilbert(np.cos(2 * np.pi * t / 16), None)
    assert np.allclose(y.imag, np.sin(2 * np.pi * t / 16))


def numpy_embedding(c, copies, tau):
    n = len(c) - (copies - 1) * tau
    return np.concatenate([c[k * tau : k * tau + n] for k in range(copies)], axis=1)


def test_extended_eof(x, df):
    m = O.ExtendedEOF(2, tau=2, embedding=3).fit(df, "time")
    e = numpy_embedding(centred(x), 3, 2)
    e = e - e.mean(0)
    s = np.linalg.svd(e, compute_uv=False)
    assert np.allclose(values(m.singular_values()), s[:2])
    comp = m.components()
    assert {r[0] for r in comp.select("embedding").distinct().collect()} == {0, 2, 4}
    v = pivot(comp, ["embedding", "lat", "lon"])
    scores = m.scores().toPandas().sort_values(["time", "mode"])["value"].to_numpy().reshape(25, 2)
    assert np.isnan(scores[21:]).all() and np.allclose(scores[:21], e @ v)
    plain = O.ExtendedEOF(2, tau=1, embedding=1).fit(df, "time")
    assert np.allclose(values(plain.explained_variance()), values(O.EOF(2).fit(df, "time").explained_variance()))
    reduced = O.ExtendedEOF(2, tau=2, embedding=3, n_pca_modes=20).fit(df, "time")
    assert np.allclose(values(reduced.singular_values()), s[:2])


def test_lags_over_groups_of_rows(spark, monkeypatch):
    from eigenweave.plans import order

    monkeypatch.setattr(order.with_halo, "__defaults__", (8,))
    x = np.random.default_rng(5).normal(size=(70, 3))
    m = Preprocessor().fit(table(spark, x), ("time",))
    c = x - x.mean(0)
    for lag, (n, p) in lagged_products(m, [0, 1, 5]).items():
        assert n == 70 - lag and np.allclose(p, c[: 70 - lag].T @ c[lag:])
    e = embed(m, 3, 2)
    got = np.array([r["__x"] for r in e.df.orderBy("time").collect() if r["__x"] is not None])
    assert np.allclose(got, numpy_embedding(c, 3, 2))


def test_pop(x, df):
    m = O.POP(n_pca_modes=4).fit(df, "time")
    c = centred(x)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    z = c @ vt[:4].T
    a = z[1:].T @ z[:-1] @ np.linalg.inv(z[:-1].T @ z[:-1])
    want = np.linalg.eigvals(a)
    got = values(m.eigenvalues())
    assert np.allclose(sorted(np.abs(got)), sorted(np.abs(want)))
    assert np.allclose(values(m.damping_times()), -1 / np.log(np.abs(got)))
    s = pivot(m.scores(), ["time"], value="complex")
    assert np.allclose(pivot(m.transform(df), ["time"], value="complex"), s)
    norms = m.data["norms"]
    assert (np.diff(norms) <= 1e-12).all() and np.allclose(s.std(0), norms)
    assert np.allclose(pivot(m.components(), ["lat", "lon"], value="complex"), pivot(m.components(normalized=True), ["lat", "lon"], value="complex") * norms)
    assert m.scores_amplitude().count() == 100 and m.components_phase().count() == 80
    assert O.POP(2, n_pca_modes=4, truncate=True).fit(df, "time").eigenvalues().count() == 2


def test_opa(x, df):
    m = O.OPA(3, tau_max=4, n_pca_modes=6).fit(df, "time")
    s = pivot(m.scores(), ["time"])
    assert np.allclose(np.cov(s.T), np.eye(3), atol=1e-8)
    lam = values(m.decorrelation_time())
    assert (np.diff(lam) <= 1e-12).all() and (lam >= 0).all()
    f, w = pivot(m.filter_patterns(), ["lat", "lon"]), pivot(m.components(), ["lat", "lon"])
    assert np.allclose(f.T @ w / 24, np.eye(3) * (f.T @ w / 24).diagonal(), atol=1e-5)
    with pytest.raises(ValueError):
        O.OPA(5, 3, n_pca_modes=4)
    for call in (m.transform, m.inverse_transform):
        with pytest.raises(NotImplementedError):
            call(df)


def test_sparse_pca(x, df):
    free = O.SparsePCA(2, alpha=0.0, beta=0.0).fit(df, "time")
    s = np.linalg.svd(centred(x), compute_uv=False)
    assert np.allclose(values(free.explained_variance()), s[:2] ** 2 / 24)
    some = O.SparsePCA(2, alpha=0.05).fit(df, "time")
    b = pivot(some.components(), ["lat", "lon"])
    assert (b == 0).sum() > 0
    assert np.allclose(pivot(some.scores(), ["time"]), centred(x) @ b)
    assert np.allclose(pivot(some.transform(df), ["time"]), centred(x) @ b)
    hard = pivot(O.SparsePCA(2, alpha=0.05, regularizer="l0").fit(df, "time").components(), ["lat", "lon"])
    assert (hard == 0).sum() > 0
    assert O.SparsePCA(2, robust=True).fit(df, "time").explained_variance().count() == 2
    with pytest.raises(ValueError):
        O.SparsePCA(regularizer="l2")
    with pytest.raises(NotImplementedError):
        O.SparsePCA(regularizer="l0", robust=True)


@pytest.mark.parametrize("kernel", ["bisquare", "gaussian", "exponential"])
def test_gwpca(spark, x, kernel):
    from eigenweave.functions.geo import distances_np, kernel_weight_np

    from .data import LAT, LON

    m = O.GWPCA(2, bandwidth=3000.0, kernel=kernel).fit(long(spark, x[:4]), ("lat", "lon"))
    f = x[:4].reshape(4, 20).T
    f = f - f.mean(0)
    xy = np.array([(lon, lat) for lat in LAT for lon in LON])
    w = kernel_weight_np(distances_np(xy, xy, "haversine"), 3000.0, kernel)
    want, ratio = [], []
    for k in range(20):
        mean = (w[k][:, None] * f).sum(0) / w[k].sum()
        s = np.linalg.svd(np.sqrt(w[k])[:, None] * (f - mean), compute_uv=False) ** 2 / w[k].sum()
        want.append(s[:2]), ratio.append(s[:2] / s.sum())
    assert np.allclose(pivot(m.explained_variance(), ["lat", "lon"]), want)
    assert np.allclose(pivot(m.explained_variance_ratio(), ["lat", "lon"]), ratio)
    comp = m.components().toPandas()
    assert np.allclose(comp.groupby(["lat", "lon", "mode"])["value"].apply(lambda v: (v**2).sum()), 1)
    assert m.largest_locally_weighted_components().count() == 40
    for call in (m.scores, lambda: m.transform(None), lambda: m.inverse_transform(None)):
        with pytest.raises(NotImplementedError):
            call()


def test_gwpca_around_the_globe(spark):
    """Samples on both sides of the date line and near a pole, against all pairs."""
    from eigenweave.functions.geo import distances_np, kernel_weight_np

    rng = np.random.default_rng(4)
    xy = np.concatenate([np.stack([rng.uniform(-180, 180, 60), rng.uniform(-89, 89, 60)], 1), np.stack([rng.choice([-179.5, 179.5, 178.0], 20), rng.uniform(-5, 5, 20)], 1), np.stack([rng.uniform(-180, 180, 20), rng.uniform(85, 90, 20)], 1)])
    v = rng.normal(size=(100, 2))
    df = spark.createDataFrame([(float(a), float(b), k, float(v[i, k])) for i, (a, b) in enumerate(xy) for k in (0, 1)], "lon double, lat double, f long, value double")
    got = {(r["lon"], r["lat"]): r["value"] for r in O.GWPCA(1, bandwidth=900.0).fit(df, ("lon", "lat")).explained_variance().collect()}
    c = v - v.mean(0)
    w = kernel_weight_np(distances_np(xy, xy, "haversine"), 900.0, "bisquare")
    for i, (a, b) in enumerate(xy):
        m = (w[i][:, None] * c).sum(0) / w[i].sum()
        cov = (w[i][:, None] * (c - m)).T @ (c - m) / w[i].sum()
        assert np.isclose(got[a, b], np.linalg.eigvalsh(cov)[-1], atol=1e-9)


def test_gwpca_blocks_and_arguments(spark, monkeypatch):
    from eigenweave.operators import gwpca

    rng = np.random.default_rng(3)
    pts, v = rng.uniform(0, 10, (60, 2)), rng.normal(size=(60, 2))
    rows = [(float(a), float(b), k, float(v[i, k])) for i, (a, b) in enumerate(pts) for k in (0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, f long, value double")
    whole = O.GWPCA(1, bandwidth=3.0, metric="euclidean").fit(df, ("x", "y")).explained_variance().toPandas().sort_values(["x", "y"])["value"].to_numpy()
    monkeypatch.setattr(gwpca, "BLOCK", 5)
    split = O.GWPCA(1, bandwidth=3.0, metric="euclidean").fit(df, ("x", "y")).explained_variance().toPandas().sort_values(["x", "y"])["value"].to_numpy()
    assert np.allclose(whole, split)
    with pytest.raises(ValueError):
        O.GWPCA(1, 3.0, metric="cosine")
    with pytest.raises(ValueError):
        O.GWPCA(1, 3.0, kernel="flat")
    with pytest.raises(ValueError, match="coords"):
        O.GWPCA(1, 3.0).fit(df, ("x", "y"))


def test_row_matrix_products(spark):
    x = np.random.default_rng(2).normal(size=(50, 4))
    m = Preprocessor(with_center=False).fit(table(spark, x), ("time",))
    n, g = m.moments()
    assert n == 50 and np.allclose(g, x.T @ x)
    q = np.eye(4)[:, :2]
    assert np.allclose(m.back_and_forth(q), x.T @ x @ q)
    n, small, square = m.small_gram(q)
    assert n == 50 and np.allclose(small, q.T @ x.T @ x @ q) and np.isclose(square, (x**2).sum())
    assert isinstance(m.times(q), RowMatrix)
