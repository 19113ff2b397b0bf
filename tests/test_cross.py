import numpy as np
import pytest

from eigenweave import operators as O
from eigenweave.functions.linalg import matrix_power

from .data import pivot, table, values

N = 60


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(142)
    t = np.linspace(0, 50, N)
    a = np.sin(t)[:, None] + rng.normal(0, 0.4, (N, 3))
    b = np.stack([a[:, 0], a[:, 1] ** 3, np.sqrt(np.abs(a[:, 2])), rng.normal(size=N)], axis=1)
    return a, b


@pytest.fixture(scope="module")
def fields(spark, xy):
    return table(spark, xy[0], ("time", "f")).cache(), table(spark, xy[1], ("time", "g")).cache()


def direct(xy, ax, ay):
    """The model by plain NumPy on the centred data."""
    a, b = (v - v.mean(0) for v in xy)
    ta, tb = (np.eye(v.shape[1]) if al == 1 else matrix_power(v.T @ v / N, (al - 1) / 2) for v, al in ((a, ax), (b, ay)))
    u, s, vt = np.linalg.svd((a @ ta).T @ (b @ tb) / (N - 1))
    return a, b, ta, tb, u, s, vt.T


@pytest.mark.parametrize(("kind", "alpha"), [("MCA", (1, 1)), ("CCA", (0, 0)), ("RDA", (0, 1)), ("CPCCA", (0.5, 0.5))])
def test_models(fields, xy, kind, alpha):
    m = getattr(O, kind)(2, use_pca=False, **({"alpha": alpha[0]} if kind == "CPCCA" else {})).fit(*fields, "time")
    a, b, ta, tb, u, s, v = direct(xy, *alpha)
    assert np.allclose(values(m.singular_values()), s[:2])
    sx, sy = (pivot(d, ["time"]) for d in m.scores())
    flip = np.sign((sx * (a @ ta @ u[:, :2])).sum(0))
    assert np.allclose(sx, a @ ta @ u[:, :2] * flip) and np.allclose(sy, b @ tb @ v[:, :2] * flip)
    assert np.allclose(pivot(m.transform(fields[0]), ["time"]), sx)
    assert np.allclose(pivot(m.transform(Y=fields[1], normalized=True), ["time"]), sy / np.linalg.norm(sy, axis=0))
    # measures, by the residual definitions
    c = a.T @ b / (N - 1)
    total = (c**2).sum()
    assert np.isclose(m.data["total_squared_covariance"], total)
    scf, fx, fy, fyx = [], [], [], []
    root = matrix_power(a.T @ a / (N - 1), -0.5)
    ia, ib = (np.linalg.inv(t) for t in (ta, tb))
    for k in range(2):
        da, db = a - np.outer(a @ ta @ u[:, k], u[:, k]) @ ia, b - np.outer(b @ tb @ v[:, k], v[:, k]) @ ib
        scf.append(1 - ((da.T @ db / (N - 1)) ** 2).sum() / total)
        fx.append(1 - (da**2).sum() / (a**2).sum())
        fy.append(1 - (db**2).sum() / (b**2).sum())
        fyx.append(1 - ((root @ da.T @ db / (N - 1)) ** 2).sum() / ((root @ c) ** 2).sum())
    assert np.allclose(values(m.squared_covariance_fraction()), np.maximum(scf, 0))
    assert np.allclose(values(m.fraction_variance_X_explained_by_X()), fx)
    assert np.allclose(values(m.fraction_variance_Y_explained_by_Y()), fy)
    assert np.allclose(values(m.fraction_variance_Y_explained_by_X()), fyx)
    r = [np.corrcoef(sx[:, k], sy[:, k])[0, 1] for k in range(2)]
    assert np.allclose(values(m.cross_correlation_coefficients()), np.array(r) * N / (N - 1))
    assert m.correlation_coefficients_X().count() == 4 and m.correlation_coefficients_Y().count() == 4
    g = sx.T @ sy / (sx**2).sum(0)[None, :]
    assert np.allclose(pivot(m.predict(fields[0]), ["time"]), sx @ (sx.T @ sy / (sx**2).sum(0)))
    assert g.shape == (2, 2)


def test_patterns(fields, xy):
    m = O.MCA(2, use_pca=False).fit(*fields, "time")
    sx, sy = (pivot(d, ["time"]) for d in m.scores())
    (hx, hy), (px, _) = m.homogeneous_patterns()
    (ex, ey), (_, qy) = m.heterogeneous_patterns(correction="fdr_bh")
    corr = lambda v, s: np.array([[np.corrcoef(v[:, i], s[:, k])[0, 1] for k in range(2)] for i in range(v.shape[1])])
    assert np.allclose(pivot(hx, ["f"]), corr(xy[0], sx)) and np.allclose(pivot(hy, ["g"]), corr(xy[1], sy))
    assert np.allclose(pivot(ex, ["f"]), corr(xy[0], sy)) and np.allclose(pivot(ey, ["g"]), corr(xy[1], sx))
    assert (pivot(px, ["f"]) < 1e-3).any() and (pivot(qy, ["g"]) <= 1).all()


def test_full_rank_inverse(fields, xy):
    m = O.CCA(3, use_pca=False).fit(*fields, "time")
    assert np.allclose(pivot(m.inverse_transform(m.scores()[0]), ["time"], ["f"]), xy[0])


def test_pca_and_float_modes(fields):
    whole, reduced = O.MCA(2, use_pca=False).fit(*fields, "time"), O.MCA(2, n_pca_modes="all").fit(*fields, "time")
    assert np.allclose(values(whole.singular_values()), values(reduced.singular_values()))
    assert np.allclose(pivot(whole.components()[0], ["f"]), pivot(reduced.components()[0], ["f"]))
    assert 1 <= O.MCA(0.9, use_pca=False).fit(*fields, "time").singular_values().count() <= 3
    share = values(O.MCA(2, use_pca=False).fit(*fields, "time").covariance_fraction_CD95())
    assert np.isclose(share.sum(), 1)


def test_pairing_is_by_position(spark, xy):
    a, b = table(spark, xy[0][:40], ("time", "f")), table(spark, xy[1][20:], ("time", "g"))
    from pyspark.sql import functions as F

    m = O.MCA(1, use_pca=False).fit(a, b.withColumn("time", F.col("time") + 1000), "time")
    s = np.linalg.svd(np.cov(xy[0][:40].T, xy[1][20:].T)[:3, 3:], compute_uv=False)
    assert np.allclose(values(m.singular_values()), s[:1])
    with pytest.raises(ValueError, match="number of samples"):
        O.MCA(1, use_pca=False).fit(a.where("time < 30"), b, "time")


def test_arguments(fields):
    with pytest.raises(ValueError):
        O.CPCCA(alpha=-1)
    with pytest.raises(ValueError):
        O.CPCCA(standardize=[True, False, True])
    with pytest.raises(ValueError, match="rank"):
        O.MCA(4, use_pca=False).fit(*fields, "time")


@pytest.mark.parametrize("power", [1, 2])
def test_rotator(fields, power):
    base = O.CPCCA(3, alpha=0.5, use_pca=False).fit(*fields, "time")
    m = O.CPCCARotator(3, power=power).fit(base)
    for k in (0, 1):
        assert np.allclose(pivot(m.transform(*[f if i == k else None for i, f in enumerate(fields)]), ["time"]), pivot(m.scores()[k], ["time"]))
    if power == 1:
        rows = [pivot(v, [n]) for v, n in zip(m.components(normalized=False), ("f", "g"))]
        old = [pivot(v, [n]) for v, n in zip(base.components(), ("f", "g"))]
        assert np.allclose(rows[0] @ rows[1].T, old[0] * values(base.singular_values()) @ old[1].T)
    assert (np.diff(values(m.squared_covariance())) <= 1e-12).all()
    assert m.squared_covariance_fraction().count() == 3 and m.rotation_matrix().count() == 9 and m.phi_matrix().count() == 9


def test_complex_and_hilbert(spark, fields, xy):
    rng = np.random.default_rng(9)
    z = xy[0] + 1j * rng.normal(size=xy[0].shape)
    w = xy[1] + 1j * rng.normal(size=xy[1].shape)
    cells = [spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(m)], "time long, f long, re double, im double") for m in (z, w)]
    a, b = z - z.mean(0), w - w.mean(0)
    m = O.ComplexMCA(2, use_pca=False).fit(*cells, "time")
    assert np.allclose(values(m.singular_values()), np.linalg.svd(a.conj().T @ b / (N - 1), compute_uv=False)[:2])
    assert m.components_amplitude()[0].count() == 6 and m.components_phase()[1].count() == 8 and m.scores_phase()[0].count() == 2 * N
    assert values(O.ComplexCCA(2, use_pca=False).fit(*cells, "time").singular_values()).max() <= N / (N - 1) + 1e-9
    assert O.ComplexCPCCARotator(2).fit(m).scores_amplitude()[1].count() == 2 * N
    for kind in (O.HilbertMCA, O.HilbertCCA, O.HilbertRDA, O.HilbertCPCCA):
        h = kind(2).fit(*fields, "time")
        assert (values(h.singular_values()) >= 0).all()
    assert values(O.HilbertCCA(2).fit(*fields, "time").singular_values()).max() <= N / (N - 1) + 1e-9
    with pytest.raises(NotImplementedError):
        h.transform(fields[0])
    assert O.HilbertMCARotator(2).fit(O.HilbertMCA(2).fit(*fields, "time")).components()[0].count() == 6
    assert values(O.ComplexRDA(1, use_pca=False).fit(*cells, "time").singular_values()).shape == (1,)
