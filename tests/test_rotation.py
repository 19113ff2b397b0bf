import numpy as np
import pytest

from eigenweave import operators as O
from eigenweave.functions.linalg import planar_turns, promax, varimax

from .data import grid, long, pivot, table, values


def test_varimax_maximises_and_stays_orthogonal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    y, turn = varimax(x)
    assert np.allclose(turn.T @ turn, np.eye(3)) and np.allclose(x @ turn, y)

    def spread(m):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        return (u**2).var(axis=0).sum()

    best = spread(y)
    for _ in range(50):
        q, _ = np.linalg.qr(turn + 0.05 * rng.normal(size=(3, 3)))
        assert spread(x @ q) <= best + 1e-9


def test_promax_correlations():
    x = np.random.default_rng(1).normal(size=(30, 3))
    y, turn, phi = promax(x, 4)
    assert np.allclose(np.diag(phi), 1, atol=1e-6) and np.allclose(y @ np.linalg.inv(turn), x)
    _, _, identity = promax(x, 1)
    assert np.allclose(identity, np.eye(3), atol=1e-6)
    with pytest.raises(ValueError):
        varimax(x[:, :1])
    with pytest.raises(RuntimeError):
        varimax(x, max_iter=1)


@pytest.mark.parametrize("power", [1, 2])
def test_eof_rotator(spark, power):
    df = long(spark, grid()).cache()
    base = O.EOF(4).fit(df, "time")
    m = O.EOFRotator(4, power=power).fit(base)
    assert (np.diff(values(m.explained_variance())) <= 0).all()
    s = pivot(m.scores(), ["time"])
    assert np.allclose(pivot(m.transform(df), ["time"]), s)
    if power == 1:
        assert np.isclose(values(m.explained_variance()).sum(), values(base.explained_variance()).sum())
        a, b = base.inverse_transform(base.scores()), m.inverse_transform(m.scores())
        assert np.allclose(pivot(a, ["time"], ["lat", "lon"]), pivot(b, ["time"], ["lat", "lon"]))
        assert np.allclose((s**2).sum(0), m.data["norms"] ** 2)
    assert m.rotation_matrix().count() == 16 and m.phi_matrix().count() == 16
    with pytest.raises(NotImplementedError):
        m.fit_transform(df, "time")


def test_factory_and_complex_rotators(spark):
    df = long(spark, grid()).cache()
    h = O.HilbertEOF(3).fit(df, "time")
    m = O.RotatorFactory(n_modes=2).create_rotator(h).fit(h)
    assert isinstance(m, O.HilbertEOFRotator) and m.components_amplitude().count() == 40
    with pytest.raises(NotImplementedError):
        m.transform(df)
    assert isinstance(O.RotatorFactory().create_rotator(O.EOF()), O.EOFRotator)
    assert isinstance(O.RotatorFactory().create_rotator(O.MCA()), O.MCARotator)
    with pytest.raises(TypeError):
        O.RotatorFactory().create_rotator(O.OPA(1, 1))


def simplicity(loadings):
    """What varimax maximises, for rows of unit length."""
    u = np.abs(loadings / np.linalg.norm(loadings, axis=1, keepdims=True)) ** 2
    return (u**2).sum() - (u.sum(axis=0) ** 2).sum() / len(u)


def complex_table(spark, m, name):
    return spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(m)], f"t long, {name} long, re double, im double")


def unitary(theta, phi):
    return np.array([[np.cos(theta), -np.sin(theta) * np.exp(1j * phi)], [np.sin(theta) * np.exp(-1j * phi), np.cos(theta)]])


GRID = [unitary(t, f) for t in np.linspace(0, np.pi / 2, 60) for f in np.linspace(0, 2 * np.pi, 60)]


def test_complex_eof_rotator_against_all_turns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6)) + 1j * rng.normal(size=(40, 6))
    x[:, :3] += 2 * (rng.normal(size=40) + 1j * rng.normal(size=40))[:, None]
    base = O.ComplexEOF(2).fit(complex_table(spark, x, "f"), "t")
    m = O.ComplexEOFRotator(2).fit(base)
    assert type(O.RotatorFactory(n_modes=2).create_rotator(base)) is O.ComplexEOFRotator
    start = base.data["components"] * np.sqrt(base.data["explained_variance"])
    turned = m.data["components"] * np.sqrt(m.data["explained_variance"])
    assert np.allclose(turned @ turned.conj().T, start @ start.conj().T)
    assert simplicity(turned) >= max(simplicity(start @ u) for u in GRID) - 1e-9
    assert np.allclose(pivot(m.transform(complex_table(spark, x, "f")), ["t"], value="complex"), pivot(m.scores(), ["t"], value="complex"))


@pytest.mark.parametrize("model, rotator", [(O.ComplexMCA, O.ComplexMCARotator), (O.ComplexCPCCA, O.ComplexCPCCARotator)])
def test_complex_rotators_of_two_fields_against_all_turns(spark, model, rotator):
    rng = np.random.default_rng(5)
    x, y = (rng.normal(size=(60, p)) + 1j * rng.normal(size=(60, p)) for p in (3, 4))
    y[:, :2] += 2 * x[:, :2]
    base = model(2, use_pca=False).fit(complex_table(spark, x, "f"), complex_table(spark, y, "g"), "t")
    m = rotator(2).fit(base)
    assert type(O.RotatorFactory(n_modes=2).create_rotator(base)) is rotator
    root = np.sqrt(base.data["singular_values"])
    start = np.concatenate([s.physical(base.data[f"components{k}"]) * root for k, s in enumerate(base.sides, 1)])
    turned = start @ m.data["rotation_matrix"]
    assert simplicity(turned) >= max(simplicity(start @ u) for u in GRID) - 1e-9
    squared = []
    for k in range(2):
        back = [s.t.conj().T @ s.basis.conj().T @ part[:, k] for s, part in zip(base.sides, (turned[:3], turned[3:]), strict=True)]
        squared.append((np.linalg.norm(back[0]) * np.linalg.norm(back[1])) ** 2)
    assert np.allclose(values(m.squared_covariance()), sorted(squared, reverse=True))


@pytest.mark.parametrize("model, rotator", [(O.HilbertMCA, O.HilbertMCARotator), (O.HilbertCPCCA, O.HilbertCPCCARotator), (O.HilbertEOF, O.HilbertEOFRotator)])
def test_hilbert_rotators(spark, model, rotator):
    a, b = long(spark, grid()).cache(), long(spark, grid(3)).cache()
    data = (a,) if model is O.HilbertEOF else (a, b)
    base = model(2).fit(*data, "time")
    m = O.RotatorFactory(n_modes=2).create_rotator(base).fit(base)
    assert type(m) is rotator
    if model is O.HilbertEOF:
        start = base.data["components"] * np.sqrt(base.data["explained_variance"])
    else:
        start = np.concatenate([s.physical(base.data[f"components{k}"]) for k, s in enumerate(base.sides, 1)]) * np.sqrt(base.data["singular_values"])
    assert simplicity(start @ m.data["rotation_matrix"]) >= max(simplicity(start @ u) for u in GRID) - 1e-9
    with pytest.raises(NotImplementedError):
        m.transform(*data)


def all_but_one_pattern(n, k, kind=float):
    """Loadings that differ little from row to row: the usual rounds creep."""
    rng = np.random.default_rng(9)
    draw = lambda *shape: rng.normal(size=shape) + (1j * rng.normal(size=shape) if kind is complex else 0)
    return np.concatenate([np.ones((n, 1)), np.zeros((n, k - 1))], axis=1) + 1e-3 * draw(n, k)


@pytest.mark.parametrize("kind", [float, complex])
@pytest.mark.parametrize("k", [2, 3])
def test_creeping_rotations_settle(kind, k):
    x = all_but_one_pattern(12, k, kind)
    y, turn = varimax(x, rtol=1e-14)
    assert np.allclose(turn.conj().T @ turn, np.eye(k), atol=1e-12) and np.allclose(x @ turn, y, atol=1e-12)
    best = simplicity(y)
    rng = np.random.default_rng(10)
    for size in (1e-4, 1e-2, 1.0):
        for _ in range(100):
            q, _ = np.linalg.qr(turn + size * (rng.normal(size=(k, k)) + (1j * rng.normal(size=(k, k)) if kind is complex else 0)))
            assert simplicity(x @ q) <= best * (1 + 1e-9)
    if k == 2:
        turns = GRID if kind is complex else [unitary(t, 0.0).real for t in np.linspace(0, np.pi / 2, 400)]
        assert best >= max(simplicity(x @ u) for u in turns)


def test_pairs_go_where_the_rounds_go():
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=(20, 3)), rng.normal(size=(20, 3)) + 1j * rng.normal(size=(20, 3))):
        y, turn = varimax(x, rtol=1e-4)
        exact, _ = varimax(x, rtol=1e-14)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert np.allclose(np.abs(x @ planar_turns(unit, turn, 1.0, 1000, 1e-14)), np.abs(exact), atol=1e-5)


def test_hilbert_mca_rotator_of_fields_with_one_common_course(spark):
    t, rng = np.arange(33.0), np.random.default_rng(12)
    course = np.minimum(np.minimum(t, 32 - t), 3.0)[:, None]
    a, b = (1000 * course + rng.normal(size=(33, p)) for p in (2, 3))
    base = O.HilbertMCA(2, use_pca=False).fit(table(spark, a), table(spark, b, ("time", "g")), "time")
    m = O.HilbertMCARotator(2).fit(base)
    start = np.concatenate([s.physical(base.data[f"components{k}"]) for k, s in enumerate(base.sides, 1)]) * np.sqrt(base.data["singular_values"])
    turned = start @ m.data["rotation_matrix"]
    assert simplicity(turned) >= max(simplicity(start @ u) for u in GRID)
    squared = (np.linalg.norm(turned[:2], axis=0) * np.linalg.norm(turned[2:], axis=0)) ** 2
    assert np.allclose(values(m.squared_covariance()), sorted(squared, reverse=True))
