"""Dense algebra on matrices that the driver holds: signs, powers, rotations, sparse loadings, eigenproblems."""

from __future__ import annotations

import warnings

import numpy as np

TINY = np.finfo(float).eps


def herm(a: np.ndarray) -> np.ndarray:
    return a.conj().T


def signs(v: np.ndarray, axis: int = 0) -> np.ndarray:
    """Per mode +1 where the greatest entry is at least the least one in modulus, else -1; complex entries by their real part."""
    r = np.real(v)
    return np.where(np.abs(r.max(axis=axis)) >= np.abs(r.min(axis=axis)), 1.0, -1.0)


def matrix_power(c: np.ndarray, power: float) -> np.ndarray:
    """Power of a Hermitian non-negative matrix on its range."""
    s, u = np.linalg.eigh((c + herm(c)) / 2)
    keep = s > max(TINY, s.max(initial=0.0) * TINY * len(s))
    return (u[:, keep] * s[keep] ** power) @ herm(u[:, keep])


def inverse(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


def polar(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unitary polar factor and singular values."""
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    return u @ vt, s


def varimax(x: np.ndarray, gamma: float = 1.0, max_iter: int = 1000, rtol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Orthomax rotation of row-normalised loadings: (rotated loadings, rotation). Rounds of the usual fixed point; if they creep, turns of pairs finish it."""
    n, k = x.shape
    if k < 2:
        raise ValueError("a rotation needs at least two modes")
    size = np.sqrt((np.abs(x) ** 2).sum(axis=1, keepdims=True))
    unit = x / (size + TINY)
    turn, before = np.eye(k, dtype=x.dtype), 0.0
    for _ in range(max_iter):
        b = unit @ turn
        power = np.abs(b) ** 2
        turn, s = polar(herm(unit) @ (b * (power - gamma / n * power.sum(axis=0))))
        now = s.sum()
        if now == 0 or abs(now - before) / now < rtol:
            return (unit @ turn) * size, turn
        before = now
    turn = planar_turns(unit, turn, gamma, max_iter, rtol)
    return (unit @ turn) * size, turn


def planar_turns(unit: np.ndarray, turn: np.ndarray, gamma: float, max_iter: int, rtol: float) -> np.ndarray:
    """The orthomax rotation from `turn` on, by sweeps over pairs of columns. Two columns need one turn, however flat the criterion is; of more, each is turned at most `max_iter` times.

    A turn of two columns x, y is a unit vector u: |x|^2 - |y|^2 becomes u r, with r = (|x|^2 - |y|^2, 2 Re x* y, 2 Im x* y) in each row. The criterion is a
    quadratic form of u, so that its greatest eigenvector is the best turn of the pair.
    """
    n, k = unit.shape
    form = lambda r: (r - r.mean(axis=0)).T @ (r - r.mean(axis=0)) + (1 - gamma) / n * np.outer(r.sum(axis=0), r.sum(axis=0))
    for _ in range(max_iter // (k - 1)):
        b, gain = unit @ turn, 0.0
        for i in range(k):
            for j in range(i + 1, k):
                x, y = b[:, i], b[:, j]
                z = 2 * x.conj() * y
                m = form(np.stack([np.abs(x) ** 2 - np.abs(y) ** 2, z.real, z.imag] if np.iscomplexobj(b) else [x**2 - y**2, z], axis=1))
                values, vectors = np.linalg.eigh(m)
                u = vectors[:, -1] * (1.0 if vectors[0, -1] >= 0 else -1.0)
                c = np.sqrt((1 + u[0]) / 2)
                s = (u[1] - 1j * u[2] if len(u) > 2 else u[1]) / (2 * c)
                pair = np.array([[c, -np.conj(s)], [s, c]])
                b[:, [i, j]], turn[:, [i, j]] = b[:, [i, j]] @ pair, turn[:, [i, j]] @ pair
                gain += (values[-1] - m[0, 0]) / 2
        if gain <= rtol * np.trace(form(np.abs(b) ** 2)):
            return turn
    raise RuntimeError(f"the rotation did not settle in {max_iter} rounds, nor by turns of pairs")


def promax(x: np.ndarray, power: float = 1, max_iter: int = 1000, rtol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Varimax, then an oblique turn towards powered loadings: (loadings, rotation, correlation of the factors)."""
    if power < 1:
        raise ValueError("power must be 1 or more")
    x, turn = varimax(x, max_iter=max_iter, rtol=rtol)
    size = np.sqrt((np.abs(x) ** 2).sum(axis=1, keepdims=True))
    unit = x / (size + TINY)
    peak = np.abs(unit).max(axis=0)
    scaled = unit / np.where(peak > 0, peak, 1.0)
    goal = scaled * np.abs(scaled) ** (power - 1)
    fit = np.linalg.solve(herm(unit) @ unit, herm(unit) @ goal)
    fit = fit * np.sqrt(np.real(np.diag(inverse(herm(fit) @ fit))))
    back = inverse(fit)
    return (unit @ fit) * size, turn @ fit, back @ herm(back)


def rotation_inverse(turn: np.ndarray, power: float) -> np.ndarray:
    """Transposed inverse of a rotation: the rotation itself while it is orthogonal."""
    return turn if power == 1 else herm(inverse(turn))


def soft_l1(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def soft_l0(x: np.ndarray, t: float) -> np.ndarray:
    return np.where(x * x < 2 * t, 0.0, x)


def sparse_loadings(v: np.ndarray, d: np.ndarray, k: int, alpha: float, beta: float, regularizer: str, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(B sparse, A orthonormal, singular values of the last fit) from right singular vectors `v` and singular values `d`: alternating projection and proximal steps."""
    prox = {"l1": soft_l1, "l0": soft_l0}[regularizer]
    top = d[0] ** 2 if len(d) else 0.0
    alpha, beta = alpha * top, beta * top
    step = 1.0 / (top + beta)
    b, before = v[:, :k].copy(), np.inf
    gram = lambda m: v @ ((d**2)[:, None] * (v.T @ m))
    for n in range(max_iter):
        a, s = polar(gram(b))
        b = prox(b + step * (gram(a - b) - beta * b), step * alpha)
        rest = (v * d).T - (((v * d).T @ b) @ a.T)
        now = 0.5 * (rest**2).sum() + alpha * np.abs(b).sum() + 0.5 * beta * (b**2).sum()
        if n and abs(before - now) <= tol * now:
            break
        before = now
    return b, a, s


def robust_loadings(x: np.ndarray, k: int, alpha: float, beta: float, gamma: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `sparse_loadings`, with a sparse error matrix of `x` estimated alongside."""
    _, d, vt = np.linalg.svd(x, full_matrices=False)
    top = d[0] ** 2
    alpha, beta = alpha * top, beta * top
    step, b, noise, before = 1.0 / (top + beta), vt[:k].T.copy(), np.zeros_like(x), np.inf
    for n in range(max_iter):
        clean, proj = x - noise, x @ b
        a, s = polar(clean.T @ proj)
        b = soft_l1(b + step * (x.T @ ((clean - proj @ a.T) @ a) - beta * b), step * alpha)
        rest = x - (x @ b) @ a.T
        noise = soft_l1(rest, gamma)
        rest = rest - noise
        now = 0.5 * (rest**2).sum() + alpha * np.abs(b).sum() + 0.5 * beta * (b**2).sum() + gamma * np.abs(noise).sum()
        if n and abs(before - now) <= tol * now:
            break
        before = now
    return b, a, s


def generalised_eigh(c: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest solutions of C w = l D w, D positive definite: (values, vectors), vectors D-orthonormal."""
    low = np.linalg.cholesky((d + d.T) / 2)
    m = np.linalg.solve(low, np.linalg.solve(low, (c + c.T) / 2).T)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-values)[:k]
    return values[order], np.linalg.solve(low.T, vectors[:, order])


def explained_modes(variance: np.ndarray, fraction: float, total: float) -> int:
    """How many modes reach a fraction of the total variance; all, with a warning, if none does."""
    share = np.cumsum(variance) / total
    if share[-1] < fraction:
        warnings.warn(f"{len(share)} modes explain {share[-1]:.3f} of the variance, less than {fraction}", stacklevel=3)
        return len(share)
    return int((share < fraction).sum()) + 1
