"""Matrix algebra in DuckDB SQL, to check models by other means than their own: a matrix is a list of doubles, row by row.

Every function returns text: an expression, or common table expressions for `WITH RECURSIVE`. A table that holds matrices has one row a key.
"""

from __future__ import annotations


def mm(a: str, b: str, n: int, k: int, m: int) -> str:
    """n x k times k x m."""
    return f"list_transform(range({n * m}), lambda e: list_sum(list_transform(range({k}), lambda z: {a}[(e // {m}) * {k} + z + 1] * {b}[z * {m} + e % {m} + 1])))"


def tr(a: str, n: int, m: int) -> str:
    """Transpose of n x m."""
    return f"list_transform(range({n * m}), lambda e: {a}[(e % {n}) * {m} + e // {n} + 1])"


def plus(a: str, b: str) -> str:
    return f"list_transform(range(len({a})), lambda e: {a}[e + 1] + {b}[e + 1])"


def times(a: str, by: str) -> str:
    return f"list_transform({a}, lambda x: x * ({by}))"


def eigen(name: str, source: str, matrix: str, p: int, keys: str = "", sweeps: int = 9) -> str:
    """Tables ending in `name` (keys, l, v): eigenvalues of a symmetric p x p matrix, greatest first, and eigenvectors as columns, by Jacobi rotations."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)] or [(0, 0)]
    steps, pp, k = sweeps * len(pairs) if p > 1 else 0, p * p, f"{keys}, " if keys else ""
    at = lambda m, r, c: f"{m}[({r}) * {p} + ({c}) + 1]"
    turn = lambda m: f"list_transform(range({pp}), lambda e: CASE WHEN e % {p} = i THEN c * {at(m, f'e // {p}', 'i')} - s * {at(m, f'e // {p}', 'j')} WHEN e % {p} = j THEN s * {at(m, f'e // {p}', 'i')} + c * {at(m, f'e // {p}', 'j')} ELSE {m}[e + 1] END)"
    rows = f"list_transform(range({pp}), lambda e: CASE WHEN e // {p} = i THEN c * {at('b', 'i', f'e % {p}')} - s * {at('b', 'j', f'e % {p}')} WHEN e // {p} = j THEN s * {at('b', 'i', f'e % {p}')} + c * {at('b', 'j', f'e % {p}')} ELSE b[e + 1] END)"
    return f"""{name}_j AS (
  SELECT {k}0 AS step, {matrix} AS a, list_transform(range({pp}), lambda e: CASE WHEN e // {p} = e % {p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM {source}
  UNION ALL
  SELECT {k}step + 1, {rows}, w FROM (SELECT {k}step, i, j, c, s, {turn('a')} AS b, {turn('v')} AS w
    FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s
      FROM (SELECT *, CASE WHEN {at('a', 'i', 'j')} = 0 THEN 0.0 ELSE (CASE WHEN h >= 0 THEN 1 ELSE -1 END) / (abs(h) + sqrt(h * h + 1)) END AS t
        FROM (SELECT *, CASE WHEN {at('a', 'i', 'j')} = 0 THEN 0.0 ELSE ({at('a', 'j', 'j')} - {at('a', 'i', 'i')}) / (2 * {at('a', 'i', 'j')}) END AS h
          FROM (SELECT *, {[i for i, _ in pairs]}[step % {len(pairs)} + 1] AS i, {[j for _, j in pairs]}[step % {len(pairs)} + 1] AS j FROM {name}_j WHERE step < {steps})))))),
{name}_o AS (SELECT *, list_transform(list_reverse_sort(list_transform(range({p}), lambda k: {{'x': {at('a', 'k', 'k')}, 'k': k}})), lambda q: q.k) AS o FROM {name}_j WHERE step = {steps}),
{name} AS (SELECT {k}list_transform(o, lambda k: {at('a', 'k', 'k')}) AS l, list_transform(range({pp}), lambda e: v[(e // {p}) * {p} + o[e % {p} + 1] + 1]) AS v FROM {name}_o)"""


def power(of: str, exponent: float, p: int) -> str:
    """A power of the matrix whose eigenvalues and vectors the table or alias `of` has."""
    return f"list_transform(range({p * p}), lambda e: list_sum(list_transform(range({p}), lambda z: {of}.v[(e // {p}) * {p} + z + 1] * {of}.l[z + 1] ** ({exponent}) * {of}.v[(e % {p}) * {p} + z + 1])))"


def products(name: str, left: str, right: str) -> str:
    """Table `name` (m): sums over rows of the products of cells, left features by right features; cells are (r, f, x)."""
    return f"{name} AS (SELECT list(x ORDER BY i, j) AS m FROM (SELECT a.f AS i, b.f AS j, sum(a.x * b.x) AS x FROM {left} a JOIN {right} b USING (r) GROUP BY ALL))"


def embedded(name: str, source: str) -> str:
    """Complex cells (r, f, re, im) as real ones, twice as many either way; sums of products become those of the Hermitian products."""
    return f"""{name} AS (SELECT r || '.0' AS r, '0' || f AS f, re AS x FROM {source} UNION ALL SELECT r || '.0', '1' || f, -im FROM {source}
  UNION ALL SELECT r || '.1', '0' || f, im FROM {source} UNION ALL SELECT r || '.1', '1' || f, re FROM {source})"""


def cross(x: str, y: str, px: int, py: int, alpha: tuple[float, float]) -> str:
    """Tables ending in `svd`: tx, ty (whitening), s (singular values), u (px x py) and v (py x py) of the whitened cross-covariance.

    `x` and `y` are tables of cells (r, f, x), a table n (n) has the number of samples. v has columns in order, u = K v / s.
    """
    t = lambda side, p, a: f"{power(side, (a - 1) / 2, p)}" if a < 1 else f"list_transform(range({p * p}), lambda e: CASE WHEN e // {p} = e % {p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return ",\n".join([
        products("gxx", x, x), products("gyy", y, y), products("gxy", x, y),
        f"nxx AS (SELECT {times('m', '1.0::DOUBLE / n')} AS m FROM gxx, n)", f"nyy AS (SELECT {times('m', '1.0::DOUBLE / n')} AS m FROM gyy, n)",
        eigen("ex", "nxx", "m", px), eigen("ey", "nyy", "m", py),
        f"gc AS (SELECT {times('m', '1.0::DOUBLE / (n - 1)')} AS c FROM gxy, n)",
        f"tw AS (SELECT {t('ex', px, alpha[0])} AS tx, {t('ey', py, alpha[1])} AS ty, c FROM ex, ey, gc)",
        f"k1 AS (SELECT tx, ty, {mm('tx', 'c', px, px, py)} AS c FROM tw)", f"k2 AS (SELECT tx, ty, {mm('c', 'ty', px, py, py)} AS k FROM k1)",
        f"k3 AS (SELECT k, {tr('k', px, py)} AS kt FROM k2)", f"k4 AS (SELECT {mm('kt', 'k', py, px, py)} AS m FROM k3)",
        eigen("ek", "k4", "m", py),
        f"k5 AS (SELECT tx, ty, v, list_transform(l, lambda z: sqrt(greatest(z, 0))) AS s, {mm('k', 'v', px, py, py)} AS kv FROM k2, ek)",
        f"svd AS (SELECT tx, ty, s, v, list_transform(range({px * py}), lambda e: kv[e + 1] / s[e % {py} + 1]) AS u FROM k5)",
    ])


def varimax2(source: str, rows: int) -> str:
    """Tables ending in `turned`: loadings l (rows x 2) of `source` turned by varimax, rows of unit length, in closed form: (l, cos, sin)."""
    x, y, size = "l[2 * r + 1]", "l[2 * r + 2]", "(l[2 * r + 1] ** 2 + l[2 * r + 2] ** 2)"
    u, w = f"(({x}) ** 2 - ({y}) ** 2) / {size}", f"2 * {x} * {y} / {size}"
    over = lambda e: f"list_sum(list_transform(range({rows}), lambda r: {e}))"
    return f"""vm AS (SELECT l, {over(u)} AS a, {over(w)} AS b, {over(f'({u}) ** 2 - ({w}) ** 2')} AS c, {over(f'2 * ({u}) * ({w})')} AS d FROM {source}),
vn AS (SELECT l, atan2(d - 2 * a * b / {rows}, c - (a * a - b * b) / {rows}) / 4 AS phi FROM vm),
turned AS (SELECT list_transform(range({2 * rows}), lambda e: CASE WHEN e % 2 = 0 THEN l[e + 1] * cos(phi) + l[e + 2] * sin(phi) ELSE l[e + 1] * cos(phi) - l[e] * sin(phi) END) AS l, cos(phi) AS cos, sin(phi) AS sin FROM vn)"""
