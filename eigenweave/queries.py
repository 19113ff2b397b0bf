"""Queries over the driver's tables, one for each operator, and DuckDB SQL for the same rows wherever SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from . import sqlmath as M
from .functions import geo
from .functions.stats import CORRECTIONS, corrected
from .operators.base import small
from .plans.field import Field
from .plans.lineage import shared_folder
from .plans.preprocess import Preprocessor
from .plans.series import analytic_rows, lagged_products
from .sources.tables import from_arrays

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, date: str | None = None):
    """Register a query; a column `date` is compared as text."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({date}::VARCHAR AS {date}) FROM ({sql})" if date else sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names or ("value",)} | {c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


# -- inputs -------------------------------------------------------------------------------------------------------------
def days(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Sums of events by day and kind."""
    e = table(spark, sf_dir, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(*kinds))
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.sum("value").alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover by month and priority, 0 where there was none."""
    o = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    kinds = [r[0] for r in o.select("priority").distinct().orderBy("priority").collect()]  # five priorities
    sums = o.groupBy("month").agg(*[F.coalesce(F.sum(F.when(F.col("priority") == k, F.col("o_totalprice"))), F.lit(0.0)).alias(k) for k in kinds])
    return sums.unpivot("month", kinds, "priority", "value")


def nations(spark: SparkSession, sf_dir: str, *segments: str) -> DataFrame:
    """Mean balances by nation and market segment, at invented coordinates."""
    c = table(spark, sf_dir, "customer")
    if segments:
        c = c.where(F.col("c_mktsegment").isin(*segments))
    k = F.col("c_nationkey")
    return c.groupBy((k * 14 - 170).cast("double").alias("lon"), (k * 5 - 60).cast("double").alias("lat"), F.col("c_mktsegment").alias("segment")).agg(F.avg("c_acctbal").alias("value"))


DAYS = "d AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, sum(value) AS x FROM events GROUP BY ALL)"
#: Cells (r, f, x) of the five kinds, centred, and their number of samples.
CELLS = DAYS + ", cells AS (SELECT day::VARCHAR AS r, kind AS f, x - avg(x) OVER (PARTITION BY kind) AS x FROM d), n AS (SELECT count(DISTINCT r) AS n FROM cells)"
#: Eigenvalues l and eigenvectors v, as columns, of the covariance of all kinds; kinds numbered in order.
SPECTRUM = ",\n".join([CELLS, M.products("gram", "cells", "cells"), f"cov AS (SELECT {M.times('m', '1.0::DOUBLE / (n - 1)')} AS m, n FROM gram, n)", M.eigen("eig", "cov", "m", 5),
                       "ks AS (SELECT f AS kind, row_number() OVER (ORDER BY f) - 1 AS k FROM (SELECT DISTINCT f FROM cells)), modes AS (SELECT unnest(range(1, 6))::INT AS mode)"])
#: Patterns (kind, mode, v): of unit length, the greatest entry in modulus positive.
PATTERNS = SPECTRUM + """, raw AS (SELECT kind, mode, v[k * 5 + mode] AS v FROM eig, ks, modes),
vec AS (SELECT kind, mode, v * CASE WHEN abs(max(v) OVER m) >= abs(min(v) OVER m) THEN 1 ELSE -1 END AS v FROM raw WINDOW m AS (PARTITION BY mode))"""


# -- functions ----------------------------------------------------------------------------------------------------------
@query("fn_sqrt_cos_lat", "SELECT n_nationkey, round(sqrt(greatest(0, least(1, cos(radians(n_nationkey * 5 - 60))))), 9) AS weight FROM nation")
def fn_sqrt_cos_lat(spark, sf_dir):
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey", geo.sqrt_cos_lat(F.col("n_nationkey") * 5 - 60).alias("weight")), 9, "weight")


_DIST = """n AS (SELECT n_nationkey AS k, radians(n_nationkey * 14 - 170) AS x, radians(n_nationkey * 5 - 60) AS y FROM nation),
h AS (SELECT a.k AS k, b.k AS other, sin((b.y - a.y) / 2) ** 2 + cos(a.y) * cos(b.y) * sin((b.x - a.x) / 2) ** 2 AS h FROM n a, n b),
g AS (SELECT k, other, 2 * 6371.0 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))) AS km FROM h)"""


@query("fn_distance_kernels", f"WITH {_DIST} SELECT k, other, round(km, 6) AS km, round(CASE WHEN km <= 5000 THEN (1 - (km / 5000) ** 2) ** 2 ELSE 0 END, 9) AS bisquare, round(exp(-0.5 * (km / 5000) ** 2), 9) AS gaussian, round(exp(-0.5 * km / 5000), 9) AS exponential FROM g")
def fn_distance_kernels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 14 - 170).alias("x"), (F.col("n_nationkey") * 5 - 60).alias("y"))
    b = n.select(F.col("k").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    km = F.col("km")
    out = n.join(F.broadcast(b), F.lit(True)).select("k", "other", geo.haversine(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("km"))  # 25 nations
    out = out.select("k", "other", "km", *[geo.kernel_weight(km, 5000, kind).alias(kind) for kind in geo.KERNELS])
    return rounded(rounded(out, 6, "km"), 9, *geo.KERNELS)


@query("fn_multiple_tests", """WITH p AS (SELECT DISTINCT p_size AS k, (p_size * 7919 % 10007) / 10007.0::DOUBLE AS p FROM part),
r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM p), c AS (SELECT sum(1.0::DOUBLE / i) AS c FROM r)
SELECT k::BIGINT AS k, round(least(1, p * n), 9) AS bonferroni, round(1 - (1 - p) ** n, 9) AS sidak, round(least(1, max(p * (n - i + 1)) OVER up), 9) AS holm, round(max(1 - (1 - p) ** (n - i + 1)) OVER up, 9) AS holm_sidak,
  round(least(1, min(p * (n - i + 1)) OVER down), 9) AS simes_hochberg, round(least(1, min(p * n / i) OVER down), 9) AS fdr_bh, round(least(1, min(p * n / i * c) OVER down), 9) AS fdr_by
FROM r, c WINDOW up AS (ORDER BY i ROWS UNBOUNDED PRECEDING), down AS (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)""")
def fn_multiple_tests(spark, sf_dir):
    """One test for each size of parts: a family that the driver holds, whatever the number of parts."""
    k = np.array([r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()], np.int64)
    p = (k * 7919 % 10007) / 10007.0
    kinds = [c for c in CORRECTIONS if c not in ("hommel", "fdr_tsbh", "fdr_tsbky")]
    out = small(spark, k=k, **{c.replace("-", "_"): corrected(p, c) for c in kinds})
    return rounded(out.withColumn("k", F.col("k").cast("long")), 9, *[c for c in out.columns if c != "k"])


# -- preprocessing ------------------------------------------------------------------------------------------------------
def preprocessed(pre: Preprocessor, x, dims) -> DataFrame:
    """The scaled cells of the kept samples and features."""
    long = pre.fit(x, dims).long("__f", first=0).where("value is not null")
    names = None
    for b in pre.blocks:
        own = pre._feature_frame(b)
        names = own if names is None else names.unionByName(own, allowMissingColumns=True)
    return long.join(F.broadcast(names), "__f").drop("__f", "variable")


@query("pre_center", f"WITH {DAYS} SELECT day, kind, round(x - avg(x) OVER (PARTITION BY kind), 6) AS value FROM d", date="day")
def pre_center(spark, sf_dir):
    return rounded(preprocessed(Preprocessor(), days(spark, sf_dir), ("day",)), 6)


@query("pre_standardize", f"WITH {DAYS} SELECT day, kind, round((x - avg(x) OVER k) / greatest(stddev_pop(x) OVER k, 1.1920929e-7), 8) AS value FROM d WINDOW k AS (PARTITION BY kind)", date="day")
def pre_standardize(spark, sf_dir):
    return rounded(preprocessed(Preprocessor(with_std=True), days(spark, sf_dir), ("day",)), 8)


@query("pre_coslat", """WITH g AS (SELECT (c_nationkey * 14 - 170)::DOUBLE AS lon, (c_nationkey * 5 - 60)::DOUBLE AS lat, c_mktsegment AS segment, avg(c_acctbal) AS x FROM customer GROUP BY ALL)
SELECT lon, lat, segment, round((x - avg(x) OVER (PARTITION BY lon, lat)) * sqrt(greatest(0, least(1, cos(radians(lat))))), 6) AS value FROM g""")
def pre_coslat(spark, sf_dir):
    return rounded(preprocessed(Preprocessor(with_coslat=True), nations(spark, sf_dir), ("segment",)), 6)


@query("pre_sanitize", """WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS priority, sum(o_totalprice) AS x FROM orders GROUP BY ALL),
o AS (SELECT m.month, p.priority, coalesce(s.x, 0) AS x FROM (SELECT DISTINCT month FROM s) m CROSS JOIN (SELECT DISTINCT priority FROM s) p LEFT JOIN s ON s.month = m.month AND s.priority = p.priority),
v AS (SELECT month, priority, CASE WHEN month(month) = 3 OR priority LIKE '2%' THEN NULL ELSE x END AS x FROM o)
SELECT month, priority, round(x - avg(x) OVER (PARTITION BY priority), 4) AS value FROM v WHERE x IS NOT NULL""", date="month")
def pre_sanitize(spark, sf_dir):
    gap = (F.month("month") == 3) | F.col("priority").startswith("2")
    return rounded(preprocessed(Preprocessor(), monthly(spark, sf_dir).withColumn("value", F.when(gap, F.lit(float("nan"))).otherwise(F.col("value"))), ("month",)), 4)


@query("pre_concat", """WITH a AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, sum(value) AS x FROM events GROUP BY ALL),
b AS (SELECT CAST(ts AS DATE) AS day, event_type || '-n' AS kind, count(*)::DOUBLE AS x FROM events GROUP BY ALL)
SELECT day, kind, round(x - avg(x) OVER (PARTITION BY kind), 6) AS value FROM (FROM a UNION ALL FROM b)""", date="day")
def pre_concat(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.concat("event_type", F.lit("-n")).alias("kind")).agg(F.count("*").cast("double").alias("value"))
    return rounded(preprocessed(Preprocessor(), [days(spark, sf_dir), n], ("day",)), 6)


# -- one field ----------------------------------------------------------------------------------------------------------
@query("eof_explained_variance", f"WITH RECURSIVE {SPECTRUM} SELECT mode, round(l[mode], 3) AS value FROM eig, modes")
def eof_explained_variance(spark, sf_dir):
    return rounded(O.EOF("all").fit(days(spark, sf_dir), "day").explained_variance(), 3)


@query("eof_explained_variance_ratio", f"WITH RECURSIVE {SPECTRUM} SELECT mode, round(l[mode] / list_sum(l), 9) AS value FROM eig, modes WHERE mode <= 3")
def eof_explained_variance_ratio(spark, sf_dir):
    return rounded(O.EOF(3).fit(days(spark, sf_dir), "day").explained_variance_ratio(), 9)


@query("eof_singular_values", f"WITH RECURSIVE {SPECTRUM} SELECT mode, round(sqrt(l[mode] * (n - 1)), 5) AS value FROM eig, n, modes WHERE mode <= 2")
def eof_singular_values(spark, sf_dir):
    return rounded(O.EOF(2, solver="randomized").fit(days(spark, sf_dir), "day").singular_values(), 5)


@query("eof_components", f"WITH RECURSIVE {PATTERNS} SELECT kind, mode, round(v, 6) AS value FROM vec")
def eof_components(spark, sf_dir):
    return rounded(O.EOF("all").fit(days(spark, sf_dir), "day").components(), 6)


_SCORES = f"WITH RECURSIVE {PATTERNS} SELECT r AS day, mode, round(sum(x * v), 3) AS value FROM cells JOIN vec ON f = kind GROUP BY ALL"


@query("eof_scores", _SCORES)
def eof_scores(spark, sf_dir):
    return rounded(O.EOF("all").fit(days(spark, sf_dir), "day").scores(), 3)


@query("eof_transform", _SCORES)
def eof_transform(spark, sf_dir):
    x = days(spark, sf_dir)
    return rounded(O.EOF("all").fit(x, "day").transform(x), 3)


@query("eof_inverse_transform", f"WITH {DAYS} SELECT day, kind, round(x, 4) AS value FROM d", date="day")
def eof_inverse_transform(spark, sf_dir):
    m = O.EOF("all").fit(days(spark, sf_dir), "day")
    return rounded(m.inverse_transform(m.scores(normalized=True), normalized=True), 4)


def _variances(cells: str, p: int, modes: int, dual: bool = False) -> str:
    """All eigenvalues of the covariance of centred cells (r, f, x); `dual`: of the samples' products, which has the same ones."""
    left = "(SELECT f AS r, r AS f, x FROM cells)" if dual else "cells"
    return ",\n".join([cells, "n AS (SELECT count(DISTINCT r) AS n FROM cells)", M.products("gram", left, left), f"cov AS (SELECT {M.times('m', '1.0::DOUBLE / (n - 1)')} AS m FROM gram, n)", M.eigen("eig", "cov", "m", p)]) + f" SELECT mode, round(l[mode], 3) AS value FROM eig, (SELECT unnest(range(1, {modes + 1}))::INT AS mode)"


@query("eof_multivariate", "WITH RECURSIVE " + _variances("""d AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, sum(value) AS s, count(*)::DOUBLE AS c FROM events GROUP BY ALL),
u AS (SELECT day::VARCHAR AS r, kind || '-s' AS f, s AS x FROM d UNION ALL SELECT day::VARCHAR, kind || '-c', c FROM d), cells AS (SELECT r, f, x - avg(x) OVER (PARTITION BY f) AS x FROM u)""", 10, 10))
def eof_multivariate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("number"))
    m = O.EOF("all").fit(Field.of(e, ("day", "kind"), ("total", "number")), "day")
    return rounded(m.explained_variance(), 3)


@query("eof_tmode", "WITH RECURSIVE " + _variances(f"{DAYS}, cells AS (SELECT kind AS r, day::VARCHAR AS f, x - avg(x) OVER (PARTITION BY day) AS x FROM d)", 5, 4, dual=True))
def eof_tmode(spark, sf_dir):
    return rounded(O.EOF(4).fit(days(spark, sf_dir), "kind").explained_variance(), 3)


@query("eof_embeddings", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
v AS (SELECT k, var_samp(x) AS v FROM e GROUP BY k) SELECT round(sum(v), 8) AS total FROM v""")
def eof_embeddings(spark, sf_dir):
    m = O.EOF("all").fit(from_arrays(table(spark, sf_dir, "embeddings"), ("vec_id",), "embedding", "k"), "vec_id")
    return rounded(m.explained_variance().agg(F.sum("value").alias("total")), 8, "total")


@query("eof_save_load", f"WITH RECURSIVE {PATTERNS} SELECT kind, mode, round(v, 6) AS value FROM vec")
def eof_save_load(spark, sf_dir):
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    O.EOF("all").fit(days(spark, sf_dir), "day").save(path)
    return rounded(O.EOF.load(path, spark).components(), 6)


def complex_days(spark, sf_dir, counts: bool = False) -> DataFrame:
    """Three complex features of the five kinds, from sums or counts: click + i error, view + i purchase, signup."""
    w = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(*[(F.count(F.when(F.col("event_type") == k, 1)).cast("double") if counts else F.sum(F.when(F.col("event_type") == k, F.col("value")))).alias(k) for k in ("click", "error", "purchase", "signup", "view")])
    cells = [F.struct(F.lit(f).alias("f"), re.alias("re"), im.alias("im")) for f, re, im in (("a", F.col("click"), F.col("error")), ("b", F.col("view"), F.col("purchase")), ("c", F.col("signup"), F.lit(0.0)))]
    return w.select("day", F.inline(F.array(*cells)))


def _complex(name: str, value: str) -> str:
    return f"""{name}_w AS (SELECT day, unnest([{{'f': 'a', 're': a, 'im': p}}, {{'f': 'b', 're': b, 'im': q}}, {{'f': 'c', 're': s, 'im': 0.0::DOUBLE}}]) AS u FROM (SELECT CAST(ts AS DATE) AS day,
    {value} FILTER (WHERE event_type = 'click') AS a, {value} FILTER (WHERE event_type = 'error') AS p, {value} FILTER (WHERE event_type = 'view') AS b, {value} FILTER (WHERE event_type = 'purchase') AS q, {value} FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY ALL)),
{name}_c AS (SELECT day::VARCHAR AS r, u.f AS f, u.re - avg(u.re) OVER (PARTITION BY u.f) AS re, u.im - avg(u.im) OVER (PARTITION BY u.f) AS im FROM {name}_w), {M.embedded(name, name + '_c')}"""


_COMPLEX = ",\n".join([_complex("cx", "sum(value)"), "n AS (SELECT count(DISTINCT r) AS n FROM cx_c)", M.products("gram", "cx", "cx"), f"cov AS (SELECT {M.times('m', '1.0::DOUBLE / (n - 1)')} AS m FROM gram, n)", M.eigen("eig", "cov", "m", 6), "modes AS (SELECT unnest(range(1, 4))::INT AS mode)"])


@query("complex_eof_explained_variance", f"WITH RECURSIVE {_COMPLEX} SELECT mode, round(l[2 * mode], 3) AS value FROM eig, modes")
def complex_eof_explained_variance(spark, sf_dir):
    return rounded(O.ComplexEOF("all").fit(complex_days(spark, sf_dir), "day").explained_variance(), 3)


@query("complex_eof_components_amplitude", f"WITH RECURSIVE {_COMPLEX} SELECT f, mode, round(sqrt(v[k * 6 + 2 * mode] ** 2 + v[(k + 3) * 6 + 2 * mode] ** 2), 6) AS value FROM eig, modes, (SELECT unnest(['a', 'b', 'c']) AS f, unnest([0, 1, 2]) AS k)")
def complex_eof_components_amplitude(spark, sf_dir):
    return rounded(O.ComplexEOF("all").fit(complex_days(spark, sf_dir), "day").components_amplitude(), 6)


@query("complex_eof_scores_amplitude", f"WITH RECURSIVE {_COMPLEX}, sc AS (SELECT day, mode, sum(re * v[k * 6 + 2 * mode] - im * v[(k + 3) * 6 + 2 * mode]) AS p, sum(re * v[(k + 3) * 6 + 2 * mode] + im * v[k * 6 + 2 * mode]) AS q FROM (SELECT r AS day, re, im, ascii(f) - 97 AS k FROM cx_c), eig, modes GROUP BY ALL) SELECT day, mode, round(sqrt(p * p + q * q), 3) AS value FROM sc")
def complex_eof_scores_amplitude(spark, sf_dir):
    return rounded(O.ComplexEOF("all").fit(complex_days(spark, sf_dir), "day").scores_amplitude(normalized=False), 3)


_HILBERT = DAYS + """, e AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY day) - 1 AS t, day, x - avg(x) OVER (PARTITION BY kind) AS x, count(*) OVER (PARTITION BY kind) AS n FROM d),
g AS (SELECT b.kind, b.t, b.day, b.x, b.n, sum(a.x * CASE WHEN (b.t - a.t + b.n) % b.n = 0 THEN 0
  WHEN b.n % 2 = 0 THEN 2.0 / b.n * sin(pi() * ((b.t - a.t + b.n) % b.n) / 2) ** 2 / tan(pi() * ((b.t - a.t + b.n) % b.n) / b.n)
  ELSE 1.0 / b.n * (1 / tan(pi() * ((b.t - a.t + b.n) % b.n) / b.n) - cos(pi() * ((b.t - a.t + b.n) % b.n)) / sin(pi() * ((b.t - a.t + b.n) % b.n) / b.n)) END) AS y FROM e a JOIN e b USING (kind) GROUP BY ALL),
h AS (SELECT kind, day, n, x, y - avg(y) OVER (PARTITION BY kind) AS y FROM g)"""


@query("hilbert_transform", f"WITH {_HILBERT} SELECT day, kind, round(x, 4) AS re, round(y, 4) AS im FROM h", date="day")
def hilbert_transform(spark, sf_dir):
    pre = Preprocessor()
    m = analytic_rows(pre.fit(days(spark, sf_dir), ("day",)), padding=None)
    return rounded(m.long("__f", first=0).join(F.broadcast(pre._feature_frame(pre.blocks[0])), "__f").drop("__f", "variable"), 4, "re", "im")


#: The same of series three times as long, with fading ends along the trend; the middle third of it.
_PADDED = DAYS + """, e AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY day) - 1 AS t, day, x - avg(x) OVER (PARTITION BY kind) AS x, count(*) OVER (PARTITION BY kind) AS n FROM d),
fit AS (SELECT kind, any_value(n) AS n, regr_slope(x, t) AS b, avg(t) AS tm FROM e GROUP BY kind),
ends AS (SELECT kind, n, b, tm, arg_min(x - b * (t - tm), t) AS lo, arg_max(x - b * (t - tm), t) AS hi FROM e JOIN fit USING (kind, n) GROUP BY ALL),
long AS (SELECT kind, t + n AS t, x, n * 3 AS n FROM e UNION ALL SELECT kind, u + n, b * (u - tm) + lo * exp(-(-1.0 - u) / n / 0.2), n * 3 FROM (SELECT *, unnest(range(-n, 0)) AS u FROM ends)
  UNION ALL SELECT kind, u + n, b * (u - tm) + hi * exp(-(u - n) / n / 0.2), n * 3 FROM (SELECT *, unnest(range(n, 2 * n)) AS u FROM ends)),
g AS (SELECT b.kind, b.t, b.x, b.n, sum(a.x * CASE WHEN (b.t - a.t + b.n) % b.n = 0 THEN 0
  WHEN b.n % 2 = 0 THEN 2.0 / b.n * sin(pi() * ((b.t - a.t + b.n) % b.n) / 2) ** 2 / tan(pi() * ((b.t - a.t + b.n) % b.n) / b.n)
  ELSE 1.0 / b.n * (1 / tan(pi() * ((b.t - a.t + b.n) % b.n) / b.n) - cos(pi() * ((b.t - a.t + b.n) % b.n)) / sin(pi() * ((b.t - a.t + b.n) % b.n) / b.n)) END) AS y FROM long a JOIN long b USING (kind) WHERE b.t >= b.n / 3 AND b.t < b.n / 3 * 2 GROUP BY ALL),
h AS (SELECT g.kind, e.day, g.x, g.y - avg(g.y) OVER (PARTITION BY g.kind) AS y FROM g JOIN e ON e.kind = g.kind AND e.t = g.t - e.n)"""
_analytic = lambda base: ",\n".join([base, "hc AS (SELECT day::VARCHAR AS r, kind AS f, x AS re, y AS im FROM h), n AS (SELECT count(DISTINCT r) AS n FROM hc)", M.embedded("hx", "hc")])
_spectral = lambda base: ",\n".join([_analytic(base), M.products("gram", "hx", "hx"), f"cov AS (SELECT {M.times('m', '1.0::DOUBLE / (n - 1)')} AS m FROM gram, n)", M.eigen("eig", "cov", "m", 10), "modes AS (SELECT unnest(range(1, 6))::INT AS mode), ks AS (SELECT f AS kind, row_number() OVER (ORDER BY f) - 1 AS k FROM (SELECT DISTINCT f FROM hc))"])


@query("hilbert_eof", f"WITH RECURSIVE {_spectral(_HILBERT)} SELECT mode, round(l[2 * mode], 3) AS value FROM eig, modes")
def hilbert_eof(spark, sf_dir):
    return rounded(O.HilbertEOF("all", padding=None).fit(days(spark, sf_dir), "day").explained_variance(), 3)


@query("hilbert_eof_padded", f"WITH RECURSIVE {_spectral(_PADDED)} SELECT kind, mode, round(sqrt(v[k * 10 + 2 * mode] ** 2 + v[(k + 5) * 10 + 2 * mode] ** 2), 6) AS value FROM eig, ks, modes WHERE mode <= 2")
def hilbert_eof_padded(spark, sf_dir):
    return rounded(O.HilbertEOF(2).fit(days(spark, sf_dir), "day").components_amplitude(), 6)


@query("extended_eof", "WITH RECURSIVE " + _variances(f"""{DAYS}, e AS (SELECT day::VARCHAR AS r, kind, x, lead(x, 2) OVER k AS y, lead(x, 4) OVER k AS z FROM d WINDOW k AS (PARTITION BY kind ORDER BY day)),
u AS (SELECT r, unnest([kind || '-0', kind || '-1', kind || '-2']) AS f, unnest([x, y, z]) AS x FROM e WHERE z IS NOT NULL), cells AS (SELECT r, f, x - avg(x) OVER (PARTITION BY f) AS x FROM u)""", 15, 15))
def extended_eof(spark, sf_dir):
    return rounded(O.ExtendedEOF("all", tau=2, embedding=3).fit(days(spark, sf_dir), "day").explained_variance(), 3)


@query("extended_eof_scores", f"""WITH {DAYS}, r AS (SELECT day, kind, x, lead(x, 2) OVER k AS y, lead(x, 4) OVER k AS z FROM d WINDOW k AS (PARTITION BY kind ORDER BY day)),
s AS (SELECT day, (x - avg(x) OVER k) ** 2 + (y - avg(y) OVER k) ** 2 + (z - avg(z) OVER k) ** 2 AS v FROM r WHERE z IS NOT NULL WINDOW k AS (PARTITION BY kind)),
t AS (SELECT day, sum(v) AS v FROM s GROUP BY day) SELECT DISTINCT d.day, round(t.v, 2) AS value FROM d LEFT JOIN t USING (day)""", date="day")
def extended_eof_scores(spark, sf_dir):
    s = O.ExtendedEOF("all", tau=2, embedding=3).fit(days(spark, sf_dir), "day").scores()
    return rounded(s.groupBy("day").agg(F.sum(F.col("value") ** 2).alias("value")), 2)


def halves(spark, sf_dir) -> DataFrame:
    """Two features of all kinds: clicks and views, and the others."""
    kind = F.when(F.col("event_type").isin("click", "view"), "seen").otherwise("done")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), kind.alias("kind")).agg(F.sum("value").alias("value"))


_HALVES = """t AS (SELECT CAST(ts AS DATE) AS day, sum(value) FILTER (WHERE event_type IN ('click', 'view')) AS a, sum(value) FILTER (WHERE event_type NOT IN ('click', 'view')) AS b FROM events GROUP BY ALL),
c AS (SELECT row_number() OVER (ORDER BY day) AS t, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM t)"""
# feedback = C1' C0^-1, C0 of all samples but the last one
_POP = _HALVES + """, l AS (SELECT a, b, lead(a) OVER (ORDER BY t) AS a1, lead(b) OVER (ORDER BY t) AS b1 FROM c),
m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * a1) AS pa, sum(a * b1) AS qa, sum(b * a1) AS pb, sum(b * b1) AS qb FROM l WHERE a1 IS NOT NULL),
f AS (SELECT (pa * bb - pb * ab) / z AS f11, (pb * aa - pa * ab) / z AS f12, (qa * bb - qb * ab) / z AS f21, (qb * aa - qa * ab) / z AS f22 FROM (SELECT *, aa * bb - ab * ab AS z FROM m)),
e AS (SELECT (f11 + f22) / 2 AS half, ((f11 + f22) / 2) ** 2 - (f11 * f22 - f12 * f21) AS disc FROM f),
v AS (SELECT half + CASE WHEN disc >= 0 THEN sqrt(disc) ELSE 0 END AS re, CASE WHEN disc < 0 THEN sqrt(-disc) ELSE 0 END AS im FROM e UNION ALL SELECT half - CASE WHEN disc >= 0 THEN sqrt(disc) ELSE 0 END, CASE WHEN disc < 0 THEN -sqrt(-disc) ELSE 0 END FROM e)"""


@query("pop_eigenvalues", f"WITH {_POP} SELECT round(re, 8) + 0 AS re, round(im, 8) + 0 AS im, round(-1 / ln(sqrt(re * re + im * im)), 6) AS damping_time FROM v")
def pop_eigenvalues(spark, sf_dir):
    m = O.POP(2, use_pca=False).fit(halves(spark, sf_dir), "day")
    out = m.eigenvalues().join(m.damping_times().select("mode", F.col("value").alias("damping_time")), "mode").drop("mode")
    return rounded(rounded(out, 8, "re", "im"), 6, "damping_time")


@query("pop_scores")
def pop_scores(spark, sf_dir):
    return O.POP(2).fit(days(spark, sf_dir), "day").scores_amplitude()


# eigenvalues of C0^-1 S, S the symmetric sum of the lagged covariances
@query("opa_decorrelation_time", f"""WITH {_HALVES}, k AS (SELECT unnest(range(0, 6)) AS lag),
p AS (SELECT lag, CASE WHEN lag IN (0, 5) THEN 0.5 ELSE 1 END AS w, sum(x.a * y.a) / (count(*) - 1) AS aa, sum(x.a * y.b) / (count(*) - 1) AS ab, sum(x.b * y.a) / (count(*) - 1) AS ba, sum(x.b * y.b) / (count(*) - 1) AS bb FROM k, c x JOIN c y ON y.t = x.t + k.lag GROUP BY lag),
s AS (SELECT sum(w * aa) AS saa, sum(w * (ab + ba) / 2) AS sab, sum(w * bb) AS sbb, max(aa) FILTER (WHERE lag = 0) AS caa, max(ab) FILTER (WHERE lag = 0) AS cab, max(bb) FILTER (WHERE lag = 0) AS cbb FROM p),
q AS (SELECT (saa * cbb - 2 * sab * cab + sbb * caa) / z AS tr, (saa * sbb - sab * sab) / z AS det FROM (SELECT *, caa * cbb - cab * cab AS z FROM s)),
r AS (SELECT abs(tr / 2 + sqrt(tr * tr / 4 - det)) AS x, abs(tr / 2 - sqrt(tr * tr / 4 - det)) AS y FROM q)
SELECT 1 AS mode, round(greatest(x, y), 7) AS value FROM r UNION ALL SELECT 2, round(least(x, y), 7) FROM r""")
def opa_decorrelation_time(spark, sf_dir):
    return rounded(O.OPA(2, tau_max=5, n_pca_modes=2).fit(halves(spark, sf_dir), "day").decorrelation_time(), 7)


@query("lagged_covariance", f"""WITH {DAYS}, e AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY day) AS t, x - avg(x) OVER (PARTITION BY kind) AS x FROM d), k AS (SELECT unnest([0, 1, 3])::INT AS lag),
q AS (SELECT kind, row_number() OVER (ORDER BY kind) AS i FROM (SELECT DISTINCT kind FROM d))
SELECT lag, u.i::INT AS i, v.i::INT AS j, round(sum(a.x * b.x) / (count(*) - 1), 4) AS value FROM k, e a JOIN e b ON b.t = a.t + k.lag JOIN q u ON u.kind = a.kind JOIN q v ON v.kind = b.kind GROUP BY ALL""")
def lagged_covariance(spark, sf_dir):
    found = lagged_products(Preprocessor().fit(days(spark, sf_dir), ("day",)), [0, 1, 3])
    lag, i, j, value = [], [], [], []
    for k, (n, c) in sorted(found.items()):
        for (a, b), v in np.ndenumerate(c / (n - 1)):
            lag.append(k), i.append(a + 1), j.append(b + 1), value.append(v)
    return rounded(small(spark, lag=np.array(lag), i=np.array(i), j=np.array(j), value=np.array(value)), 4)


def _local(kernel: str) -> str:
    """Weighted covariances of the five segments around every nation, and their eigenvalues and vectors."""
    return ",\n".join([_DIST.replace("g AS (SELECT k, other", "dist AS (SELECT k, other"), f"""c AS (SELECT c_nationkey AS k, c_mktsegment AS f, avg(c_acctbal) AS x FROM customer GROUP BY ALL), ww AS (SELECT k, other, {kernel} AS w FROM dist),
mu AS (SELECT w.k, f, sum(w * x) / sum(w) AS mu FROM ww w JOIN c ON c.k = w.other GROUP BY ALL), dev AS (SELECT w.k, w.other, w.w, c.f, x - mu AS x FROM ww w JOIN c ON c.k = w.other JOIN mu ON mu.k = w.k AND mu.f = c.f),
cv AS (SELECT k, list(x ORDER BY i, j) AS m FROM (SELECT a.k, a.f AS i, b.f AS j, sum(a.w * a.x * b.x) / sum(a.w) AS x FROM dev a JOIN dev b USING (k, other) GROUP BY ALL) GROUP BY k)""", M.eigen("eig", "cv", "m", 5, keys="k"),
                       "ks AS (SELECT f AS segment, row_number() OVER (ORDER BY f) - 1 AS s FROM (SELECT DISTINCT f FROM c))"])


_PLACE = "(k * 14 - 170)::DOUBLE AS lon, (k * 5 - 60)::DOUBLE AS lat"


@query("gwpca_explained_variance", f"WITH RECURSIVE {_local('CASE WHEN km <= 5000 THEN (1 - (km / 5000) ** 2) ** 2 ELSE 0 END')} SELECT {_PLACE}, mode, round(l[mode], 2) AS value FROM eig, (SELECT unnest([1, 2])::INT AS mode)")
def gwpca_explained_variance(spark, sf_dir):
    return rounded(O.GWPCA(2, bandwidth=5000.0).fit(nations(spark, sf_dir), ("lon", "lat")).explained_variance(), 2)


@query("gwpca_components", f"WITH RECURSIVE {_local('exp(-0.5 * (km / 5000) ** 2)')} SELECT {_PLACE}, mode, segment, round(abs(v[s * 5 + mode]), 5) AS value FROM eig, ks, (SELECT unnest([1, 2])::INT AS mode)")
def gwpca_components(spark, sf_dir):
    m = O.GWPCA(2, bandwidth=5000.0, kernel="gaussian").fit(nations(spark, sf_dir), ("lon", "lat"))
    return rounded(m.components().withColumn("value", F.abs("value")), 5)


@query("gwpca_largest_components", f"WITH RECURSIVE {_local('exp(-0.5 * km / 5000)')} SELECT {_PLACE}, mode, arg_max(segment, abs(v[s * 5 + mode])) AS segment FROM eig, ks, (SELECT unnest([1, 2])::INT AS mode) GROUP BY ALL")
def gwpca_largest_components(spark, sf_dir):
    m = O.GWPCA(2, bandwidth=5000.0, kernel="exponential").fit(nations(spark, sf_dir), ("lon", "lat"))
    return m.largest_locally_weighted_components()


@query("sparse_pca_unpenalised", f"WITH RECURSIVE {SPECTRUM} SELECT mode, round(l[mode], 2) AS value FROM eig, modes WHERE mode <= 2")
def sparse_pca_unpenalised(spark, sf_dir):
    return rounded(O.SparsePCA(2, alpha=0.0, beta=0.0).fit(days(spark, sf_dir), "day").explained_variance(), 2)


# one mode: a the direction of G b, b shrunk after a step towards it; both until nothing moves
@query("sparse_pca_components", f"""WITH RECURSIVE {SPECTRUM}, g AS (SELECT m, l[1] * (n - 1) AS top, list_transform(range(5), lambda z: v[z * 5 + 1]) AS b FROM gram, n, eig),
it AS (SELECT 0 AS step, b, m, top FROM g UNION ALL
  SELECT step + 1, list_transform(range(5), lambda z: sign(q[z + 1]) * greatest(abs(q[z + 1]) - 0.05 / 1.001, 0)), m, top FROM (
    SELECT step, m, top, list_transform(range(5), lambda z: b[z + 1] + (list_sum(list_transform(range(5), lambda y: m[z * 5 + y + 1] * (a[y + 1] - b[y + 1]))) - 0.001 * top * b[z + 1]) / (1.001 * top)) AS q FROM (
      SELECT step, b, m, top, list_transform(gb, lambda x: x / sqrt(list_sum(list_transform(gb, lambda y: y * y)))) AS a FROM (
        SELECT *, list_transform(range(5), lambda z: list_sum(list_transform(range(5), lambda y: m[z * 5 + y + 1] * b[y + 1]))) AS gb FROM it WHERE step < 2000)))),
en AS (SELECT kind, b[k + 1] AS b FROM it, ks WHERE step = 2000) SELECT kind, 1 AS mode, round(abs(b), 4) AS value FROM en""")
def sparse_pca_components(spark, sf_dir):
    m = O.SparsePCA(1, alpha=0.05, beta=1e-3, tol=0.0, max_iter=2000).fit(days(spark, sf_dir), "day")
    return rounded(m.components().withColumn("value", F.abs("value")), 4)


# loadings of the first two modes, turned in closed form
_TURNED = ",\n".join([PATTERNS, "lo AS (SELECT list(vec.v * sqrt(l[mode]) ORDER BY kind, mode) AS l FROM vec, eig WHERE mode <= 2)", M.varimax2("lo", 5)])


def _rotated(table: str) -> str:
    return f"""p AS (SELECT kind, c, {table}[k * 2 + c] AS x FROM turned_, ks, (SELECT unnest([1, 2]) AS c)), z AS (SELECT kind, c, x, sum(x * x) OVER (PARTITION BY c) AS variance FROM p),
o AS (SELECT kind, dense_rank() OVER (ORDER BY variance DESC)::INT AS mode, variance, x / sqrt(variance) * CASE WHEN abs(max(x) OVER (PARTITION BY c)) >= abs(min(x) OVER (PARTITION BY c)) THEN 1 ELSE -1 END AS x FROM z)
SELECT kind, mode, round(x, 5) AS value, round(variance, 1) AS variance FROM o"""


def _patterns_with_variance(m) -> DataFrame:
    v = m.explained_variance().select("mode", F.col("value").alias("variance"))
    return rounded(rounded(m.components().join(F.broadcast(v), "mode"), 5), 1, "variance")


@query("eof_varimax", f"WITH RECURSIVE {_TURNED}, turned_ AS (SELECT l AS t FROM turned), {_rotated('t')}")
def eof_varimax(spark, sf_dir):
    return _patterns_with_variance(O.EOFRotator(2, power=1, rtol=1e-14).fit(O.EOF(4).fit(days(spark, sf_dir), "day")))


# promax: the fit of the unit loadings to their own fourth powers, with columns scaled so that the factors keep unit variance
_PROMAX = _TURNED + """, ur AS (SELECT unnest(range(5)) AS r, l FROM turned), uu AS (SELECT r, size, x / size AS x, y / size AS y FROM (SELECT r, l[2 * r + 1] AS x, l[2 * r + 2] AS y, sqrt(l[2 * r + 1] ** 2 + l[2 * r + 2] ** 2) AS size FROM ur)),
pk AS (SELECT max(abs(x)) AS px, max(abs(y)) AS py FROM uu), gl AS (SELECT r, size, x, y, sign(x) * (abs(x) / px) ** 4 AS gx, sign(y) * (abs(y) / py) ** 4 AS gy FROM uu, pk),
nm AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * gx) AS xg, sum(y * gx) AS yg, sum(x * gy) AS xh, sum(y * gy) AS yh FROM gl),
ft AS (SELECT (yy * xg - xy * yg) / z AS a, (xx * yg - xy * xg) / z AS c, (yy * xh - xy * yh) / z AS b, (xx * yh - xy * xh) / z AS d FROM (SELECT *, xx * yy - xy * xy AS z FROM nm)),
sc AS (SELECT a, b, c, d, sqrt((b * b + d * d) / z) AS s1, sqrt((a * a + c * c) / z) AS s2 FROM (SELECT *, (a * d - b * c) ** 2 AS z FROM ft)),
turned_ AS (SELECT list(w ORDER BY r, j) AS t FROM (SELECT r, 1 AS j, (x * a + y * c) * s1 * size AS w FROM gl, sc UNION ALL SELECT r, 2, (x * b + y * d) * s2 * size FROM gl, sc))"""


@query("eof_promax", f"WITH RECURSIVE {_PROMAX}, {_rotated('t')}")
def eof_promax(spark, sf_dir):
    return _patterns_with_variance(O.EOFRotator(2, power=4, rtol=1e-14).fit(O.EOF(4).fit(days(spark, sf_dir), "day")))


@query("complex_eof_rotator")
def complex_eof_rotator(spark, sf_dir):
    return O.ComplexEOFRotator(2).fit(O.ComplexEOF(3).fit(complex_days(spark, sf_dir), "day")).explained_variance()


@query("hilbert_eof_rotator")
def hilbert_eof_rotator(spark, sf_dir):
    return O.RotatorFactory(n_modes=2).create_rotator(m := O.HilbertEOF(3).fit(days(spark, sf_dir), "day")).fit(m).components_amplitude()


@query("eof_bootstrap")
def eof_bootstrap(spark, sf_dir):
    return O.EOFBootstrapper(20, seed=7).fit(O.EOF(2).fit(days(spark, sf_dir), "day")).explained_variance()


# -- two fields ---------------------------------------------------------------------------------------------------------
def both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Clicks and views, and the three other kinds."""
    return days(spark, sf_dir, "click", "view"), days(spark, sf_dir, "error", "purchase", "signup")


_SIDES = CELLS + ", fx AS (SELECT * FROM cells WHERE f IN ('click', 'view')), fy AS (SELECT * FROM cells WHERE f NOT IN ('click', 'view'))"
_real = lambda alpha: ",\n".join([_SIDES, M.cross("fx", "fy", 2, 3, alpha)])
_values = lambda with_, step, digits, modes=2: f"WITH RECURSIVE {with_} SELECT mode, round(s[{step} * mode], {digits}) AS value FROM svd, (SELECT unnest(range(1, {modes + 1}))::INT AS mode)"
_imaginary = lambda alpha: ",\n".join([_complex("cx", "sum(value)"), _complex("cy", "sum(1.0::DOUBLE)"), "n AS (SELECT count(DISTINCT r) AS n FROM cx_c)", M.cross("cx", "cy", 6, 6, alpha)])
_signals = lambda alpha: ",\n".join([_analytic(_HILBERT), "hl AS (SELECT * FROM hx WHERE f[2:] IN ('click', 'view')), hr AS (SELECT * FROM hx WHERE f[2:] NOT IN ('click', 'view'))", M.cross("hl", "hr", 4, 6, alpha)])
_KINDS = {"cpcca": ((0.5, 0.5), 4), "mca": ((1.0, 1.0), 3), "cca": ((0.0, 0.0), 8), "rda": ((0.0, 1.0), 5)}


def _model(name: str, prefix: str, n_modes: int, **params):
    cls = getattr(O, prefix + name.upper())
    return cls(n_modes, **({"alpha": _KINDS[name][0][0]} if name == "cpcca" else {}), **params)


def _register(name: str, alpha: tuple[float, float], digits: int) -> None:
    """Singular values of a kind of model: real fields with and without reduction to principal components, complex ones, analytic signals."""

    @query(f"{name}_singular_values", _values(_real(alpha), 1, digits))
    def real(spark, sf_dir):
        return rounded(_model(name, "", 2, n_pca_modes="all", pca_init_rank_reduction=1.0).fit(*both(spark, sf_dir), "day").singular_values(), digits)

    @query(f"complex_{name}_singular_values", _values(_imaginary(alpha), 2, digits, 3))
    def imaginary(spark, sf_dir):
        return rounded(_model(name, "Complex", 3, use_pca=False).fit(complex_days(spark, sf_dir), complex_days(spark, sf_dir, counts=True), "day").singular_values(), digits)

    @query(f"hilbert_{name}_singular_values", _values(_signals(alpha), 2, digits))
    def signal(spark, sf_dir):
        return rounded(_model(name, "Hilbert", 2, use_pca=False, padding=None).fit(*both(spark, sf_dir), "day").singular_values(), digits)


for _name, (_alpha, _digits) in _KINDS.items():
    _register(_name, _alpha, _digits)


@query("mca_squared_covariance_fraction", f"WITH RECURSIVE {_real((1.0, 1.0))} SELECT mode, round(s[mode] ** 2 / (s[1] ** 2 + s[2] ** 2), 8) AS value FROM svd, (SELECT unnest([1, 2])::INT AS mode)")
def mca_squared_covariance_fraction(spark, sf_dir):
    return rounded(O.MCA(2, use_pca=False).fit(*both(spark, sf_dir), "day").squared_covariance_fraction(), 8)


# correlations of the features of x with the scores of y, and the probability of as much by chance (the t test as a sum)
_HET = _real((1.0, 1.0)) + """, v1 AS (SELECT list_transform(range(3), lambda z: v[z * 3 + 1]) AS v FROM svd), sg AS (SELECT list_transform(v, lambda x: x * CASE WHEN abs(list_max(v)) >= abs(list_min(v)) THEN 1 ELSE -1 END) AS v FROM v1),
ky AS (SELECT f, row_number() OVER (ORDER BY f) AS k FROM (SELECT DISTINCT f FROM fy)), sy AS (SELECT r, sum(x * v[k]) AS y FROM fy JOIN ky USING (f), sg GROUP BY r), r AS (SELECT f AS kind, (SELECT n FROM n) AS n, corr(x, y) AS r FROM fx JOIN sy USING (r) GROUP BY f)"""


@query("mca_heterogeneous_patterns", f"WITH RECURSIVE {_HET} SELECT kind, round(r, 7) AS r, round(2 * (SELECT sum(exp(lgamma(n - 2) - lgamma(j + 1) - lgamma(n - 2 - j)) * ((1 - abs(r)) / 2) ** j * ((1 + abs(r)) / 2) ** (n - 3 - j)) FROM (SELECT unnest(range((n / 2 - 1)::BIGINT, (n - 2)::BIGINT)) AS j)), 7) AS p FROM r")
def mca_heterogeneous_patterns(spark, sf_dir):
    (r, _), (p, _) = O.MCA(1, use_pca=False).fit(*both(spark, sf_dir), "day").heterogeneous_patterns()
    out = r.select("kind", "mode", F.col("value").alias("r")).join(p.select("kind", "mode", F.col("value").alias("p")), ["kind", "mode"]).drop("mode")
    return rounded(out, 7, "r", "p")


# patterns of both sets, times the roots of the singular values, turned together in closed form; then back to whitened space for the squared covariance
def _turned_pair(alpha: tuple[float, float]) -> str:
    inverse = lambda side, p, a: M.power(side, (1 - a) / 2, p) if a < 1 else f"list_transform(range({p * p}), lambda e: CASE WHEN e // {p} = e % {p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return ",\n".join([
        _real(alpha), f"tv AS (SELECT {inverse('ex', 2, alpha[0])} AS ix, {inverse('ey', 3, alpha[1])} AS iy FROM ex, ey)",
        "q2 AS (SELECT s, list_transform(range(4), lambda e: u[(e // 2) * 3 + e % 2 + 1] * sqrt(s[e % 2 + 1])) AS u, list_transform(range(6), lambda e: v[(e // 2) * 3 + e % 2 + 1] * sqrt(s[e % 2 + 1])) AS v FROM svd)",
        f"lx AS (SELECT {M.mm('ix', 'u', 2, 2, 2)} AS a, {M.mm('iy', 'v', 3, 3, 2)} AS b FROM tv, q2)", "lo AS (SELECT list_concat(a, b) AS l FROM lx)", M.varimax2("lo", 5),
        "bk AS (SELECT tx, ty, l[1:4] AS a, l[5:10] AS b FROM turned, svd)", f"bw AS (SELECT {M.mm('tx', 'a', 2, 2, 2)} AS a, {M.mm('ty', 'b', 3, 3, 2)} AS b FROM bk)",
        "sq AS (SELECT c, list_sum(list_transform(range(2), lambda r: a[2 * r + c] ** 2)) * list_sum(list_transform(range(3), lambda r: b[2 * r + c] ** 2)) AS v FROM bw, (SELECT unnest([1, 2]) AS c))",
    ])


@query("mca_rotator", f"WITH RECURSIVE {_turned_pair((1.0, 1.0))} SELECT row_number() OVER (ORDER BY v DESC)::INT AS mode, round(v / 1e6, 4) AS value FROM sq")
def mca_rotator(spark, sf_dir):
    m = O.MCARotator(2, rtol=1e-14).fit(O.MCA(2, use_pca=False).fit(*both(spark, sf_dir), "day")).squared_covariance()
    return rounded(m.withColumn("value", F.col("value") / 1e6), 4)


@query("cpcca_rotator", f"WITH RECURSIVE {_turned_pair((0.5, 0.5))} SELECT row_number() OVER (ORDER BY v DESC)::INT AS mode, round(v, 3) AS value FROM sq")
def cpcca_rotator(spark, sf_dir):
    return rounded(O.CPCCARotator(2, rtol=1e-14).fit(O.CPCCA(2, alpha=0.5, use_pca=False).fit(*both(spark, sf_dir), "day")).squared_covariance(), 3)


def _rotated_query(name: str, model: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        """Of complex loadings there is no closed form."""
        data = both(spark, sf_dir) if model.startswith("Hilbert") else (complex_days(spark, sf_dir), complex_days(spark, sf_dir, counts=True))
        m = getattr(O, model)(2, use_pca=False).fit(*data, "day")
        return O.RotatorFactory(n_modes=2).create_rotator(m).fit(m).squared_covariance()


for _name in ("ComplexCPCCA", "HilbertCPCCA", "ComplexMCA", "HilbertMCA"):
    _rotated_query(f"{_name.replace('CPCCA', '_cpcca').replace('MCA', '_mca').lower()}_rotator", _name)


def _dot(a: str, b: str, k: int) -> str:
    return f"list_sum(list_transform(range({k}), lambda y: {a}[y + 1] * {b}[y + 1]))"


# of each mode, what is left of the covariances when I - a b' (of x) and I - c d' (of y) take its part out
_FRACTIONS = ",\n".join([
    _real((0.2, 0.2)), f"tv AS (SELECT {M.power('ex', 0.4, 2)} AS ix, {M.power('ey', 0.4, 3)} AS iy, {M.power('ex', -0.5, 2)} AS root FROM ex, ey)",
    "qs AS (SELECT mode, tx, ty, ix, iy, root, [u[mode], u[3 + mode]] AS q1, [v[mode], v[3 + mode], v[6 + mode]] AS q2 FROM svd, tv, (SELECT unnest([1, 2])::INT AS mode))",
    f"t0 AS (SELECT mode, root, {M.mm('tx', 'q1', 2, 2, 1)} AS a, {M.mm('ix', 'q1', 2, 2, 1)} AS b, {M.mm('ty', 'q2', 3, 3, 1)} AS c, {M.mm('iy', 'q2', 3, 3, 1)} AS d FROM qs)",
    "t1 AS (SELECT t0.*, gxx.m AS gx, gyy.m AS gy, gxy.m AS gz FROM t0, gxx, gyy, gxy)",
    f"t2 AS (SELECT *, {M.mm('gx', 'a', 2, 2, 1)} AS ca, {M.mm('gy', 'c', 3, 3, 1)} AS cc, {M.mm('gz', 'c', 2, 3, 1)} AS xc, {M.mm('a', 'gz', 1, 2, 3)} AS ax FROM t1)",
    f"t3 AS (SELECT *, {_dot('a', 'xc', 2)} AS s FROM t2)", "t4 AS (SELECT *, list_transform(range(6), lambda e: gz[e + 1] - b[e // 3 + 1] * ax[e % 3 + 1] - xc[e // 3 + 1] * d[e % 3 + 1] + b[e // 3 + 1] * s * d[e % 3 + 1]) AS rest FROM t3)",
    f"t5 AS (SELECT *, {M.mm('root', 'rest', 2, 2, 3)} AS r1, {M.mm('root', 'gz', 2, 2, 3)} AS r0 FROM t4)",
])


@query("cpcca_fractions", f"WITH RECURSIVE {_FRACTIONS} SELECT mode, round((2 * {_dot('b', 'ca', 2)} - {_dot('a', 'ca', 2)} * {_dot('b', 'b', 2)}) / (gx[1] + gx[4]), 7) AS x_by_x, round((2 * {_dot('d', 'cc', 3)} - {_dot('c', 'cc', 3)} * {_dot('d', 'd', 3)}) / (gy[1] + gy[5] + gy[9]), 7) AS y_by_y, round(1 - {_dot('r1', 'r1', 6)} / {_dot('r0', 'r0', 6)}, 7) AS y_by_x FROM t5")
def cpcca_fractions(spark, sf_dir):
    m = O.CPCCA(2, use_pca=False).fit(*both(spark, sf_dir), "day")
    named = {"x_by_x": m.fraction_variance_X_explained_by_X(), "y_by_y": m.fraction_variance_Y_explained_by_Y(), "y_by_x": m.fraction_variance_Y_explained_by_X()}
    out = None
    for name, df in named.items():
        part = df.select("mode", F.col("value").alias(name))
        out = part if out is None else out.join(part, "mode")
    return rounded(out, 7, *named)


# pseudo-scores: x w1 g, g the covariances of both scores over the variance of the first
_PREDICT = ",\n".join([
    _real((0.0, 0.0)), "sg AS (SELECT *, list_transform(range(2), lambda k: CASE WHEN abs(greatest(v[k + 1], v[k + 4], v[k + 7])) >= abs(least(v[k + 1], v[k + 4], v[k + 7])) THEN 1 ELSE -1 END) AS g FROM svd)",
    "qq AS (SELECT tx, ty, list_transform(range(4), lambda e: u[(e // 2) * 3 + e % 2 + 1] * g[e % 2 + 1]) AS u, list_transform(range(6), lambda e: v[(e // 2) * 3 + e % 2 + 1] * g[e % 2 + 1]) AS v FROM sg)",
    f"ww AS (SELECT {M.mm('tx', 'u', 2, 2, 2)} AS w, {M.mm('ty', 'v', 3, 3, 2)} AS wy, gxx.m AS cxx, gxy.m AS cxy FROM qq, gxx, gxy)", f"wt AS (SELECT *, {M.tr('w', 2, 2)} AS t, {M.mm('cxx', 'w', 2, 2, 2)} AS a, {M.mm('cxy', 'wy', 2, 3, 2)} AS b FROM ww)",
    f"ab AS (SELECT w, {M.mm('t', 'a', 2, 2, 2)} AS a, {M.mm('t', 'b', 2, 2, 2)} AS b FROM wt)", "gg AS (SELECT w, list_transform(range(4), lambda e: b[e + 1] / a[(e // 2) * 3 + 1]) AS g FROM ab)", f"pw AS (SELECT {M.mm('w', 'g', 2, 2, 2)} AS p FROM gg)",
])


@query("cca_predict", f"WITH RECURSIVE {_PREDICT} SELECT r AS day, mode, round(sum(x * p[CASE f WHEN 'click' THEN 0 ELSE 2 END + mode]), 6) AS value FROM fx, pw, (SELECT unnest([1, 2])::INT AS mode) GROUP BY ALL")
def cca_predict(spark, sf_dir):
    x, y = both(spark, sf_dir)
    return rounded(O.CCA(2, use_pca=False).fit(x, y, "day").predict(x), 6)


_PADDED_PAIR = ",\n".join([_analytic(_PADDED), "hl AS (SELECT * FROM hx WHERE f[2:] IN ('click', 'view')), hr AS (SELECT * FROM hx WHERE f[2:] NOT IN ('click', 'view'))", M.cross("hl", "hr", 4, 6, (1.0, 1.0)),
                          "kf AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS k FROM (SELECT DISTINCT f FROM hl)), sc AS (SELECT r, mode, sum(x * u[k * 6 + 2 * mode]) AS v FROM hl JOIN kf USING (f), svd, (SELECT unnest([1, 2])::INT AS mode) GROUP BY ALL)"])


@query("hilbert_mca_scores", f"WITH RECURSIVE {_PADDED_PAIR} SELECT r[:10] AS day, mode, round(sqrt(sum(v * v)), 3) AS value FROM sc GROUP BY ALL")
def hilbert_mca_scores(spark, sf_dir):
    return rounded(O.HilbertMCA(2, use_pca=False).fit(*both(spark, sf_dir), "day").scores_amplitude()[0], 3)


# -- many fields --------------------------------------------------------------------------------------------------------
# canonical correlations by products of sums over n - 1 rather than n
@query("multi_cca_correlations", f"WITH RECURSIVE {_real((0.0, 0.0))} SELECT mode, round(s[mode] * ((SELECT n FROM n) - 1) / (SELECT n FROM n), 6) AS value FROM svd, (SELECT unnest([1, 2])::INT AS mode)")
def multi_cca_correlations(spark, sf_dir):
    m = O.MultiCCA(2, pca=False).fit(list(both(spark, sf_dir)), "day")
    return rounded(small(spark, mode=np.arange(1, 3), value=m.data["eigenvalues"]), 6)


@query("multi_cca_explained_covariance")
def multi_cca_explained_covariance(spark, sf_dir):
    return O.MultiCCA(2, pca=False).fit(list(both(spark, sf_dir)), "day").explained_covariance_ratio()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: leading patterns of daily events with their share of the variance."""
    m = O.EOF(3).fit(days(spark, sf_dir), "day")
    return m.components().join(F.broadcast(m.explained_variance_ratio().withColumnRenamed("value", "ratio")), "mode")


