"""Small labelled data and helpers to compare tables with arrays."""

import datetime

import numpy as np
import pandas as pd

LAT, LON = (20.0, 30.0, 40.0, 50.0, 60.0), (-10.0, 0.0, 10.0, 20.0)


def grid(seed=7, n=25):
    """n x 5 x 4 values with a slow wave."""
    rng = np.random.default_rng(seed)
    return rng.normal(5, 3, (n, 5, 4)) + 2 * np.sin(np.linspace(0, 2 * np.pi, n))[:, None, None]


def long(spark, values, names=("time", "lat", "lon"), coords=None):
    coords = coords or (tuple(datetime.date(2001 + i, 1, 1) for i in range(values.shape[0])), LAT, LON)
    rows = [(*[c[i] for c, i in zip(coords, at)], None if np.isnan(v) else float(v)) for at, v in np.ndenumerate(values)]
    kinds = ["date" if isinstance(c[0], datetime.date) else "double" if isinstance(c[0], float) else "string" if isinstance(c[0], str) else "long" for c in coords]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip((*names, "value"), (*kinds, "double"))))


def table(spark, m, names=("time", "f")):
    """A matrix as a long table with integer coordinates."""
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], f"{names[0]} long, {names[1]} long, value double")


def pivot(df, rows, cols=("mode",), value="value"):
    p = df.toPandas()
    if value == "complex":
        p["complex"] = p["re"] + 1j * p["im"]
    keys = list(rows) + list(cols)
    p = p.sort_values(keys)
    shape = (len(p.drop_duplicates(list(rows))), len(p.drop_duplicates(list(cols))))
    return p[value].to_numpy().reshape(shape)


def values(df):
    p = df.toPandas().sort_values("mode")
    return p["value"].to_numpy() if "value" in p else (p["re"] + 1j * p["im"]).to_numpy()


def same_up_to_sign(a, b, atol=1e-8):
    s = np.sign((a * b).sum(axis=0))
    return np.allclose(a, b * np.where(s == 0, 1, s), atol=atol)


def frame(df):
    return df.toPandas() if not isinstance(df, pd.DataFrame) else df
