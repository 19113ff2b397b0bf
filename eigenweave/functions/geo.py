"""Latitude weights, distances and kernels as column expressions, with NumPy twins for blocks of rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coordinate names that are understood (in any case), and the Earth's radius in kilometres.
LATITUDES = ("latitude", "lats", "lat")
LONGITUDES = ("lon", "lons", "longitude", "longitudes")
CARTESIAN_X, CARTESIAN_Y = ("x", "x_coord"), ("y", "y_coord")
EARTH_KM = 6371.0

KERNELS = ("bisquare", "gaussian", "exponential")
METRICS = ("haversine", "euclidean")


def sqrt_cos_lat(lat: Column) -> Column:
    """Square root of the cosine of a latitude in degrees, the cosine clipped to [0, 1]."""
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.cos(F.radians(lat)))))


def sqrt_cos_lat_np(lat) -> np.ndarray:
    return np.sqrt(np.clip(np.cos(np.deg2rad(np.asarray(lat, float))), 0.0, 1.0))


def latitude_dim(dims) -> str:
    """The one latitude name among `dims`."""
    found = [d for d in dims if d.lower() in LATITUDES]
    if len(found) != 1:
        raise ValueError(f"need exactly one latitude among the feature dims {list(dims)}, found {found}")
    return found[0]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres of points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def kernel_weight(distance: Column, bandwidth: float, kernel: str) -> Column:
    u = distance / F.lit(float(bandwidth))
    if kernel == "bisquare":
        return F.when(u <= 1, F.pow(1 - u * u, 2)).otherwise(0.0)
    if kernel == "gaussian":
        return F.exp(-0.5 * u * u)
    if kernel == "exponential":
        return F.exp(-0.5 * u)
    raise ValueError(f"kernel must be one of {KERNELS}, not {kernel!r}")


def distances_np(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between two blocks of points, columns (lon or x, lat or y)."""
    if metric == "euclidean":
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    if metric != "haversine":
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    a, b = np.deg2rad(a), np.deg2rad(b)
    d = b[None, :, :] - a[:, None, :]
    h = np.sin(d[..., 1] / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[None, :, 1]) * np.sin(d[..., 0] / 2) ** 2
    return 2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def kernel_weight_np(distance: np.ndarray, bandwidth: float, kernel: str) -> np.ndarray:
    u = distance / bandwidth
    if kernel == "bisquare":
        return np.where(u <= 1, (1 - u**2) ** 2, 0.0)
    return np.exp(-0.5 * u**2) if kernel == "gaussian" else np.exp(-0.5 * u)


def bounding_halfwidth(lat_deg: float, reach_km: float) -> tuple[float, float]:
    """Half extents (degrees of longitude, of latitude) of a box that holds all points within `reach_km`."""
    angle = reach_km / EARTH_KM
    dlat = math.degrees(angle)
    if abs(lat_deg) + dlat >= 90 or angle >= math.pi / 2:
        return 180.0, dlat
    return math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat_deg))))), dlat
