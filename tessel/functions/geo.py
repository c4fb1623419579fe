"""Spatial functions. A ring is array<struct<x, y>>; a polygon is array<ring>, the first exterior, the others holes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.vector import total


def _edges(ring: Column, f) -> Column:
    """Sum of f(point, next point) around the ring."""
    n = F.size(ring)
    return F.when(n < 3, 0.0).otherwise(total(F.transform(ring, lambda p, i: f(p, F.get(ring, (i + 1) % n)))))


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def area(polygon: Column) -> Column:
    """Exterior less holes, at least 0, in squared units."""
    holes = total(F.transform(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), lambda r: F.abs(signed_area(r))))
    return F.greatest(F.abs(signed_area(F.get(polygon, F.lit(0)))) - holes, F.lit(0.0))


def centroid(ring: Column) -> Column:
    """struct(x, y), weighted by area; the mean of the points if the area is 0."""
    a = signed_area(ring)
    part = lambda c: _edges(ring, lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"])) / (6 * a)
    mean = lambda c: total(F.transform(ring, lambda p: p[c])) / F.size(ring)
    return F.struct(*(F.when(F.abs(a) < 1e-12, mean(c)).otherwise(part(c)).alias(c) for c in ("x", "y")))


def bounds(ring: Column) -> Column:
    lim = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(lim(F.array_min, "x").alias("x0"), lim(F.array_min, "y").alias("y0"), lim(F.array_max, "x").alias("x1"), lim(F.array_max, "y").alias("y1"))


def _in_ring(x: Column, y: Column, ring: Column) -> Column:
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + n - 1) % n)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    return F.size(F.filter(F.transform(ring, crosses), lambda b: F.coalesce(b, F.lit(False)))) % 2 == 1


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule; in the exterior and in no hole."""
    holes = F.exists(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), lambda r: _in_ring(x, y, r))
    return _in_ring(x, y, F.get(polygon, F.lit(0))) & ~holes


def mercator(lon: Column, lat: Column) -> Column:
    """struct(x, y) in radians; latitudes are held to 85.05 degrees."""
    phi = F.radians(F.greatest(F.lit(-85.051129), F.least(F.lit(85.051129), lat)))
    return F.struct(F.radians(lon).alias("x"), F.log(F.tan(phi / 2 + 0.7853981633974483)).alias("y"))


def equirectangular(lon: Column, lat: Column) -> Column:
    return F.struct(F.radians(lon).alias("x"), F.radians(lat).alias("y"))


#: The polynomial of the Equal Earth projection.
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)


def equal_earth(lon: Column, lat: Column) -> Column:
    a1, a2, a3, a4 = EQUAL_EARTH
    t = F.asin(F.sqrt(F.lit(3.0)) / 2 * F.sin(F.radians(lat)))
    t2 = t * t
    t6 = t2 * t2 * t2
    d = 9 * a4 * t6 * t2 + 7 * a3 * t6 + 3 * a2 * t2 + a1
    return F.struct((2 * 3**0.5 * F.radians(lon) * F.cos(t) / (3 * d)).alias("x"), (t * (a4 * t6 * t2 + a3 * t6 + a2 * t2 + a1)).alias("y"))


def _poly(coefs: tuple[float, ...], t: Column) -> Column:
    out: Column = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * t + c
    return out


def _newton(y: Column, f, slope, rounds: int = 12) -> Column:
    """x with f(x) = y, from y itself; an expression of constant size."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), y, lambda x, _: x - (f(x) - y) / slope(x))


#: The polynomials of the Natural Earth projection, in the square of the latitude.
NATURAL_EARTH_X = (0.8707, -0.131979, -0.013791, 0.003971, -0.001529)
NATURAL_EARTH_Y = (1.007226, 0.015085, -0.044475, 0.028874, -0.005916)


def natural_earth(lon: Column, lat: Column) -> Column:
    p = F.radians(lat)
    return F.struct((F.radians(lon) * _poly(NATURAL_EARTH_X, p * p)).alias("x"), (p * _poly(NATURAL_EARTH_Y, p * p)).alias("y"))


def natural_earth_inverse(x: Column, y: Column) -> Column:
    """struct(lon, lat)."""
    slopes = tuple((2 * i + 1) * c for i, c in enumerate(NATURAL_EARTH_Y))
    p = _newton(y, lambda t: t * _poly(NATURAL_EARTH_Y, t * t), lambda t: _poly(slopes, t * t))
    return F.struct(F.degrees(x / _poly(NATURAL_EARTH_X, p * p)).alias("lon"), F.degrees(p).alias("lat"))


def mercator_inverse(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x).alias("lon"), F.degrees(2 * F.atan(F.exp(y)) - 1.5707963267948966).alias("lat"))


def equirectangular_inverse(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x).alias("lon"), F.degrees(y).alias("lat"))


def equal_earth_inverse(x: Column, y: Column) -> Column:
    a1, a2, a3, a4 = EQUAL_EARTH
    slope = lambda t: _poly((a1, 3 * a2, 0.0, 7 * a3, 9 * a4), t * t)
    t = _newton(y, lambda t: t * _poly((a1, a2, 0.0, a3, a4), t * t), slope)
    return F.struct(F.degrees(3 * x * slope(t) / (2 * 3**0.5 * F.cos(t))).alias("lon"), F.degrees(F.asin(2 * F.sin(t) / 3**0.5)).alias("lat"))


#: Standard parallels, origin (lon, lat), scale and offset of the conics of the composite for the USA.
ALBERS_USA = {
    "lower48": (29.5, 45.5, -98.0, 38.0, 1.0, 0.0, 0.0),
    "alaska": (55.0, 65.0, -154.0, 50.0, 0.35, -0.25, -0.37),
    "hawaii": (8.0, 18.0, -157.0, 13.0, 0.35, -0.07, -0.35),
}


def albers(lon: Column, lat: Column, par1: float, par2: float, lon0: float, lat0: float, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> Column:
    """struct(x, y) of the equal-area conic with two standard parallels."""
    from math import cos, radians, sin, sqrt

    n = (sin(radians(par1)) + sin(radians(par2))) / 2
    c = cos(radians(par1)) ** 2 + 2 * n * sin(radians(par1))
    rho0 = sqrt(abs(c - 2 * n * sin(radians(lat0)))) / n
    rho = F.sqrt(F.abs(c - 2 * n * F.sin(F.radians(lat)))) / n
    theta = n * (F.radians(lon) - radians(lon0))
    return F.struct((rho * F.sin(theta) * scale + dx).alias("x"), ((rho0 - rho * F.cos(theta)) * scale + dy).alias("y"))


def albers_inverse(x: Column, y: Column, par1: float, par2: float, lon0: float, lat0: float, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> Column:
    """struct(lon, lat) of a point of albers(); both parallels lie north of the equator."""
    from math import cos, radians, sin, sqrt

    n = (sin(radians(par1)) + sin(radians(par2))) / 2
    c = cos(radians(par1)) ** 2 + 2 * n * sin(radians(par1))
    u, v = (x - dx) / scale, sqrt(abs(c - 2 * n * sin(radians(lat0)))) / n - (y - dy) / scale
    height = (c - (u * u + v * v) * n * n) / (2 * n)
    return F.struct((lon0 + F.degrees(F.atan2(u, v)) / n).alias("lon"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height)))).alias("lat"))


def simplify(line: Column, epsilon: float) -> Column:
    """The points of a line (array<struct<x, y>>) that Ramer, Douglas and Peucker's rule keeps: both ends, and between two
    kept ones the farthest from their chord if it is more than epsilon away."""
    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None:
                return None
            p = np.stack([np.asarray(x, dtype=float), np.asarray(y, dtype=float)])
            last = p.shape[1] - 1
            stay, open_ = {0, last} if last >= 0 else set(), [(0, last)]
            while open_:
                a, b = open_.pop()
                if b - a < 2:
                    continue
                chord, rest = p[:, b] - p[:, a], p[:, a + 1 : b] - p[:, [a]]
                long = np.hypot(*chord)
                off = np.abs(chord[0] * rest[1] - chord[1] * rest[0]) / long if long > 1e-10 else np.hypot(*rest)
                if off.max() > epsilon:
                    m = a + 1 + int(off.argmax())
                    stay.add(m)
                    open_ += [(a, m), (m, b)]
            return sorted(stay)

        return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype=object)

    at = kept(F.transform(line, lambda p: p["x"].cast("double")), F.transform(line, lambda p: p["y"].cast("double")))
    return F.transform(at, lambda i: F.get(line, i))


def albers_usa(lon: Column, lat: Column) -> Column:
    """Hawaii and Alaska as insets; the Aleutians past the date line go with Alaska."""
    hawaii = (lat < 25) & (lon > -180) & (lon < -154)
    alaska = (lat > 50) & ((lon < -130) | (lon > 170))
    part = {k: albers(lon, lat, *v) for k, v in ALBERS_USA.items()}
    return F.when(hawaii, part["hawaii"]).when(alaska, part["alaska"]).otherwise(part["lower48"])
