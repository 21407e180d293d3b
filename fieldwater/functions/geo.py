"""Plane geometry and one map projection as column expressions.

A ring is ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``; the last point may or may
not repeat the first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic on an ellipsoid (defaults: continental US, GRS80)."""

    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0
    a: float = 6378137.0
    e2: float = 0.00669438002290

    def _q(self, sin_phi: float) -> float:
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (
            sin_phi / (1 - self.e2 * sin_phi**2) - math.log((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e)
        )

    def constants(self) -> tuple[float, float, float]:
        """Cone constant n, C and the radius of the origin parallel."""
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        m1, m2 = (math.cos(p) / math.sqrt(1 - self.e2 * math.sin(p) ** 2) for p in (p1, p2))
        q1, q2, q0 = (self._q(math.sin(p)) for p in (p1, p2, p0))
        n = (m1**2 - m2**2) / (q2 - q1)
        c = m1**2 + n * q1
        return n, c, self.a * math.sqrt(c - n * q0) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Projected x, y in metres of a longitude and latitude in degrees."""
        n, c, rho0 = self.constants()
        e = math.sqrt(self.e2)
        s = F.sin(F.radians(lat))
        q = (s / (1 - self.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e)) * (1 - self.e2)
        rho = F.sqrt(c - q * n) * (self.a / n)
        theta = F.radians(lon - self.lon0) * n
        return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees of projected coordinates."""
        n, c, rho0 = self.constants()
        e = math.sqrt(self.e2)
        rho = F.sqrt(x * x + (F.lit(rho0) - y) * (F.lit(rho0) - y))
        q = (F.lit(c) - rho * rho * (n * n / self.a**2)) / n

        def newton(phi: Column, _: Column) -> Column:
            s = F.sin(phi)
            w = 1 - self.e2 * s * s
            gap = q / (1 - self.e2) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e)
            return phi + w * w / (2 * F.cos(phi)) * gap

        phi = F.aggregate(F.array_repeat(F.lit(0), 5), F.asin(q / 2), newton)
        lon = F.degrees(F.atan2(x, F.lit(rho0) - y) / n) + self.lon0
        return lon, F.degrees(phi)


# Projections a grid or a point table may name.
PROJECTIONS = {"albers": Albers()}


def reproject(x: Column, y: Column, src: str, dst: str) -> tuple[Column, Column]:
    """Move coordinates between ``lonlat`` and a named projection."""
    if src == dst:
        return x, y
    if src != "lonlat":
        x, y = PROJECTIONS[src].inverse(x, y)
    if dst != "lonlat":
        x, y = PROJECTIONS[dst].forward(x, y)
    return x, y


def edges(ring: Column) -> Column:
    """Array of the segments (x1, y1, x2, y2) of a ring, closing it when it is open."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda p, q: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        ),
    )


def _sum_edges(ring: Column, term) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda acc, s: acc + term(s))


def signed_area(ring: Column) -> Column:
    return _sum_edges(ring, lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a ring; NULL for a ring without area.

    The sums run over coordinates relative to the first vertex, so small
    polygons far from the origin keep their digits.
    """
    x0, y0 = ring[0]["x"], ring[0]["y"]
    local = F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    area6 = signed_area(local) * 6
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    cx = F.try_divide(_sum_edges(local, lambda s: (s["x1"] + s["x2"]) * cross(s)), area6) + x0
    cy = F.try_divide(_sum_edges(local, lambda s: (s["y1"] + s["y2"]) * cross(s)), area6) + y0
    return cx, cy


def rings_of(df: DataFrame, name: str) -> Column:
    """A polygon column as an array of rings.

    A column may hold one ring, or the rings of all parts and holes of a
    polygon; the schema tells which.
    """
    inner = df.schema[name].dataType.elementType
    return F.col(name) if inner.typeName() == "array" else F.array(F.col(name))


def oriented(parts: Column) -> Column:
    """Parts, each an outer ring followed by its holes, as one array of rings: outer ones counterclockwise, holes clockwise."""
    turned = lambda ring, sign: F.when(signed_area(ring) * sign < 0, F.reverse(ring)).otherwise(ring)
    return F.flatten(F.transform(parts, lambda part: F.transform(part, lambda ring, k: turned(ring, F.when(k == 0, 1).otherwise(-1)))))


def edges_of(rings: Column) -> Column:
    """Array of the segments of all rings."""
    return F.flatten(F.transform(rings, edges))


def area_of(rings: Column) -> Column:
    """Area of oriented rings: outer ones less holes, whichever way the outer ones turn."""
    return F.abs(F.aggregate(rings, F.lit(0.0), lambda acc, ring: acc + signed_area(ring)))


def centroid_of(rings: Column) -> tuple[Column, Column]:
    """Area centroid of oriented rings, holes taken out and parts together; NULL without area.

    All sums run over coordinates relative to the first vertex of the first ring.
    """
    origin = F.get(F.get(F.filter(rings, lambda ring: F.size(ring) > 0), F.lit(0)), F.lit(0))
    x0, y0 = origin["x"], origin["y"]
    near = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y"))))
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(
        edges_of(near),
        zero,
        lambda t, s: F.struct(
            (t["a"] + cross(s)).alias("a"),
            (t["x"] + (s["x1"] + s["x2"]) * cross(s)).alias("x"),
            (t["y"] + (s["y1"] + s["y2"]) * cross(s)).alias("y"),
        ),
        lambda t: F.struct(F.try_divide(t["x"], t["a"] * 3).alias("x"), F.try_divide(t["y"], t["a"] * 3).alias("y")),
    )
    return sums["x"] + x0, sums["y"] + y0


def bounds(ring: Column) -> Column:
    """Struct (xmin, ymin, xmax, ymax) of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Ring of an axis-parallel box."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax))


def ring_of(points: list[tuple[float, float]]) -> Column:
    """Literal ring."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
