"""Distances and shapes as Column expressions. The distance formulas differ in their last digits and stay apart."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexloom.config import T


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = T.earth_m) -> Column:
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dy), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, shrink: float = 0.868) -> Column:
    """Equirectangular with one fixed shrinkage of longitudes."""
    return F.hypot((lat2 - lat1) * 111_320.0, (lon2 - lon1) * 111_320.0 * shrink)


def local_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular with the cosine of the first latitude."""
    return F.hypot((lat2 - lat1) * 111_320.0, (lon2 - lon1) * 111_320.0 * F.cos(F.radians(lat1)))


def box_around(lat: Column, lon: Column, half_km: float) -> Column:
    dy = F.lit(half_km / 111.32)
    dx = F.lit(half_km) / (111.32 * F.cos(F.radians(lat)))
    return F.struct((lon - dx).alias("xmin"), (lat - dy).alias("ymin"), (lon + dx).alias("xmax"), (lat + dy).alias("ymax"))


def in_box(lat: Column, lon: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return lon.between(xmin, xmax) & lat.between(ymin, ymax)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Two boxes (xmin, ymin, xmax, ymax) share a point."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def circle(lat: Column, lon: Column, radius_m: Column, corners: int = 64) -> Column:
    """Closed ring of corners + 1 points on a circle of accuracy."""
    at = F.sequence(F.lit(0), F.lit(corners))
    dy, dx = radius_m / 111_320.0, radius_m / (111_320.0 * F.cos(F.radians(lat)))
    turn = lambda k: k * (2 * math.pi / corners)
    return F.transform(at, lambda k: F.struct((lon + dx * F.cos(turn(k))).alias("lon"), (lat + dy * F.sin(turn(k))).alias("lat")))


def segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def ring_area(ring: Column) -> Column:
    """Area of a ring of structs x, y, not closed, by the shoelace rule."""
    n = F.size(ring)
    term = lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["y"] - F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["x"] * F.element_at(ring, i)["y"]
    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))) / 2


def steps_for_radius(radius_m: Column, cell_m2: float, most: int = 60) -> Column:
    """Steps k whose 3k^2 + 3k + 1 cells come nearest to the circle's area; of two as near the smaller."""
    gap = lambda k: F.struct(F.abs((3 * k * k + 3 * k + 1) * F.lit(cell_m2) - math.pi * radius_m * radius_m).alias("gap"), k.alias("k"))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(most)), gap))["k"]


def round_away(c: Column, digits: int) -> Column:
    """Half away from zero; NaN and infinities give 0."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.round(c, digits))


def round_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


# The WGS84 ellipsoid and the scale of the UTM grid.
_A, _F, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a northern UTM zone, by the third-order series; true to millimetres within the zone."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    y, x = F.radians(lat), F.radians(lon - F.lit(zone * 6.0 - 183.0))
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(y)) - e * F.atanh(e * F.sin(y)))
    xi, eta = F.atan2(t, F.cos(x)), F.atanh(F.sin(x) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, v in enumerate(a, 1):
        east = east + v * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + v * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000.0 + _K0 * radius * east, _K0 * radius * north


def mollweide_place(x: Column, y: Column, radius: float = _A) -> tuple[Column, Column]:
    """Latitude and longitude of a point of the Mollweide plane; null outside the ellipse."""
    s = y / F.lit(radius * math.sqrt(2))
    theta = F.asin(s)
    lat = F.degrees(F.asin((2 * theta + F.sin(2 * theta)) / math.pi))
    lon = F.degrees(math.pi * x / (2 * radius * math.sqrt(2) * F.cos(theta)))
    inside = (F.abs(s) < 1) & (F.abs(lon) <= 180)
    return F.when(inside, lat), F.when(inside, lon)


def line_length(line: list[tuple[float, float]]) -> float:
    return sum(math.dist(a, b) for a, b in zip(line, line[1:]))


def line_part(line: list[tuple[float, float]], start: float, stop: float) -> list[tuple[float, float]]:
    """The stretch of a line from `start` to `stop` along it, its corners kept; cut at the line's ends."""
    out: list[tuple[float, float]] = []
    at = 0.0
    for a, b in zip(line, line[1:]):
        n = math.dist(a, b)
        lo, hi = max(start - at, 0.0), min(stop - at, n)
        if n and lo <= hi:
            point = lambda t: (a[0] + (b[0] - a[0]) * t / n, a[1] + (b[1] - a[1]) * t / n)  # noqa: B023, E731
            for p in (point(lo), point(hi)):
                if not out or math.dist(out[-1], p) > 1e-9:
                    out.append(p)
        at += n
    return out


def line_buffer(line: list[tuple[float, float]], distance: float, corners: int = 16) -> list[list[tuple[float, float]]]:
    """Rings that together hold all within a distance of a line: one for each stretch, with round ends of `corners` steps each."""
    rings = []
    for a, b in zip(line, line[1:]):
        turn = math.atan2(b[1] - a[1], b[0] - a[0])
        arc = lambda c, first: [(c[0] + distance * math.cos(first + math.pi * k / corners), c[1] + distance * math.sin(first + math.pi * k / corners)) for k in range(corners + 1)]  # noqa: B023, E731
        rings.append(arc(b, turn - math.pi / 2) + arc(a, turn + math.pi / 2))
    return rings
