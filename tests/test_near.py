import math
import random

import numpy as np
import pandas as pd
import pytest

from hexloom.operators import near as N

AREAS = "area_id long, kind string, lat double, lon double, radius_m double, ring array<struct<lat:double,lon:double>>, _y int"
POINTS = "place_id long, lat double, lon double, area_id int, _x string, kind string"


def star(cx, cy, r, n, rnd):
    return [(cx + r * k * math.cos(2 * math.pi * i / n), cy + r * k * math.sin(2 * math.pi * i / n)) for i in range(n) for k in [rnd.uniform(0.3, 1)]]


def world(seed=0, n=300):
    rnd = random.Random(seed)
    areas = [(i, "circle", 25 + rnd.random(), 25 + rnd.random(), rnd.choice([50.0, 3000.0, 20000.0]), None, 0) for i in range(20)]
    areas += [(i, "polygon", None, None, None, [(y, x) for x, y in star(25 + rnd.random(), 25 + rnd.random(), rnd.choice([0.01, 0.2]), rnd.randint(3, 11), rnd)], 0) for i in range(20, 50)]
    areas += [(60, "polygon", None, None, None, [(25.2, 25.2), (25.6, 25.6), (25.2, 25.6), (25.6, 25.2)], 0), (61, "circle", None, 25.0, 5.0, None, 0), (62, "polygon", None, None, None, [], 0), (None, "circle", 25.5, 25.5, 9e5, None, 0)]
    areas += [(20, "circle", 25.5, 25.5, 9000.0, None, 0), areas[3]]  # an id with two shapes, a repeated row
    areas += [(64, "circle", 10.0, 179.99, 5000.0, None, 0), (65, "circle", 10.0, -179.99, 5000.0, None, 0)]
    areas += [(63, "polygon", None, None, None, [(25.0, 25.0), (25.0, 25.5), (25.5, 25.5), (25.5, 25.0)], 0)]
    pts = [(i, 25 + rnd.random(), 25 + rnd.random(), 0, "", "") for i in range(n)] + [(n, 25.0, 25.0, 0, "", ""), (n + 1, 25.25, 25.25, 0, "", ""), (n + 2, None, 25.1, 0, "", ""), (n + 3, float("nan"), 25.1, 0, "", ""), (n + 1, 25.25, 25.25, 0, "", ""), (n + 4, 10.0, 180.0, 0, "", ""), (n + 5, 10.0, -180.0, 0, "", ""), (n + 6, 10.01, 179.97, 0, "", ""), (n + 7, 25.4, 25.4, 0, "", "")]
    return areas, pts


def brute(areas, pts):
    out = set()
    for p, y, x, *_ in pts:
        if None in (y, x) or y != y:
            continue
        for a, kind, la, lo, r, ring, _ in areas:
            if a is None:
                continue
            if kind == "circle" and None not in (la, lo, r):
                hit = N.haversine_m(la, lo, y, x) <= r
            else:
                hit = bool(ring) and N.even_odd(np.array([x]), np.array([y]), np.array([(q, p_) for p_, q in ring]))[0]
            if hit:
                out.add((a, p))
    return out


@pytest.mark.parametrize("bound", [1000, 5])
def test_against_brute_force(spark, bound):
    areas, pts = world()
    got = N.points_in_regions(spark.createDataFrame(pts, POINTS), spark.createDataFrame(areas, AREAS), key="place_id", bound=bound).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(areas, pts)


def test_empty(spark):
    areas, pts = world()
    for a, p in (([], pts), (areas, []), ([], [])):
        assert N.points_in_regions(spark.createDataFrame(p, POINTS), spark.createDataFrame(a, AREAS), key="place_id").collect() == []


def test_triangles_cover_the_ring():
    rnd = random.Random(5)
    for _ in range(100):
        ring = star(0, 0, 1, rnd.randint(3, 12), rnd)
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
        tri = sum(abs(N._cross(*t)) / 2 for t, decides in N.ear_clip(ring) if decides)
        assert math.isclose(area, tri, rel_tol=1e-9)
    assert N.ear_clip([]) == [] and N.ear_clip([(0, 0), (1, 1)]) == []


def test_triangles_decide(monkeypatch):
    """The ring is asked for points on an edge only; without its triangles a ring holds nothing."""
    asked = []
    real = N.even_odd
    monkeypatch.setattr(N, "even_odd", lambda x, y, ring: asked.extend(x) or real(x, y, ring))
    ring = star(0, 0, 1, 400, random.Random(1))
    rows = pd.DataFrame(N._shapes_of(1, 7, "polygon", None, None, None, ring), columns=N.SHAPE)
    rnd = np.random.default_rng(2)
    x, y = rnd.uniform(-1, 1, 5000), rnd.uniform(-1, 1, 5000)
    x[0], y[0] = ring[3]
    p, _ = N.Regions(rows, {1: ring}).locate(y, x)
    assert set(p) == set(np.flatnonzero(real(x, y, np.array(ring)))) and len(asked) <= 5
    assert len(N.Regions(rows.iloc[:0], {1: ring}).locate(y, x)[0]) == 0
