"""Points in regions: circles and polygons.

Polygons are cut into triangles by ear clipping, in tasks. Triangles and circles lie
in a bounding-volume hierarchy that every task holds; a batch of points walks down it
level by level and meets candidates. A triangle decides on the points that it holds or
lets out by more than rounding; the ring itself is asked for points on an edge and for
rings that cross themselves. A point on an edge that triangles of one region share
meets the region twice and counts once.

More than `bound` triangles and circles are not broadcast: they are dealt to cells of
a size that fits each of them, and points meet them by an equi-join on the cell, with
the same tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.runtime import DIMENSION_BOUND, bounded_collect, cut

EARTH_M = 6_371_008.8
LEAF = 8
#: Corners of rings that are broadcast, for each shape of the bound.
CORNERS = 8
_SLACK = 1e-9


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_M):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1, np.sqrt(a)))


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _crosses_itself(ring: np.ndarray) -> bool:
    """Two edges that are no neighbours share a point. ring: (n, 2)."""
    n = len(ring)
    ends = np.roll(ring, -1, axis=0)
    side = lambda a, b, c: np.sign(_cross(a, b, c))
    on = lambda a, b, c: (np.minimum(a[0], b[0]) <= c[0]) & (c[0] <= np.maximum(a[0], b[0])) & (np.minimum(a[1], b[1]) <= c[1]) & (c[1] <= np.maximum(a[1], b[1]))
    for i in range(n - 2):
        a, b = ring[i], ends[i]
        c, d = ring[i + 2 : n - (i == 0)].T, ends[i + 2 : n - (i == 0)].T
        s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
        if np.any((s[0] != s[1]) & (s[2] != s[3]) | (s[0] == 0) & on(a, b, c) | (s[1] == 0) & on(a, b, d) | (s[2] == 0) & on(c, d, a) | (s[3] == 0) & on(c, d, b)):
            return True
    return False


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple]:
    """(triangle, decides) of a ring of (x, y), counterclockwise. A ring that crosses or
    touches itself gives the two halves of its box: candidates, on which the ring decides."""
    pts = [p for k, p in enumerate(ring) if p != ring[k - 1]] if len(ring) > 1 else list(ring)
    if len(pts) < 3:
        return []
    area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(pts, pts[1:] + pts[:1]))
    rest, out = pts if area > 0 else pts[::-1], []
    simple = not _crosses_itself(np.array(rest))
    while simple and len(rest) > 3:
        all_ = np.array(rest).T
        for k in range(len(rest)):
            a, b, c = rest[k - 1], rest[k], rest[(k + 1) % len(rest)]
            turn = _cross(a, b, c)
            if turn < 0:
                continue
            if turn > 0:
                inside = (_cross(a, b, all_) >= 0) & (_cross(b, c, all_) >= 0) & (_cross(c, a, all_) >= 0)
                if any(rest[i] not in (a, b, c) for i in np.flatnonzero(inside)):
                    continue
                out.append(((a, b, c), True))
            rest = rest[:k] + rest[k + 1 :]
            break
        else:
            simple = False  # no ear by rounding
    if simple:
        return [*out, (tuple(rest), True)]
    x, y = [p[0] for p in rest], [p[1] for p in rest]
    sw, se, ne, nw = (min(x), min(y)), (max(x), min(y)), (max(x), max(y)), (min(x), max(y))
    return [*out, ((sw, se, ne), False), ((sw, ne, nw), False)]


def even_odd(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Inside by the even-odd rule; ring: (k, 2) of x, y, not closed."""
    inside = np.zeros(len(x), dtype=bool)
    for (xi, yi), (xj, yj) in zip(ring, np.roll(ring, 1, axis=0)):
        if yi != yj:
            inside ^= ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
    return inside


#: A triangle (corners) or circle (lat, lon, radius in s0 to s2) of the area row `no`, and its box.
SHAPE = ["no", "area_id", "circle", "decides", *(f"s{k}" for k in range(6)), "x0", "y0", "x1", "y1"]
_SHAPE_TYPES = "no bigint, area_id bigint, circle boolean, decides boolean, " + ", ".join(f"{c} double" for c in SHAPE[4:])


def _shapes_of(no: int, area_id: int, kind: str, lat, lon, radius, ring) -> list[tuple]:
    """Shapes of an area; one that lacks what its kind needs has none and holds no point."""
    if kind == "circle" and None not in (lat, lon, radius) and radius >= 0:
        dlat = math.degrees(radius / EARTH_M) * (1 + 1e-9) + _SLACK
        cos = math.cos(math.radians(min(90.0, abs(lat) + dlat)))
        dlon = min(360.0, math.degrees(2 * math.asin(min(1.0, math.sin(min(math.pi / 2, radius / EARTH_M / 2)) / max(cos, 1e-12))))) * (1 + 1e-9) + _SLACK
        # Beyond 180 degrees the box goes on at the other end.
        turns = [0, *([360] if lon - dlon < -180 else []), *([-360] if lon + dlon > 180 else [])]
        return [(no, area_id, True, True, lat, lon, radius, 0.0, 0.0, 0.0, lon - dlon + t, lat - dlat, lon + dlon + t, lat + dlat) for t in turns]
    out = []
    for tri, decides in ear_clip(ring) if kind == "polygon" and ring else []:
        x, y = [p[0] for p in tri], [p[1] for p in tri]
        out.append((no, area_id, False, decides, *(v for p in tri for v in p), min(x) - _SLACK, min(y) - _SLACK, max(x) + _SLACK, max(y) + _SLACK))
    return out


def _number(v) -> float | None:
    return None if v is None or pd.isna(v) else float(v)


def shapes(areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes, rings): triangles and circles of all areas, and (no, ring of x, y) of the polygons. Equal rows are one area; rows that differ are several, also under one id."""
    own = areas.select("area_id", "kind", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("radius_m").cast("double").alias("radius_m"), "ring").dropna(subset=["area_id"])
    known = F.filter("ring", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    own = own.withColumn("ring", F.transform(known, lambda p: F.array(p["lon"].cast("double"), p["lat"].cast("double"))))
    own = own.withColumn("no", F.xxhash64("area_id", "kind", "lat", "lon", "radius_m", "ring")).dropDuplicates(["no"])

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                ring = None if r.ring is None else [tuple(map(float, p)) for p in r.ring]
                rows += _shapes_of(r.no, r.area_id, r.kind, _number(r.lat), _number(r.lon), _number(r.radius_m), ring)
            yield pd.DataFrame(rows, columns=SHAPE)

    return own.mapInPandas(clip, _SHAPE_TYPES), own.filter(F.col("kind") == "polygon").select("no", "ring")


class Regions:
    """Hierarchy over shapes; rings: no -> ring of (x, y)."""

    def __init__(self, rows: pd.DataFrame, rings: dict[int, list]):
        self.ids, self.no = rows["area_id"].to_numpy(dtype=np.int64), rows["no"].to_numpy(dtype=np.int64)
        self.circle, self.decides = rows["circle"].to_numpy(dtype=bool), rows["decides"].to_numpy(dtype=bool)
        self.s = rows[SHAPE[4:10]].to_numpy(dtype=float)
        self.boxes = rows[SHAPE[10:]].to_numpy(dtype=float).reshape(-1, 4)
        self.rings = {k: np.array(v, dtype=float) for k, v in rings.items()}
        self._build()

    def _build(self) -> None:
        self.order = np.arange(len(self.ids))
        nodes: list[list] = []

        def grow(lo: int, hi: int) -> int:
            own = self.boxes[self.order[lo:hi]]
            me = len(nodes)
            nodes.append([*own[:, :2].min(0), *own[:, 2:].max(0), -1, -1, lo, hi])
            if hi - lo > LEAF:
                mid = (own[:, :2] + own[:, 2:]) / 2
                axis = int(np.argmax(np.ptp(mid, axis=0)))
                self.order[lo:hi] = self.order[lo:hi][np.argsort(mid[:, axis], kind="stable")]
                half = (lo + hi) // 2
                nodes[me][4], nodes[me][5] = grow(lo, half), grow(half, hi)
            return me

        if len(self.ids):
            grow(0, len(self.ids))
        n = np.array(nodes, dtype=float).reshape(-1, 8)
        self.box, (self.left, self.right, self.lo, self.hi) = n[:, :4], n[:, 4:].astype(int).T

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of point and triangle or circle whose boxes meet."""
        got_p, got_t = [np.zeros(0, int)], [np.zeros(0, int)]
        p = np.arange(len(x)) if len(self.box) else np.zeros(0, int)
        node = np.zeros(len(p), int)
        while len(p):
            b = self.box[node]
            keep = (x[p] >= b[:, 0]) & (y[p] >= b[:, 1]) & (x[p] <= b[:, 2]) & (y[p] <= b[:, 3])
            p, node = p[keep], node[keep]
            leaf = self.left[node] < 0
            for k in range(LEAF):
                at = self.lo[node[leaf]] + k
                own = at < self.hi[node[leaf]]
                got_p.append(p[leaf][own]), got_t.append(self.order[at[own]])
            p = np.concatenate([p[~leaf], p[~leaf]])
            node = np.concatenate([self.left[node[~leaf]], self.right[node[~leaf]]])
        p, t = np.concatenate(got_p), np.concatenate(got_t)
        b = self.boxes[t]
        keep = (x[p] >= b[:, 0]) & (y[p] >= b[:, 1]) & (x[p] <= b[:, 2]) & (y[p] <= b[:, 3])
        return p[keep], t[keep]

    def locate(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point numbers and region ids, each pair once."""
        x, y = np.asarray(lon, float), np.asarray(lat, float)
        p, t = self.candidates(x, y)
        hit = np.zeros(len(p), dtype=bool)
        c = self.circle[t]
        s = self.s[t]
        hit[c] = haversine_m(s[c, 0], s[c, 1], y[p[c]], x[p[c]]) <= s[c, 2]
        least = np.min([_cross(s[:, i : i + 2].T, s[:, j : j + 2].T, (x[p], y[p])) for i, j in ((0, 2), (2, 4), (4, 0))], axis=0) if len(p) else np.zeros(0)
        slack = _SLACK * np.maximum(np.ptp(self.boxes[t][:, ::2], axis=1), np.ptp(self.boxes[t][:, 1::2], axis=1)) if len(p) else np.zeros(0)
        hit |= ~c & self.decides[t] & (least > slack)
        ask = np.flatnonzero(~c & ~hit & (least >= -slack))
        for no in np.unique(self.no[t[ask]]):
            own = ask[self.no[t[ask]] == no]
            hit[own] = even_odd(x[p[own]], y[p[own]], self.rings[no])
        pairs = np.unique(np.stack([p[hit], self.ids[t[hit]]]), axis=1)
        return pairs[0], pairs[1]


def points_in_regions(points: DataFrame, areas: DataFrame, *, key: str, lat: str = "lat", lon: str = "lon", bound: int = DIMENSION_BOUND) -> DataFrame:
    """(area_id, key), each pair once: the regions each point lies in.

    areas: area_id, kind (circle or polygon), lat, lon, radius_m, ring. Points without a
    finite latitude and longitude lie nowhere. Repeated points and regions give a pair
    once if their ids agree; an id with several shapes holds what any of them holds.
    Regions with a null id or without the numbers of their kind hold no point. Either
    table empty: no rows. The result is the same on either side of `bound`.
    """
    pts = points.select(key, F.col(lat).cast("double").alias("_y"), F.col(lon).cast("double").alias("_x")).dropna().filter(~F.isnan("_x") & ~F.isnan("_y"))
    kind = dict(pts.dtypes)[key]
    made, rings = shapes(areas)
    few = bounded_collect(made, bound)
    if few is None or (rings.agg(F.sum(F.size("ring")).alias("n")).first().n or 0) > CORNERS * bound:
        return _by_cells(pts, cut(made), rings, key)
    regions = points.sparkSession.sparkContext.broadcast(Regions(pd.DataFrame([tuple(r) for r in few], columns=SHAPE), {r.no: r.ring for r in rings.collect()}))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, a = regions.value.locate(b["_y"].to_numpy(), b["_x"].to_numpy())
            yield pd.DataFrame({"area_id": a, key: b[key].to_numpy()[p]})

    return pts.mapInPandas(locate, f"area_id bigint, `{key}` {kind}").dropDuplicates()


def _by_cells(pts: DataFrame, made: DataFrame, rings: DataFrame, key: str, most: int = 4) -> DataFrame:
    """The same by an equi-join: each shape's box in cells of a level at which it spans few, points probe every level in use."""
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    level = F.greatest(F.lit(-20), F.ceil(F.log2(wide / (most - 1)))).cast("int")
    size = F.pow(F.lit(2.0), F.col("_l"))
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint")
    dealt = made.withColumn("_l", level)
    dealt = dealt.withColumn("_cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("_cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    levels = [r[0] for r in made.select(level.alias("_l")).distinct().collect()]  # at most 30: powers of two of a degree
    probe = pts.withColumn("_l", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)]))).withColumns({"_cx": cell("_x"), "_cy": cell("_y")})
    inside = (F.col("_x") >= F.col("x0")) & (F.col("_x") <= F.col("x1")) & (F.col("_y") >= F.col("y0")) & (F.col("_y") <= F.col("y1"))
    met = probe.join(dealt, ["_l", "_cx", "_cy"]).filter(inside)

    def side(i: int, j: int) -> Column:
        o, a = (F.col(f"s{i}"), F.col(f"s{i + 1}")), (F.col(f"s{j}"), F.col(f"s{j + 1}"))
        return _cross(o, a, (F.col("_x"), F.col("_y")))

    rad = lambda c: F.radians(F.col(c))
    h = F.pow(F.sin((rad("_y") - rad("s0")) / 2), 2) + F.cos(rad("s0")) * F.cos(rad("_y")) * F.pow(F.sin((rad("_x") - rad("s1")) / 2), 2)
    near = 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))) <= F.col("s2")
    least, slack = F.least(side(0, 2), side(2, 4), side(4, 0)), wide * _SLACK
    # 2: in, 1: on an edge or up to the ring, 0: out
    verdict = F.when(F.col("circle"), F.when(near, 2).otherwise(0)).when(F.col("decides") & (least > slack), 2).when(least >= -slack, 1).otherwise(0)
    met = met.withColumn("_in", verdict).filter("_in > 0")
    sure = met.filter("_in = 2").select("area_id", key)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = np.zeros(len(b), dtype=bool)
            x, y, no = b["_x"].to_numpy(), b["_y"].to_numpy(), b["no"].to_numpy()
            for k in np.unique(no):
                own = np.flatnonzero(no == k)
                hit[own] = even_odd(x[own], y[own], np.array([list(map(float, p)) for p in b["ring"].iloc[own[0]]]))
            yield b[["area_id", key]][hit]

    edge = met.filter("_in = 1").select("no", "area_id", key, "_x", "_y").join(rings, "no")
    asked = edge.mapInPandas(ask, f"area_id bigint, `{key}` {dict(pts.dtypes)[key]}")
    return sure.unionByName(asked).dropDuplicates()
