"""A two-level hexagonal lattice in integer arithmetic, which every engine computes alike.

Cells are bricks of W x H metres in rows that are shifted by half a brick, so each
has six neighbours; they are addressed axially. Seven cells make a parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W, H = 350, 300
CELL_M2 = W * H
ORIGIN = (24.0, 21.0)
#: Metres a degree of longitude and latitude in the local plane.
SCALE = (100_000.0, 111_320.0)
# The child's place in its parent by (q + 5r) mod 7.
_CHILD = {0: (0, 0), 1: (1, 0), 2: (0, -1), 3: (1, -1), 4: (-1, 1), 5: (0, 1), 6: (-1, 0)}


def plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Whole metres x, y east and north of the origin."""
    x = F.floor((lon - F.lit(ORIGIN[0])) * F.lit(SCALE[0])).cast("bigint")
    y = F.floor((lat - F.lit(ORIGIN[1])) * F.lit(SCALE[1])).cast("bigint")
    return x, y


def _div(a: Column, b: int) -> Column:
    """Whole part of a / b, rounded down."""
    return F.floor(a.cast("double") / F.lit(float(b))).cast("bigint")


def cell_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Axial (q, r) of the cell of a point."""
    j = _div(y, H)
    i = _div(x + F.pmod(j, F.lit(2)) * (W // 2), W)
    return i - _div(j - F.pmod(j, F.lit(2)), 2), j


def parent_of(q: Column, r: Column) -> tuple[Column, Column]:
    """Axial (q, r) of the parent; seven children each."""
    f = F.pmod(q + 5 * r, F.lit(7))
    pick = lambda k: F.element_at(F.array(*[F.lit(_CHILD[v][k]).cast("bigint") for v in range(7)]), (f + 1).cast("int"))
    q0, r0 = q - pick(0), r - pick(1)
    return _div(3 * q0 + r0, 7), _div(2 * r0 - q0, 7)


def children_of(q: Column, r: Column) -> Column:
    """Array of the seven children of a parent."""
    cq, cr = 2 * q - r, q + 3 * r
    return F.array(*[F.struct((cq + a).alias("q"), (cr + b).alias("r")) for a, b in _CHILD.values()])


def disk_offsets(k: int) -> list[tuple[int, int]]:
    """The 3k^2 + 3k + 1 axial offsets within k steps."""
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a + b) <= k]


def with_disk(df: DataFrame, k: int, q: str = "q", r: str = "r", to: tuple[str, str] = ("dq", "dr")) -> DataFrame:
    """Each row once for every cell within k steps of its own."""
    at = F.array(*[F.struct((F.col(q) + a).alias(to[0]), (F.col(r) + b).alias(to[1])) for a, b in disk_offsets(k)])
    return df.withColumn("_d", F.explode(at)).select("*", f"_d.{to[0]}", f"_d.{to[1]}").drop("_d")


def steps(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Steps between two cells."""
    a, b = q2 - q1, r2 - r1
    return F.greatest(F.abs(a), F.abs(b), F.abs(a + b))


def key(res: int, q: Column, r: Column) -> Column:
    return F.concat_ws(":", F.lit(str(res)), q.cast("string"), r.cast("string"))


def centre(q: Column, r: Column) -> tuple[Column, Column]:
    """x, y of a cell's middle."""
    i = q + _div(r - F.pmod(r, F.lit(2)), 2)
    return i * W - F.pmod(r, F.lit(2)) * (W // 2) + W // 2, r * H + H // 2


def boundary(q: Column, r: Column) -> Column:
    """Closed ring of the cell's six corners (two on either long side, two in the middle of them)."""
    x, y = centre(q, r)
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    w, h = W // 2, H // 2
    return F.array(*[corner(a, b) for a, b in ((-w, -h), (0, -h), (w, -h), (w, h), (0, h), (-w, h), (-w, -h))])


def located(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with coordinates, with x, y, q, r and the parent's pq, pr."""
    x, y = plane(F.col(lat), F.col(lon))
    df = df.dropna(subset=[lat, lon]).withColumns({"x": x, "y": y})
    q, r = cell_of(F.col("x"), F.col("y"))
    df = df.withColumns({"q": q, "r": r})
    pq, pr = parent_of(F.col("q"), F.col("r"))
    return df.withColumns({"pq": pq, "pr": pr})


# The same in SQL, for the oracle: columns of a table with lat and lon.
SQL_POINT = f"""CAST(floor((lon - {ORIGIN[0]}) * {SCALE[0]}) AS BIGINT) x, CAST(floor((lat - {ORIGIN[1]}) * {SCALE[1]}) AS BIGINT) y"""
SQL_CELL = f"""CAST(floor((x + ((CAST(floor(y / {H}.0) AS BIGINT) % 2 + 2) % 2) * {W // 2}) / {W}.0) AS BIGINT) - CAST(floor((CAST(floor(y / {H}.0) AS BIGINT) - (CAST(floor(y / {H}.0) AS BIGINT) % 2 + 2) % 2) / 2.0) AS BIGINT) q, CAST(floor(y / {H}.0) AS BIGINT) r"""
_Q0 = "(q - CASE ((q + 5 * r) % 7 + 7) % 7 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN -1 WHEN 6 THEN -1 ELSE 0 END)"
_R0 = "(r - CASE ((q + 5 * r) % 7 + 7) % 7 WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END)"
SQL_PARENT = f"CAST(floor((3 * {_Q0} + {_R0}) / 7.0) AS BIGINT) pq, CAST(floor((2 * {_R0} - {_Q0}) / 7.0) AS BIGINT) pr"


def sql_located(source: str) -> str:
    """SELECT of a table's rows that have coordinates with x, y, q, r, pq, pr."""
    return f"SELECT *, {SQL_PARENT} FROM (SELECT *, {SQL_CELL} FROM (SELECT *, {SQL_POINT} FROM {source} WHERE lat IS NOT NULL AND lon IS NOT NULL))"


def sql_disk(k: int) -> str:
    return f"SELECT a.v da, b.v db FROM (SELECT unnest(range(-{k}, {k + 1})) v) a, (SELECT unnest(range(-{k}, {k + 1})) v) b WHERE abs(a.v + b.v) <= {k}"
