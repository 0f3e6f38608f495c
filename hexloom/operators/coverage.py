"""Coverage, rasters held as tables of pixels, and sets of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions import grid


def split_by_confidence(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, cells, counts and percentages by confidence), one decimal; by may be empty for one row."""
    n = F.count("*")
    out = [n.alias("cells")]
    for c in ("corroborated", "single_source", "unavailable"):
        k = F.count_if(F.col("confidence") == c)
        out += [k.alias(c), F.round(100 * F.try_divide(k, n), 1).alias(f"pct_{c}")]
    return df.groupBy(*by).agg(*out)


def pixel_points(pixels: DataFrame, a: float, c: float, e: float, f: float) -> DataFrame:
    """lon, lat of the middle of each non-zero pixel of a north-up raster with that affine transform."""
    return pixels.filter(F.col("value") != 0).withColumns({"lon": F.lit(c) + (F.col("col") + 0.5) * F.lit(a), "lat": F.lit(f) + (F.col("row") + 0.5) * F.lit(e)})


def window(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels of a half-open window; the ranges reach the scan."""
    return pixels.filter((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def superpixels(pixels: DataFrame, side: int = T.superpixel) -> DataFrame:
    """(tile, srow, scol, n, total, present, mean_present): squares of pixels summed before anything coarser."""
    at = lambda c: F.floor(F.col(c) / F.lit(side)).cast("bigint")
    there = F.col("value") > 0.5
    return pixels.groupBy("tile", at("row").alias("srow"), at("col").alias("scol")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(there).alias("present"), F.avg(F.when(there, F.col("value"))).alias("mean_present"))


def land_fraction(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, land_fraction, n_pixels, n_nodata): mean of the pixels that have data, 0 where none has."""
    v = F.nullif(F.col("value"), F.lit(float(T.land_nodata)))
    return pixels.groupBy(*by).agg(F.bround(F.coalesce(F.avg(v) / T.land_scale, F.lit(0.0)), 4).alias("land_fraction"), F.count("*").alias("n_pixels"), F.count_if(F.col("value") == T.land_nodata).alias("n_nodata"))


def dilated(mask: DataFrame, steps: int) -> DataFrame:
    """(row, col) within `steps` of a marked pixel, by steps along rows and columns."""
    at = [(i, j) for i in range(-steps, steps + 1) for j in range(-(steps - abs(i)), steps - abs(i) + 1)]
    near = F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in at])
    return mask.select("row", "col").dropDuplicates().select(F.explode(near).alias("p")).select("p.row", "p.col").dropDuplicates()


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; ring: array of structs lon, lat, not closed; null coordinates lie nowhere."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        at = (b["lon"] - a["lon"]) * F.try_divide(y - a["lat"], b["lat"] - a["lat"]) + a["lon"]
        return F.when(((a["lat"] > y) != (b["lat"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def cells_of_ring(areas: DataFrame, key: str = "area_id", ring: str = "ring") -> DataFrame:
    """(key, q, r) of the cells whose middle lies in the polygon, from the ring's own range of rows and columns."""
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    x0, y0 = grid.plane(F.array_min(lat), F.array_min(lon))
    x1, y1 = grid.plane(F.array_max(lat), F.array_max(lon))
    rows = areas.filter(F.size(ring) >= 3).select(key, ring, x0.alias("x0"), x1.alias("x1"), F.explode(F.sequence(F.floor(y0 / grid.H).cast("bigint"), F.floor(y1 / grid.H).cast("bigint"))).alias("r"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.floor(F.col("x0") / grid.W).cast("bigint") - 1, F.floor(F.col("x1") / grid.W).cast("bigint") + 1)))
    rows = rows.withColumn("q", F.col("i") - F.floor((F.col("r") - F.pmod("r", F.lit(2))) / 2).cast("bigint"))
    cx, cy = grid.centre(F.col("q"), F.col("r"))
    rows = rows.withColumns({"_lon": F.lit(grid.ORIGIN[0]) + cx / grid.SCALE[0], "_lat": F.lit(grid.ORIGIN[1]) + cy / grid.SCALE[1]})
    return rows.filter(inside_ring(F.col("_lon"), F.col("_lat"), F.col(ring))).select(key, "q", "r").dropDuplicates()


def feature(q: Column, r: Column, properties: Column) -> Column:
    """A GeoJSON feature of a cell as text."""
    ring = F.transform(grid.boundary(q, r), lambda p: F.array((F.lit(grid.ORIGIN[0]) + p["x"] / grid.SCALE[0]), (F.lit(grid.ORIGIN[1]) + p["y"] / grid.SCALE[1])))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
