"""Readers: snapshot folders, drifting schemas, commented CSV, relations of rings, fingerprints of files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from hexloom import files as shared

# Where the category may be, in order of preference.
CATEGORY_PATHS = ("categories.primary", "categories.main", "taxonomy.primary")
# Names of a box's edges.
BOX_FIELDS = (("xmin", "ymin", "xmax", "ymax"), ("minx", "miny", "maxx", "maxy"))


MANIFEST = "_manifest.json"


def published(spark: SparkSession, base: str) -> list[str]:
    """Ids of the snapshots under `base` that are whole: their manifest is there. In order."""
    names = [n for n in shared.folders(spark, base) if n.startswith("snapshot=")]
    return sorted(n.split("=", 1)[1] for n in names if shared.exists(spark, f"{base}/{n}/{MANIFEST}"))


def snapshots(spark: SparkSession, base: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All published snapshot=<id> folders under `base` as one table; the id is a text column and prunes folders."""
    paths = [f"{base}/snapshot={s}" for s in published(spark, base)]
    if not paths:
        raise FileNotFoundError(f"no published snapshot in {base}")
    df = spark.read.option("basePath", base).parquet(*paths)
    df = df.withColumn("snapshot", F.col("snapshot").cast("string"))
    return df.select(*columns, "snapshot") if columns else df


def latest_snapshot(spark: SparkSession, base: str) -> str | None:
    """Greatest published snapshot id by name, from the listing alone; None for no folder."""
    return max(published(spark, base), default=None)


def scan_plan(df: DataFrame) -> dict[str, int]:
    """Files and bytes a plan would read, after pruning of folders, without reading them."""
    spark = df.sparkSession
    jvm = spark._jvm
    sizes = {}
    for f in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(f)
        sizes[f] = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return {"files": len(sizes), "bytes": sum(sizes.values())}


def catalogue_scan(spark: SparkSession, base: str, box: tuple[float, float, float, float], columns: Sequence[str], lon: str = "lon", lat: str = "lat") -> tuple[DataFrame, dict[str, int]]:
    """(rows, plan): the latest published snapshot, a box of coordinates and some columns; with what is scanned of what there is.

    Comparisons reach the scan, the snapshot prunes folders, other columns are not read.
    """
    whole = snapshots(spark, base)
    last = latest_snapshot(spark, base)
    x0, y0, x1, y1 = box
    own = whole.filter(F.col("snapshot") == last)
    got = own.filter((F.col(lon) >= x0) & (F.col(lon) <= x1) & (F.col(lat) >= y0) & (F.col(lat) <= y1)).select(*columns)
    plan, all_ = scan_plan(spark.read.parquet(f"{base}/snapshot={last}")), scan_plan(whole)
    return got, {**plan, "files_of": all_["files"], "bytes_of": all_["bytes"]}


def tiles(spark: SparkSession, glob: str, decode, schema: str) -> DataFrame:
    """Rasters in files, one task for each file's content: decode(path, content) gives rows of `schema`.

    Files that decode can't read raise; a file without pixels gives no rows.
    """
    raw = spark.read.format("binaryFile").load(glob).select("path", "content").repartition("path")

    def rows(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(decode(path, bytes(content))), columns=[f.split()[0] for f in schema.split(", ")])

    return raw.mapInPandas(rows, schema)


def tiles_meeting(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(name, xmin, ymin, xmax, ymax) of a manifest's tiles that meet a box. The manifest is JSON: an array of objects, or one object a line."""
    m = spark.read.option("multiLine", True).json(path)
    m = m.select("name", *[F.col(c).cast("double").alias(c) for c in BOX_FIELDS[0]]).dropna()
    x0, y0, x1, y1 = box
    return m.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def pixel_grid(path: str, content: bytes):
    """Rows (tile, row, col, value) of a plain-text grid: numbers in lines, blanks between them, `nan` for none."""
    tile = path.rsplit("/", 1)[-1]
    for r, line in enumerate(content.decode().splitlines()):
        for c, v in enumerate(line.split()):
            if v != "nan":
                yield tile, r, c, float(v)


def hex_populations(spark: SparkSession, path: str, key: str = "h3", value: str = "population") -> DataFrame:
    """(cell, population) of a table of hexagons, from parquet or commented CSV; rows without a valid id or number are skipped."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else commented_csv(spark, path)
    got = parse_cells(df.withColumn(key, F.lower(F.col(key))), key)
    number = F.expr(f"try_cast(`{value}` as double)")
    return got.withColumn("population", number).dropna(subset=["population"]).select("cell", "population")


def files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One table from a list of parquet files."""
    return spark.read.parquet(*paths)


def scan_files(df: DataFrame) -> list[str]:
    """Files a plan would read, after pruning."""
    return df.inputFiles()


def commented_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted fields over several lines, and lines of comment that begin with #."""
    reader = spark.read.option("header", True).option("comment", "#").option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def _has(schema: Ty.StructType, path: str) -> bool:
    at: Ty.DataType = schema
    for part in path.split("."):
        if not isinstance(at, Ty.StructType) or part not in at.fieldNames():
            return False
        at = at[part].dataType
    return True


def category_of(df: DataFrame) -> Column:
    """The category column under any of the known schemas; LookupError if there is none. Decided from the schema, not the data."""
    for path in CATEGORY_PATHS:
        if _has(df.schema, path):
            return F.col(path)
    raise LookupError(f"no category among {', '.join(CATEGORY_PATHS)}; columns: {', '.join(df.columns)}")


def box_of(df: DataFrame, column: str = "bbox") -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax under either naming."""
    for names in BOX_FIELDS:
        if all(_has(df.schema, f"{column}.{n}") for n in names):
            return tuple(F.col(f"{column}.{n}") for n in names)
    raise LookupError(f"no box with known edges in {column}")


def in_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, column: str = "bbox") -> DataFrame:
    """Rows whose box meets a rectangle; plain comparisons of nested fields, which reach the parquet scan."""
    x0, y0, x1, y1 = box_of(df, column)
    return df.filter((x0 <= xmax) & (x1 >= xmin) & (y0 <= ymax) & (y1 >= ymin))


def record_source(sources: Column) -> Column:
    """dataset of the entry of sources (array of property, dataset) that stands for the whole record; 'unknown' without one."""
    whole = F.filter(sources, lambda s: s["property"] == "")
    return F.coalesce(F.try_element_at(whole, F.lit(1))["dataset"], F.lit("unknown"))


def rings(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring_no, lon, lat, n): points of the outer members of relations in JSON, in order."""
    members = spark.read.option("multiLine", True).json(path).select("tags.name", F.explode("members").alias("m"))
    outer = members.filter((F.col("m.role") == "outer") & (F.size("m.geometry") > 0)).select("name", F.monotonically_increasing_id().alias("ring_no"), F.posexplode("m.geometry").alias("n", "p"))
    return outer.select("name", "ring_no", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "n")


def stitched(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings from lines that share end points, turned where needed; a line that closes nothing is left as it is."""
    todo, done = [list(p) for p in parts if p], []
    while todo:
        line = todo.pop(0)
        grown = True
        while grown and line[0] != line[-1]:
            grown = False
            for k, other in enumerate(todo):
                if other[0] == line[-1] or other[-1] == line[-1]:
                    line += (other if other[0] == line[-1] else other[::-1])[1:]
                    todo.pop(k)
                    grown = True
                    break
        done.append(line)
    return done


def file_fingerprints(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length, fingerprint): first 16 digits of the SHA-256 of each file."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))


def parse_cells(df: DataFrame, column: str) -> DataFrame:
    """Rows whose cell id is 15 hexadecimal digits, with cell BIGINT; others are skipped."""
    ok = F.lower(F.col(column)).rlike("^[0-9a-f]{15}$")
    return df.filter(ok).withColumn("cell", F.conv(column, 16, 10).cast("bigint"))
