"""Inputs that the query modules share, in Spark and in SQL, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import categories as cat
from hexloom.functions import grid
from hexloom.operators.snapshots import latest_valid
from hexloom.runtime import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


PLACE_FIELDS = ["name", "category", "lat", "lon", "h3_res9", "h3_res8", "dup_suspected"]


def valid_places(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows of each source's latest snapshot."""
    return latest_valid(table(spark, d, "places"), group="source", key="place_id", snapshot="snapshot", version="delivered_at", values=PLACE_FIELDS)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Those that have coordinates, on the lattice, with their category groups."""
    return grid.located(valid_places(spark, d)).withColumn("groups", cat.groups_of(F.col("source"), F.col("category")))


PLACES_SQL = """last AS (SELECT source, max(snapshot) snapshot FROM places GROUP BY 1),
vp AS (SELECT * EXCLUDE (rn) FROM (SELECT p.source, p.place_id, p.name, p.category, p.lat, p.lon, p.h3_res9, p.h3_res8, p.dup_suspected,
  row_number() OVER (PARTITION BY p.source, p.place_id ORDER BY p.delivered_at DESC) rn FROM places p JOIN last USING (source, snapshot)) WHERE rn = 1)"""
POINTS_SQL = f"{PLACES_SQL},\npt AS (SELECT *, {cat.SQL_GROUPS} AS groups FROM ({grid.sql_located('vp')}))"


def history(spark: SparkSession, d: str) -> DataFrame:
    """One row for each series and snapshot: copies melt, of several the latest written."""
    h = table(spark, d, "h3_metric_history")
    row = F.max(F.struct("written_at", "value", "as_of", "confidence")).alias("v")
    return h.groupBy("h3_index", "metric", "snapshot_id").agg(row, F.max("h3_res").alias("h3_res")).select("h3_index", "h3_res", "metric", "snapshot_id", "v.value", "v.as_of", "v.confidence")


HISTORY_SQL = """hist AS (SELECT * EXCLUDE (written_at, rn) FROM (SELECT h3_index, max(h3_res) OVER (PARTITION BY h3_index, metric, snapshot_id) h3_res, metric, snapshot_id, value, as_of, confidence, written_at,
  row_number() OVER (PARTITION BY h3_index, metric, snapshot_id ORDER BY written_at DESC, value DESC NULLS LAST, as_of DESC, confidence DESC) rn FROM h3_metric_history) WHERE rn = 1)"""


def plausible(metric: str = "metric", value: str = "value"):
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf"))) & ((F.col(metric) != "builtup_pct") | (v <= 100))


PLAUSIBLE_SQL = "value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND value < 'inf'::DOUBLE AND (metric <> 'builtup_pct' OR value <= 100)"


def populations(spark: SparkSession, d: str) -> DataFrame:
    """(h3_index, h3_res, population, pop_as_of, pop_confidence, pop_snapshot): last plausible value of each cell, with where it comes from."""
    h = history(spark, d).filter((F.col("metric") == "population") & plausible())
    last = F.max_by(F.struct("value", "as_of", "confidence", "snapshot_id"), "snapshot_id").alias("v")
    return h.groupBy("h3_index", "h3_res").agg(last).select("h3_index", "h3_res", F.col("v.value").alias("population"), F.col("v.as_of").alias("pop_as_of"), F.col("v.confidence").alias("pop_confidence"), F.col("v.snapshot_id").alias("pop_snapshot"))


POP_SQL = f"""{HISTORY_SQL},
pop AS (SELECT h3_index, h3_res, value population, as_of pop_as_of, confidence pop_confidence, snapshot_id pop_snapshot FROM (SELECT *, row_number() OVER (PARTITION BY h3_index, h3_res ORDER BY snapshot_id DESC) rn FROM hist WHERE metric = 'population' AND {PLAUSIBLE_SQL}) WHERE rn = 1)"""
#: Where the population of a lattice cell comes from: the area met in it that has most.
POP_FROM = ("pop_as_of", "pop_confidence", "pop_snapshot", "pop_res")


def cells(spark: SparkSession, d: str, pts: DataFrame | None = None) -> DataFrame:
    """Lattice cells that hold a place, with the attributes of the areas met in them. Land area is the cell's share of land."""
    pts = points(spark, d) if pts is None else pts
    own = pts.select("q", "r", "pq", "pr", F.col("h3_res9").alias("h3_index")).dropna(subset=["h3_index"]).dropDuplicates()
    attrs = table(spark, d, "h3_cell").select("h3_index", "land_fraction", "governorate", "builtup_pct", "coverage_ratio", F.col("builtup_growth_pct_2015_2025").alias("growth_pct"), "density_distorted")
    joined = own.join(attrs, "h3_index").join(populations(spark, d).withColumnRenamed("h3_res", "pop_res"), "h3_index", "left")
    most = F.max(F.when(F.col("population").isNotNull(), F.struct("population", *POP_FROM)))
    got = joined.groupBy("q", "r", "pq", "pr").agg(
        F.max("land_fraction").alias("land_fraction"), (F.max("land_fraction") * grid.CELL_M2).alias("land_area_m2"), F.min("governorate").alias("governorate"),
        F.max("builtup_pct").alias("builtup_pct"), F.max("coverage_ratio").alias("coverage_ratio"), F.max("growth_pct").alias("growth_pct"),
        F.max("population").alias("population"), F.max("density_distorted").alias("density_distorted"), most.alias("_p"),
    )
    return got.select("*", *[F.col(f"_p.{c}").alias(c) for c in POP_FROM]).drop("_p")


_MOST = "ORDER BY population DESC NULLS LAST, pop_as_of DESC, pop_confidence DESC, pop_snapshot DESC, pop.h3_res DESC"
CELLS_SQL = f"""{POINTS_SQL},
{POP_SQL},
cell AS (SELECT q, r, pq, pr, max(land_fraction) land_fraction, max(land_fraction) * {grid.CELL_M2} land_area_m2, min(governorate) governorate, max(builtup_pct) builtup_pct,
  max(coverage_ratio) coverage_ratio, max(builtup_growth_pct_2015_2025) growth_pct, max(population) population, max(density_distorted) density_distorted,
  first(CASE WHEN population IS NOT NULL THEN pop_as_of END {_MOST}) pop_as_of, first(CASE WHEN population IS NOT NULL THEN pop_confidence END {_MOST}) pop_confidence,
  first(CASE WHEN population IS NOT NULL THEN pop_snapshot END {_MOST}) pop_snapshot, first(CASE WHEN population IS NOT NULL THEN pop.h3_res END {_MOST}) pop_res
  FROM (SELECT DISTINCT q, r, pq, pr, h3_res9 h3_index FROM pt WHERE h3_res9 IS NOT NULL) JOIN h3_cell USING (h3_index) LEFT JOIN pop USING (h3_index) GROUP BY 1, 2, 3, 4)"""
