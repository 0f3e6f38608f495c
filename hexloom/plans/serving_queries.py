"""Search, listings, point lookups and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexloom.functions import confidence as conf
from hexloom.functions import grid
from hexloom.functions.geo import haversine_m
from hexloom.functions.text import plural, thousands
from hexloom.functions.categories import delimited, has_group, short
from hexloom.operators import metrics as M
from hexloom.operators import search as S
from hexloom.operators.report import ring_cells
from hexloom.operators.serving import in_ring
from hexloom.plans import built_queries as built
from hexloom.plans.base import CELLS_SQL, POINTS_SQL, PLACES_SQL, points, query, valid_places
from hexloom.plans.built_queries import K, ORIGIN

SEARCH = S.Search(category="pharmacy", ranges={"population": (50.0, None), "builtup_pct": (5.0, 95.0)}, min_confidence="single_source", sort="people_per_competitor")
HALF_EARTH = 6_371_000.0


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return S.gated(built.served_cells(spark, d), built.served_counts(spark, d), SEARCH)


_GATED = f"""WITH {CELLS_SQL},
m AS ({M.sql_business_counts('q, r', 'pt')}),
rows AS (SELECT cell.*, t.value total, CASE WHEN t.value IS NOT NULL THEN coalesce(o.value, 0) END AS n, coalesce(o.confidence, t.confidence, 'unavailable') confidence
  FROM cell LEFT JOIN (FROM m WHERE metric = 'total') t USING (q, r) LEFT JOIN (FROM m WHERE metric = 'pharmacy') o USING (q, r)),
gated AS (SELECT *, population / nullif(n, 0) AS ratio, CASE WHEN coalesce(density_distorted, false) THEN 'distorted'
  WHEN NOT (coalesce(population, 0) >= 100 AND coalesce(builtup_pct >= 5, false)) THEN 'uninhabited'
  WHEN total IS NULL THEN 'no_business_data' WHEN population IS NULL THEN 'no_population_data' WHEN population / nullif(n, 0) IS NULL THEN 'undefined_ratio' END gate FROM rows),
matched AS (SELECT * FROM gated WHERE gate IS NULL AND population >= 50 AND builtup_pct >= 5 AND builtup_pct <= 95 AND {conf.sql_rank('confidence')} >= 1)"""


@query(f"{_GATED} SELECT coalesce(gate, 'searchable') AS gate, count(*) AS cells FROM gated GROUP BY 1")
def search_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, FLT-10: the first reason counts"""
    return _gated(spark, d).groupBy(F.coalesce("gate", F.lit("searchable")).alias("gate")).agg(F.count("*").alias("cells"))


@query(f"{_GATED} SELECT q, r, governorate, population, n AS competitors, round(ratio, 6) people_per_competitor, confidence FROM matched ORDER BY ratio DESC, q, r LIMIT 100")
def cell_search(spark: SparkSession, d: str) -> DataFrame:
    """Q-04: FLT-08, FLT-12, SR-02, SR-03; the limit is the feature"""
    got = S.top(S.matched(_gated(spark, d), SEARCH), SEARCH)
    return got.select("q", "r", "governorate", "population", F.col("count").alias("competitors"), F.round("people_per_competitor", 6).alias("people_per_competitor"), "confidence")


@query(f"{_GATED} SELECT max(population) AS top, count(*) FILTER (population >= 0.995 * mx) AS cells, count(*) FILTER (population >= 0.995 * mx) >= 10 AS is_plateau FROM (SELECT *, max(population) OVER () mx FROM matched)")
def search_plateau(spark: SparkSession, d: str) -> DataFrame:
    """AG-28"""
    return S.plateau(S.matched(_gated(spark, d), SEARCH))


@query(f"{_GATED} SELECT count(*) AS cells, count(*) FILTER (1 + growth_pct / 100 > 0 AND builtup_pct / nullif(1 + growth_pct / 100, 0) < 1) AS tiny_base FROM matched")
def search_tiny_base(spark: SparkSession, d: str) -> DataFrame:
    """AG-29, SCL-27"""
    return S.tiny_base(S.matched(_gated(spark, d), SEARCH))


@query(f"{_GATED} SELECT sum(total) AS businesses, sum(n) AS in_category, round(100 * sum(n) / sum(total), 6) AS pct FROM gated WHERE gate IS NULL OR gate NOT IN ('distorted')")
def categorised_share(spark: SparkSession, d: str) -> DataFrame:
    """AG-30: measured in the scan, before the inhabited gate"""
    g = _gated(spark, d).filter(~F.coalesce(F.col("gate") == "distorted", F.lit(False)))
    return g.agg(F.sum("total").alias("businesses"), F.sum("count").alias("in_category"), F.round(100 * F.sum("count") / F.sum("total"), 6).alias("pct"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    pts = in_ring(built.served_places(spark, d), ring_cells(spark, *ORIGIN, K))
    at = Window.partitionBy(F.round("lat", 6), F.round("lon", 6))
    dist = haversine_m(F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.col("lat"), F.col("lon"))
    return pts.withColumns({"distance_m": F.round(dist, 3), "same_point": F.count("*").over(at)})


_LISTED = f"""WITH {POINTS_SQL},
o AS (SELECT q oq, r orr FROM ({grid.sql_located(f'(SELECT {ORIGIN[0]} lat, {ORIGIN[1]} lon)')})),
ring AS (SELECT oq + da q, orr + db r FROM o, ({grid.sql_disk(K)})),
listed AS (SELECT pt.*, count(*) OVER (PARTITION BY round(lat, 6), round(lon, 6)) same_point, round(2 * {HALF_EARTH} * asin(least(1, sqrt(pow(sin(radians(lat - {ORIGIN[0]}) / 2), 2) + cos(radians({ORIGIN[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {ORIGIN[1]}) / 2), 2)))), 3) distance_m FROM pt JOIN ring USING (q, r))"""


@query(f"{_LISTED} SELECT source, place_id, name, distance_m, same_point FROM listed")
def places_in_catchment(spark: SparkSession, d: str) -> DataFrame:
    """Q-05: JN-18, SCL-18, WN-04"""
    return _listed(spark, d).select("source", "place_id", "name", "distance_m", "same_point")


#: Rows of a page where none are asked for, and at most.
PAGE, MOST = 200, 500


def page(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    """(limit, offset) of a listing: without a positive limit PAGE, at most MOST; a negative offset is none."""
    return min(limit, MOST) if limit and limit > 0 else PAGE, offset if offset and offset > 0 else 0


@query(f"{_LISTED} SELECT source, place_id, distance_m FROM listed ORDER BY distance_m, name NULLS FIRST, source, place_id LIMIT 50 OFFSET 20")
def places_paging(spark: SparkSession, d: str) -> DataFrame:
    """SR-04, SR-05, SR-06: the page is the feature"""
    limit, offset = page(50, 20)
    return _listed(spark, d).orderBy("distance_m", "name", "source", "place_id").offset(offset).limit(limit).select("source", "place_id", "distance_m")


@query(f"{_LISTED} SELECT count(*) AS listed, count(*) FILTER (same_point > 1) AS stacked, count(*) FILTER (dup_suspected) AS flagged, count(*) FILTER (list_contains(groups, 'cafe')) AS cafes FROM listed")
def places_totals(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14, FLT-15, AG-40"""
    p = _listed(spark, d)
    return p.agg(F.count("*").alias("listed"), F.count_if(F.col("same_point") > 1).alias("stacked"), F.count_if("dup_suspected").alias("flagged"), F.count_if(has_group(delimited(F.col("groups")), "cafe")).alias("cafes"))


@query(f"WITH {POINTS_SQL} SELECT source, place_id, count(*) OVER (PARTITION BY round(lat, 6), round(lon, 6)) AS same_point, count(*) OVER (PARTITION BY lat, lon) > 1 AS collapsed FROM pt")
def same_point_counts(spark: SparkSession, d: str) -> DataFrame:
    """WN-03, WN-04, over all places: counted by coordinate first, so that a crowded one is one row"""
    p = points(spark, d)
    near = p.groupBy(F.round("lat", 6).alias("a"), F.round("lon", 6).alias("b")).agg(F.count("*").alias("same_point"))
    same = p.groupBy("lat", "lon").agg((F.count("*") > 1).alias("collapsed"))
    rows = p.select("source", "place_id", "lat", "lon", F.round("lat", 6).alias("a"), F.round("lon", 6).alias("b"))
    return rows.join(near, ["a", "b"]).join(same, ["lat", "lon"]).select("source", "place_id", "same_point", "collapsed")


_TERM = "grocery"


@query(f"""WITH {PLACES_SQL}, hit AS (SELECT name, lat, lon, CASE WHEN lower(name) = '{_TERM}' THEN 0 WHEN starts_with(lower(name), '{_TERM}') THEN 1 ELSE 2 END rk,
  row_number() OVER (PARTITION BY lower(name), round(lat, 4), round(lon, 4) ORDER BY source, place_id) rn FROM vp WHERE contains(lower(name), '{_TERM}') AND lat IS NOT NULL)
SELECT name, round(lat, 4) lat, round(lon, 4) lon FROM hit WHERE rn = 1 ORDER BY rk, length(name), name, lat, lon LIMIT 5""")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Q-06, SR-07, SCL-15: the five most relevant, each name and place once; the limit is the feature"""
    low = F.lower("name")
    hit = valid_places(spark, d).filter(low.contains(_TERM) & F.col("lat").isNotNull())
    rank = F.when(low == _TERM, 0).when(low.startswith(_TERM), 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy(low, F.round("lat", 4), F.round("lon", 4)).orderBy("source", "place_id"))
    got = hit.withColumns({"rk": rank, "rn": first}).filter("rn = 1").select("name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "rk")
    return got.orderBy("rk", F.length("name"), "name", "lat", "lon").limit(5).drop("rk")


@query(f"""WITH {CELLS_SQL}, probe AS (SELECT * FROM ({grid.sql_located('(SELECT * FROM (VALUES (24.5, 25.0), (24.5, 27.0), (10.0, 10.0)) v(lat, lon))')}))
SELECT probe.lat::DOUBLE AS lat, probe.lon::DOUBLE AS lon, cell.q IS NOT NULL AS covered, cell.governorate, cell.land_fraction FROM probe LEFT JOIN cell ON cell.q = probe.q AND cell.r = probe.r""")
def coverage_probe(spark: SparkSession, d: str) -> DataFrame:
    """Q-07, GEO-01"""
    probe = grid.located(spark.createDataFrame([(24.5, 25.0), (24.5, 27.0), (10.0, 10.0)], "lat double, lon double"))
    near = [tuple(r) for r in probe.select("q", "r").collect()]  # the points asked for
    c = in_ring(built.served_cells(spark, d), near).select("q", "r", "governorate", "land_fraction", F.lit(True).alias("covered"))
    return c.join(F.broadcast(probe.select("lat", "lon", "q", "r")), ["q", "r"], "right").select("lat", "lon", F.coalesce("covered", F.lit(False)).alias("covered"), "governorate", "land_fraction")


@query(f"""WITH {PLACES_SQL} SELECT category, count(*) AS n, upper(substr(replace(split_part(category, ' > ', -1), '_', ' '), 1, 1)) || lower(substr(replace(split_part(category, ' > ', -1), '_', ' '), 2)) AS label,
format('{{:,}}', count(*)) AS shown FROM vp WHERE category IS NOT NULL GROUP BY 1""")
def short_category(spark: SparkSession, d: str) -> DataFrame:
    """SCL-11, SCL-13, PRJ-03"""
    n = valid_places(spark, d).dropna(subset=["category"]).groupBy("category").agg(F.count("*").alias("n"))
    return n.select("category", "n", short(F.col("category")).alias("label"), thousands(F.col("n")).alias("shown"))


@query(f"""WITH {PLACES_SQL}, c AS (SELECT DISTINCT split_part(category, ' > ', -1) w FROM vp WHERE category IS NOT NULL)
SELECT w AS word, CASE WHEN regexp_matches(w, '(?i)[^aeiou]y$') THEN left(w, length(w) - 1) || 'ies' WHEN regexp_matches(w, '(?i)(s|x|z|ch|sh)$') THEN w || 'es' ELSE w || 's' END AS plural FROM c""")
def plural_labels(spark: SparkSession, d: str) -> DataFrame:
    """SCL-12"""
    from hexloom.functions.categories import leaf

    words = valid_places(spark, d).dropna(subset=["category"]).select(leaf(F.col("category")).alias("word")).dropDuplicates()
    return words.select("word", plural(F.col("word")).alias("plural"))


