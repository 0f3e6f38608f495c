"""Coverage, rasters, sources and analyses over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexloom.files import shared_folder
from hexloom.functions import categories as cat
from hexloom.functions import confidence as conf
from hexloom.functions.geo import haversine_m, segment_m
from hexloom.functions.text import date_shape, text_map
from hexloom.operators import coverage as C
from hexloom.operators import metrics as M
from hexloom.operators import sampling as SA
from hexloom.operators.search import inhabited
from hexloom.operators.series import direction
from hexloom.plans.base import CELLS_SQL, HISTORY_SQL, PLACES_SQL, PLAUSIBLE_SQL, POINTS_SQL, cells, history, plausible, points, query, valid_places
from hexloom.runtime import table
from hexloom.sources import sinks


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    pts = points(spark, d)
    total = M.business_counts(pts, ["q", "r"]).filter("metric = 'total'").select("q", "r", "confidence", "value")
    c = cells(spark, d, pts).join(total, ["q", "r"], "left").withColumn("confidence", F.coalesce("confidence", F.lit("unavailable")))
    return c.withColumn("inhabited", inhabited(F.col("population"), F.col("builtup_pct")))


_COVER = f"""WITH {CELLS_SQL}, m AS ({M.sql_business_counts('q, r', 'pt')}),
cov AS (SELECT cell.*, coalesce(m.confidence, 'unavailable') confidence, m.value, coalesce(population, 0) >= 100 AND coalesce(builtup_pct >= 5, false) inhabited FROM cell LEFT JOIN (FROM m WHERE metric = 'total') m USING (q, r))"""
_SPLIT = "count(*) AS cells, " + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}, round(100.0 * count(*) FILTER (confidence = '{c}') / count(*), 1) AS pct_{c}" for c in conf.LEVELS)


@query(f"{_COVER} SELECT 'all' AS scope, {_SPLIT} FROM cov UNION ALL SELECT 'inhabited', {_SPLIT} FROM cov WHERE inhabited HAVING count(*) > 0")
def coverage_split(spark: SparkSession, d: str) -> DataFrame:
    """AG-19, JN-07"""
    c = _coverage(spark, d)
    rows = c.withColumn("scope", F.explode(F.when(F.col("inhabited"), F.array(F.lit("all"), F.lit("inhabited"))).otherwise(F.array(F.lit("all")))))
    return C.split_by_confidence(rows, ["scope"])


@query(f"{_COVER} SELECT governorate, {_SPLIT} FROM cov GROUP BY 1")
def inhabited_by_region(spark: SparkSession, d: str) -> DataFrame:
    """AG-19, SR-13"""
    return C.split_by_confidence(_coverage(spark, d), ["governorate"]).orderBy("pct_unavailable", "governorate")


@query()
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """GEO-04: one feature for each cell, as text"""
    c = _coverage(spark, d)
    return c.select("q", "r", C.feature(F.col("q"), F.col("r"), F.struct("governorate", "confidence", "population", "inhabited")).alias("feature"))


@query(f"{_COVER} SELECT count(*) + 2 AS lines, count(*) AS features, 1 AS documents FROM cov")
def geojson_document(spark: SparkSession, d: str) -> DataFrame:
    """SNK-05: all features as one collection, written by many tasks and read again"""
    at = shared_folder(spark, "collection")
    sinks.write_feature_collection(geojson_features(spark, d), at, key=["q", "r"])
    lines = spark.read.text(at)
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains('"Feature"')).alias("features"), F.count_if(F.col("value").contains("FeatureCollection")).alias("documents"))


_RING = "[{'a': ring[i], 'b': ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END]} for i in range(1, len(ring) + 1)]"
_IN = "len([1 for e in edges if (e.a.lat > {y}) <> (e.b.lat > {y}) AND {x} < (e.b.lon - e.a.lon) * ({y} - e.a.lat) / nullif(e.b.lat - e.a.lat, 0) + e.a.lon]) % 2 = 1"


@query(f"""WITH {POINTS_SQL}, poly AS (SELECT area_id, {_RING} edges FROM near_areas WHERE kind = 'polygon')
SELECT source, place_id, coalesce(min(area_id)::VARCHAR, 'outside') AS area FROM pt LEFT JOIN poly ON {_IN.format(x='lon', y='lat')} GROUP BY 1, 2""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """JN-15: the first polygon that holds the point"""
    from hexloom.operators.near import points_in_regions

    p = points(spark, d)
    hit = points_in_regions(p, table(spark, d, "near_areas").filter("kind = 'polygon'"), key="place_id").groupBy("place_id").agg(F.min("area_id").alias("area"))
    return p.select("source", "place_id").join(hit, "place_id", "left").select("source", "place_id", F.coalesce(F.col("area").cast("string"), F.lit("outside")).alias("area"))


@query(f"""WITH poly AS (SELECT area_id, {_RING} edges, [p.lon for p in ring] xs, [p.lat for p in ring] ys FROM near_areas WHERE kind = 'polygon'),
box AS (SELECT *, CAST(floor((list_min(xs) - 24.0) * 100000.0) AS BIGINT) x0, CAST(floor((list_max(xs) - 24.0) * 100000.0) AS BIGINT) x1, CAST(floor((list_min(ys) - 21.0) * 111320.0) AS BIGINT) y0, CAST(floor((list_max(ys) - 21.0) * 111320.0) AS BIGINT) y1 FROM poly),
rw AS (SELECT *, unnest(range(CAST(floor(y0 / 300.0) AS BIGINT), CAST(floor(y1 / 300.0) AS BIGINT) + 1)) r FROM box),
cl AS (SELECT *, unnest(range(CAST(floor(x0 / 350.0) AS BIGINT) - 1, CAST(floor(x1 / 350.0) AS BIGINT) + 2)) i FROM rw),
ct AS (SELECT area_id, edges, r, i - CAST(floor((r - (r % 2 + 2) % 2) / 2.0) AS BIGINT) q, 24.0 + (i * 350 - ((r % 2 + 2) % 2) * 175 + 175) / 100000.0 cx, 21.0 + (r * 300 + 150) / 111320.0 cy FROM cl)
SELECT DISTINCT area_id, q, r FROM ct WHERE {_IN.format(x='cx', y='cy')}""")
def polygon_to_cells(spark: SparkSession, d: str) -> DataFrame:
    """GEO-05"""
    return C.cells_of_ring(table(spark, d, "near_areas").filter("kind = 'polygon'"))


@query(f"""SELECT area_id, round(abs(list_sum([e.a.lon * e.b.lat - e.b.lon * e.a.lat for e in {_RING}])) / 2, 9) AS area_deg2 FROM near_areas WHERE kind = 'polygon'""")
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """GEO-06: the shoelace rule"""
    from hexloom.functions.geo import ring_area

    ring = F.transform("ring", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return table(spark, d, "near_areas").filter("kind = 'polygon'").select("area_id", F.round(ring_area(ring), 9).alias("area_deg2"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines as a raster: two tiles of values on a grid, one pixel for each place of it."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("tile"), F.pmod("l_partkey", F.lit(400)).alias("row"), F.pmod(F.col("l_suppkey") * 7 + F.col("l_linenumber"), F.lit(400)).alias("col")).agg(F.max("l_quantity").alias("value"))


_PIX = "px AS (SELECT l_returnflag tile, l_partkey % 400 AS \"row\", (l_suppkey * 7 + l_linenumber) % 400 AS col, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""WITH {_PIX} SELECT tile, CAST(floor("row" / 20.0) AS BIGINT) AS srow, CAST(floor(col / 20.0) AS BIGINT) AS scol, count(*) AS n, sum(value) AS total, count(*) FILTER (value > 0.5) AS present, round(avg(value) FILTER (value > 0.5), 6) AS mean_present FROM px GROUP BY 1, 2, 3""")
def superpixel_sum(spark: SparkSession, d: str) -> DataFrame:
    """AG-04, AG-05, AG-37"""
    return C.superpixels(_pixels(spark, d)).withColumn("mean_present", F.round("mean_present", 6))


@query(f"""WITH {_PIX} SELECT tile, CAST(floor("row" / 50.0) AS BIGINT) AS cell_row, round_even(coalesce(avg(nullif(value, 7)) / 10000, 0), 4) AS land_fraction, count(*) AS n_pixels, count(*) FILTER (value = 7) AS n_nodata FROM px GROUP BY 1, 2""")
def land_fraction(spark: SparkSession, d: str) -> DataFrame:
    """AG-06, FLT-18: sevens stand for no data"""
    p = _pixels(spark, d).withColumn("value", F.when(F.col("value") == 7, F.lit(65535.0)).otherwise(F.col("value")))
    return C.land_fraction(p.withColumn("cell_row", F.floor(F.col("row") / F.lit(50)).cast("bigint")), ["tile", "cell_row"])


@query(f"""WITH {_PIX}, w AS (SELECT * FROM px WHERE "row" >= 100 AND "row" < 200 AND col >= 50 AND col < 150 AND value <> 0) SELECT tile, "row", col, value, round((24.0 + (col + 0.5) * 0.001)::DOUBLE, 9) AS lon, round((29.0 + ("row" + 0.5) * -0.001)::DOUBLE, 9) AS lat FROM w""")
def raster_window(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09, SRC-10"""
    w = C.pixel_points(C.window(_pixels(spark, d), (100, 200), (50, 150)), a=0.001, c=24.0, e=-0.001, f=29.0)
    return w.withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)})


@query(f"""WITH {_PIX}, o AS (SELECT a.v i, b.v j FROM (SELECT unnest(range(-2, 3)) v) a, (SELECT unnest(range(-2, 3)) v) b WHERE abs(a.v) + abs(b.v) <= 2)
SELECT DISTINCT "row" + i AS "row", col + j AS col FROM px, o WHERE value >= 50""")
def dilate_mask(spark: SparkSession, d: str) -> DataFrame:
    """GEO-07"""
    return C.dilated(_pixels(spark, d).filter("value >= 50"), 2)


@query(f"""WITH {_PIX}, a AS (SELECT CAST(floor("row" / 20.0) AS BIGINT) c, sum(value) v FROM px WHERE tile = 'A' GROUP BY 1), b AS (SELECT CAST(floor(("row" + 7) / 20.0) AS BIGINT) c, sum(value) v FROM px WHERE tile = 'R' GROUP BY 1)
SELECT coalesce(a.c, b.c) AS cell, coalesce(a.v, 0) AS before, coalesce(b.v, 0) AS after, round(100 * (coalesce(b.v, 0) - coalesce(a.v, 0)) / nullif(coalesce(a.v, 0), 0), 4) AS growth_pct FROM a FULL JOIN b ON a.c = b.c""")
def epoch_growth_outer(spark: SparkSession, d: str) -> DataFrame:
    """JN-06"""
    p = _pixels(spark, d)
    side = lambda tile, shift, n: p.filter(F.col("tile") == tile).groupBy(F.floor((F.col("row") + shift) / F.lit(20)).cast("bigint").alias("cell")).agg(F.sum("value").alias(n))
    both = side("A", 0, "before").join(side("R", 7, "after"), "cell", "full_outer").fillna(0.0, ["before", "after"])
    return both.withColumn("growth_pct", F.round(M.growth(F.col("before"), F.col("after")), 4))


@query(f"WITH {PLACES_SQL} SELECT source, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM (SELECT source, count(*) n FROM vp GROUP BY 1)")
def source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """AG-07, AG-08"""
    n = valid_places(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))  # a row for each source


@query(f"WITH {HISTORY_SQL} SELECT metric, count(value) AS n, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS high, round(100.0 * count(*) FILTER (value < 100) / count(value), 4) AS pct_below FROM hist WHERE {PLAUSIBLE_SQL} GROUP BY 1")
def value_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """AG-09, AG-10"""
    h = history(spark, d).filter(plausible())
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = h.groupBy("metric").agg(F.count("value").alias("n"), F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high"), F.round(100.0 * F.count_if(F.col("value") < 100) / F.count("value"), 4).alias("pct_below"))
    return out.select("metric", "n", "low", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "high", "pct_below")


@query("SELECT source, count(*) AS n, count(*) FILTER (name IS NULL) AS null_name, count(*) FILTER (trim(name) = '') AS blank_name, count(*) FILTER (category IS NULL) AS null_category, count(*) FILTER (lat IS NULL OR lon IS NULL) AS no_place, count(*) FILTER (groups = '') AS no_group FROM places GROUP BY 1")
def null_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """FLT-19, FLT-20"""
    p = table(spark, d, "places")
    return p.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("name").isNull()).alias("null_name"), F.count_if(F.trim("name") == "").alias("blank_name"),
        F.count_if(F.col("category").isNull()).alias("null_category"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_place"), F.count_if(F.col("groups") == "").alias("no_group"),
    )


@query("SELECT source, regexp_replace(snapshot, '\\d', '9', 'g') AS shape, count(*) AS n, count(*) FILTER (try_cast(substr(snapshot, 1, 10) AS DATE) IS NULL) AS unreadable FROM places GROUP BY 1, 2")
def date_shapes(spark: SparkSession, d: str) -> DataFrame:
    """AG-34"""
    p = table(spark, d, "places").groupBy("source", "snapshot").agg(F.count("*").alias("n"))
    bad = F.when(F.try_to_timestamp(F.substring("snapshot", 1, 10), F.lit("yyyy-MM-dd")).isNull(), F.col("n")).otherwise(0)
    return p.groupBy("source", date_shape(F.col("snapshot")).alias("shape")).agg(F.sum("n").alias("n"), F.sum(bad).alias("unreadable"))


@query(f"""WITH {PLACES_SQL} SELECT g.name AS group_name, count(*) FILTER (contains(lower(category), g.name)) AS naive, count(*) FILTER (list_contains({cat.SQL_GROUPS}, g.name)) AS mapped,
round(100.0 * (count(*) FILTER (contains(lower(category), g.name)) - count(*) FILTER (list_contains({cat.SQL_GROUPS}, g.name))) / nullif(count(*) FILTER (list_contains({cat.SQL_GROUPS}, g.name)), 0), 4) AS error_pct
FROM vp, (SELECT unnest({list(cat.GROUPS)}) AS name) g GROUP BY 1""")
def category_mapping_error(spark: SparkSession, d: str) -> DataFrame:
    """Q-16, FLT-02 to FLT-04"""
    p = valid_places(spark, d).select(F.lower("category").alias("c"), cat.groups_of(F.col("source"), F.col("category")).alias("g"))
    out = p.agg(*[x for g in cat.GROUPS for x in (F.count_if(F.col("c").contains(g)).alias(f"n_{g}"), F.count_if(F.array_contains("g", g)).alias(f"m_{g}"))])
    rows = out.select(F.explode(F.array(*[F.struct(F.lit(g).alias("group_name"), F.col(f"n_{g}").alias("naive"), F.col(f"m_{g}").alias("mapped")) for g in cat.GROUPS])).alias("x")).select("x.*")
    return rows.withColumn("error_pct", F.round(F.try_divide(100.0 * (F.col("naive") - F.col("mapped")), F.col("mapped")), 4))


@query(f"""WITH {POINTS_SQL}, m AS ({M.sql_business_counts('q, r', 'pt')}) SELECT t.t::DOUBLE AS tolerance, m.metric, count(*) FILTER (n_sources = 2) AS both, count(*) FILTER (n_sources = 2 AND agreement_ratio >= t.t) AS agreeing
FROM m, (SELECT unnest([0.3, 0.5, 0.6, 0.667, 0.8, 0.9]) t) t GROUP BY 1, 2""")
def tolerance_sweep(spark: SparkSession, d: str) -> DataFrame:
    """AG-24, Q-18: one pass, a column for each tolerance"""
    steps = (0.3, 0.5, 0.6, 0.667, 0.8, 0.9)
    m = M.business_counts(points(spark, d), ["q", "r"]).filter("n_sources = 2 or n_sources < 2")
    two = F.col("n_sources") == 2
    out = m.groupBy("metric").agg(F.count_if(two).alias("both"), *[F.count_if(two & (F.col("agreement_ratio") >= t)).alias(f"t{i}") for i, t in enumerate(steps)])
    return out.select("metric", "both", F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(f"t{i}").alias("agreeing")) for i, t in enumerate(steps)])).alias("x")).select("x.tolerance", "metric", "both", "x.agreeing")


@query(f"""WITH {HISTORY_SQL}, g AS (SELECT h3_index, metric, CASE WHEN count(*) >= 2 THEN 100 * (arg_max(value, snapshot_id) - arg_min(value, snapshot_id)) / nullif(arg_min(value, snapshot_id), 0) END pct FROM hist WHERE {PLAUSIBLE_SQL} GROUP BY ALL),
dr AS (SELECT h3_index, metric, CASE WHEN pct > 10 THEN 'up' WHEN pct < -10 THEN 'down' WHEN pct IS NOT NULL THEN 'flat' END dir FROM g)
SELECT h3_index, count(dir) AS signals, array_to_string(list_sort(list(DISTINCT dir) FILTER (dir IS NOT NULL)), ',') AS directions, CASE WHEN count(dir) = 0 THEN 'NO DATA' WHEN count(dir) = 1 THEN 'SINGLE' WHEN count(DISTINCT dir) = 1 THEN 'AGREE' ELSE 'DIVERGE' END AS verdict FROM dr GROUP BY 1""")
def corroboration_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Q-17: PRJ-08, AG-25"""
    h = history(spark, d).filter(plausible()).groupBy("h3_index", "metric").agg(F.count("*").alias("n"), F.min_by("value", "snapshot_id").alias("f"), F.max_by("value", "snapshot_id").alias("l"))
    h = h.withColumn("dir", direction(F.when(F.col("n") >= 2, 100 * F.try_divide(F.col("l") - F.col("f"), F.col("f")))))
    kinds = F.array_sort(F.collect_set("dir"))
    verdict = F.when(F.count("dir") == 0, "NO DATA").when(F.count("dir") == 1, "SINGLE").when(F.size(kinds) == 1, "AGREE").otherwise("DIVERGE")
    return h.groupBy("h3_index").agg(F.count("dir").alias("signals"), F.when(F.size(kinds) > 0, F.array_join(kinds, ",")).alias("directions"), verdict.alias("verdict"))


@query(f"""WITH s AS (SELECT DISTINCT pair_id, coalesce(governorate, '') governorate, band FROM dup_triage_sample), k AS (SELECT *, {SA.sql_draw('pair_id', 1)} d, row_number() OVER (PARTITION BY governorate, band ORDER BY {SA.sql_draw('pair_id', 1)}, pair_id) k FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY d, pair_id) o FROM k WHERE k > 3) SELECT pair_id, governorate, band FROM k WHERE k <= 3 UNION ALL SELECT pair_id, governorate, band FROM r WHERE o + (SELECT count(*) FROM k WHERE k <= 3) <= 400""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """SR-09: three of each stratum, topped up to four hundred; the sample is the feature"""
    s = table(spark, d, "dup_triage_sample").select("pair_id", F.coalesce("governorate", F.lit("")).alias("governorate"), "band").dropDuplicates()
    return SA.stratified(s, ["governorate", "band"], "pair_id", floor=3, total=400)


@query(f"""WITH s AS (SELECT DISTINCT pair_id, coalesce(governorate, '') governorate FROM dup_triage_sample), n AS (SELECT governorate, greatest(5, CAST(floor(count(*) * 300 / (SELECT count(*) FROM s)) AS BIGINT)) take FROM s GROUP BY 1)
SELECT pair_id, governorate FROM (SELECT *, row_number() OVER (PARTITION BY governorate ORDER BY {SA.sql_draw('pair_id', 1)}, pair_id) k FROM s JOIN n USING (governorate)) WHERE k <= take""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    """SR-10 by region only; the sample is the feature"""
    s = table(spark, d, "dup_triage_sample").select("pair_id", F.coalesce("governorate", F.lit("")).alias("governorate")).dropDuplicates()
    return SA.proportional(s, "governorate", "pair_id", total=300, floor=5)


@query(f"""WITH s AS (SELECT DISTINCT pair_id, coalesce(governorate, '') governorate, coalesce(band, '') band FROM dup_triage_sample), nb AS (SELECT governorate, band, count(*) nb FROM s GROUP BY 1, 2),
n AS (SELECT governorate, sum(nb) n, least(sum(nb), greatest(5, round_even(sum(nb) * 300.0 / (SELECT count(*) FROM s), 0))) take FROM nb GROUP BY 1), q AS (SELECT governorate, band, take, greatest(1, round_even(take * nb / n, 0)) k FROM nb JOIN n USING (governorate)),
r AS (SELECT s.*, take, k, {SA.sql_draw('pair_id', 1)} d, row_number() OVER (PARTITION BY governorate, band ORDER BY {SA.sql_draw('pair_id', 1)}, pair_id) i FROM s JOIN q USING (governorate, band))
SELECT pair_id, governorate, band FROM (SELECT *, row_number() OVER (PARTITION BY governorate ORDER BY band, d, pair_id) o FROM r WHERE i <= k) WHERE o <= take""")
def banded_sample(spark: SparkSession, d: str) -> DataFrame:
    """SR-10: by region, then by band; the sample is the feature"""
    s = table(spark, d, "dup_triage_sample").select("pair_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("governorate", "band")]).dropDuplicates()
    return SA.banded(s, "governorate", "band", "pair_id", total=300, floor=5)


@query("""SELECT CASE WHEN name_sim >= 0 AND name_sim < 0.5 THEN 'low' WHEN name_sim >= 0.5 AND name_sim < 0.72 THEN 'middle' WHEN name_sim >= 0.72 AND name_sim < 1.01 THEN 'high' END AS bin, CASE WHEN distance_m > 0 AND distance_m <= 100 THEN 'near' WHEN distance_m > 100 AND distance_m <= 1000 THEN 'far' END AS reach, count(DISTINCT pair_id) AS pairs FROM dup_triage_sample GROUP BY 1, 2""")
def binned_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SR-11: half-open on either side"""
    s = table(spark, d, "dup_triage_sample").select("pair_id", SA.binned(F.col("name_sim"), (0, 0.5, 0.72, 1.01), ("low", "middle", "high")).alias("bin"), SA.binned(F.col("distance_m"), (0, 100, 1000), ("near", "far"), right=True).alias("reach"))
    return s.dropDuplicates().groupBy("bin", "reach").agg(F.count("*").alias("pairs"))


@query(f"""WITH {POINTS_SQL}, st AS (SELECT unnest(range(0, 4000, 50)) s), n AS (SELECT s, count(x) n FROM st LEFT JOIN (SELECT x - 99000 AS x FROM pt WHERE y BETWEEN 389000 AND 391500) p ON p.x >= s AND p.x < s + 400 GROUP BY 1)
SELECT s AS start_m, n, row_number() OVER (ORDER BY n DESC, s) = 1 AS best FROM n""")
def street_window(spark: SparkSession, d: str) -> DataFrame:
    """WN-14: a window of 400 m slid by 50 m; each place names the starts that hold it"""
    p = points(spark, d).filter(F.col("y").between(389000, 391500)).select((F.col("x") - 99000).alias("x"))
    first = F.floor((F.col("x") - 400) / F.lit(50)).cast("bigint") + 1
    held = p.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (first + k) * 50)).alias("start_m")).groupBy("start_m").agg(F.count("*").alias("n"))
    starts = spark.range(0, 4000, 50).withColumnRenamed("id", "start_m").join(held, "start_m", "left").fillna(0, ["n"])
    return starts.withColumn("best", F.row_number().over(Window.orderBy(F.desc("n"), "start_m")) == 1)  # a row for each start


@query(f"""WITH {POINTS_SQL}, s(k, ax, ay, bx, by2) AS (VALUES (1, 99000.0, 389000.0, 101000.0, 391000.0), (2, 299000.0, 389500.0, 301000.0, 390500.0)),
g AS (SELECT place_id, k, x, y, ax, ay, bx - ax dx, by2 - ay dy FROM pt, s), t AS (SELECT *, least(greatest(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) t FROM g)
SELECT k AS street, count(*) AS places FROM t WHERE sqrt(pow(x - (ax + t * dx), 2) + pow(y - (ay + t * dy), 2)) <= 60.5 GROUP BY 1""")
def street_buffer(spark: SparkSession, d: str) -> DataFrame:
    """JN-16: places within 60.5 m of a line"""
    streets = [(1, 99000.0, 389000.0, 101000.0, 391000.0), (2, 299000.0, 389500.0, 301000.0, 390500.0)]
    p = points(spark, d)
    near = F.array_compact(F.array(*[F.when(segment_m(F.col("x"), F.col("y"), *(F.lit(v) for v in s[1:])) <= 60.5, F.lit(s[0])) for s in streets]))
    return p.select(F.explode(near).alias("street")).groupBy("street").agg(F.count("*").alias("places"))


@query(f"WITH {PLACES_SQL} SELECT category, count(*) AS n FROM vp WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 30")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    """SR-01: thirty, the list is the feature"""
    return valid_places(spark, d).dropna(subset=["category"]).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(30)


@query("SELECT DISTINCT snapshot_id FROM h3_metric_history WHERE snapshot_id NOT IN (SELECT snapshot FROM places WHERE source = 'overture')")
def release_gap(spark: SparkSession, d: str) -> DataFrame:
    """ST-03, SRC-20, JN-05: releases of one table that the other lacks"""
    mine = table(spark, d, "places").filter("source = 'overture'").select(F.col("snapshot").alias("snapshot_id")).dropDuplicates()
    return table(spark, d, "h3_metric_history").select("snapshot_id").dropDuplicates().join(mine, "snapshot_id", "left_anti")


@query(f"""WITH {HISTORY_SQL}, f AS (SELECT h3_index, metric, arg_max(value, snapshot_id) AS value FROM hist WHERE {PLAUSIBLE_SQL} GROUP BY ALL)
SELECT h3_index, metric, value FROM f WHERE metric <> 'population' UNION ALL SELECT h3_index, 'population', round(value * 1.5, 6) FROM f WHERE metric = 'population'""")
def metric_replace(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04, ST-02, ST-08: one metric's rows replaced, the rest untouched"""
    f = history(spark, d).filter(plausible()).groupBy("h3_index", "metric").agg(F.max_by("value", "snapshot_id").alias("value"))
    return M.without_metric(f, "population", f.filter("metric = 'population'").withColumn("value", F.round(F.col("value") * 1.5, 6)))


@query("SELECT source, snapshot, count(*) AS n FROM places p WHERE snapshot = (SELECT max(snapshot) FROM places q WHERE q.source = p.source) GROUP BY 1, 2")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, SRC-07"""
    n = table(spark, d, "places").groupBy("source", "snapshot").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.max(F.struct("snapshot", "n")).alias("m")).select("source", "m.*")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props) AND len(json_keys(props)) > 0) AS filled, count(DISTINCT json_extract_string(props, '$.k')) AS k_values FROM events GROUP BY 1")
def json_map_decode(spark: SparkSession, d: str) -> DataFrame:
    """SCL-17"""
    e = table(spark, d, "events").select("event_type", text_map(F.col("props")).alias("m"))
    k = e.groupBy("event_type", F.try_element_at("m", F.lit("k")).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.size("m") > 0).alias("filled"))
    return k.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.count("k").alias("k_values"))


@query("SELECT h3_res, count(*) AS cells, count(DISTINCT pipeline_version) AS versions, count(DISTINCT pipeline_version) = 1 AS one_version FROM h3_cell GROUP BY 1")
def loader_census(spark: SparkSession, d: str) -> DataFrame:
    """AG-42, SRC-16"""
    c = table(spark, d, "h3_cell").groupBy("h3_res", "pipeline_version").agg(F.count("*").alias("n"))
    return c.groupBy("h3_res").agg(F.sum("n").alias("cells"), F.count("pipeline_version").alias("versions"), (F.count("pipeline_version") == 1).alias("one_version"))


@query(f"""WITH {PLACES_SQL}, c AS (SELECT h3_res8, category, count(*) n FROM vp WHERE h3_res8 IS NOT NULL GROUP BY ALL), t AS (SELECT h3_res8, sum(n) total, max(n) FILTER (category IS NOT NULL) top_n, arg_max(category, (n, category)) FILTER (category IS NOT NULL) top FROM c GROUP BY 1),
s AS (SELECT h3_res8, count(*) FILTER (source = 'overture') o, count(*) FILTER (source = 'fsq') f FROM vp WHERE h3_res8 IS NOT NULL GROUP BY 1)
SELECT h3_res8, total::BIGINT AS total, top, round(100.0 * top_n / total, 4) AS top_pct, round(o::DOUBLE / nullif(f, 0), 6) AS source_ratio FROM t JOIN s USING (h3_res8)""")
def district_profile(spark: SparkSession, d: str) -> DataFrame:
    """AG-38, JN-23"""
    c = valid_places(spark, d).dropna(subset=["h3_res8"]).groupBy("h3_res8", "category").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "overture").alias("o"), F.count_if(F.col("source") == "fsq").alias("f"))
    known = F.col("category").isNotNull()
    t = c.groupBy("h3_res8").agg(F.sum("n").alias("total"), F.max(F.when(known, F.col("n"))).alias("top_n"), F.max_by("category", F.when(known, F.struct("n", "category"))).alias("top"), F.sum("o").alias("o"), F.sum("f").alias("f"))
    return t.select("h3_res8", "total", "top", F.round(100.0 * F.col("top_n") / F.col("total"), 4).alias("top_pct"), F.round(F.try_divide(F.col("o").cast("double"), F.col("f")), 6).alias("source_ratio"))


@query(f"""WITH {POINTS_SQL} SELECT source, count(*) AS inside FROM pt WHERE lon BETWEEN 24.9 AND 27.1 AND lat BETWEEN 24.0 AND 26.6 GROUP BY 1""")
def box_clip(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01"""
    from hexloom.functions.geo import in_box

    return points(spark, d).filter(in_box(F.col("lat"), F.col("lon"), 24.9, 24.0, 27.1, 26.6)).groupBy("source").agg(F.count("*").alias("inside"))


@query("""WITH t AS (SELECT area_id, coalesce(lon - radius_m / 100000, list_min([p.lon for p in ring])) x0, coalesce(lat - radius_m / 111320, list_min([p.lat for p in ring])) y0, coalesce(lon + radius_m / 100000, list_max([p.lon for p in ring])) x1, coalesce(lat + radius_m / 111320, list_max([p.lat for p in ring])) y1 FROM near_areas)
SELECT a.area_id, count(*) AS meets FROM t a JOIN t b ON a.area_id <> b.area_id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 GROUP BY 1""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """JN-22, SRC-12: areas whose boxes meet; the table of areas is fixed"""
    from hexloom.functions.geo import boxes_meet

    xs, ys = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    t = table(spark, d, "near_areas").select(
        "area_id", F.coalesce(F.col("lon") - F.col("radius_m") / 100000, F.array_min(xs)).alias("x0"), F.coalesce(F.col("lat") - F.col("radius_m") / 111320, F.array_min(ys)).alias("y0"),
        F.coalesce(F.col("lon") + F.col("radius_m") / 100000, F.array_max(xs)).alias("x1"), F.coalesce(F.col("lat") + F.col("radius_m") / 111320, F.array_max(ys)).alias("y1"),
    )
    # By squares of a tenth of a degree: boxes that meet share one.
    span = lambda a, b: F.sequence(F.floor(F.col(a) * 10).cast("bigint"), F.floor(F.col(b) * 10).cast("bigint"))
    sq = t.withColumn("sx", F.explode(span("x0", "x1"))).withColumn("sy", F.explode(span("y0", "y1")))
    a, b = sq.alias("a"), sq.alias("b")
    box = lambda p: tuple(F.col(f"{p}.{c}") for c in ("x0", "y0", "x1", "y1"))
    met = a.join(b, (F.col("a.sx") == F.col("b.sx")) & (F.col("a.sy") == F.col("b.sy")) & (F.col("a.area_id") != F.col("b.area_id")) & boxes_meet(box("a"), box("b")))
    return met.select(F.col("a.area_id").alias("area_id"), F.col("b.area_id").alias("other")).dropDuplicates().groupBy("area_id").agg(F.count("*").alias("meets"))


@query(f"""WITH {POINTS_SQL} SELECT source, place_id, round(2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(lat - 24.5) / 2), 2) + cos(radians(24.5)) * cos(radians(lat)) * pow(sin(radians(lon - 25.0) / 2), 2)))), 2) AS great_circle_m,
round(sqrt(pow((lat - 24.5) * 111320.0, 2) + pow((lon - 25.0) * 111320.0 * 0.868, 2)), 2) AS flat_m, round(sqrt(pow((lat - 24.5) * 111320.0, 2) + pow((lon - 25.0) * 111320.0 * cos(radians(24.5)), 2)), 2) AS local_m FROM pt""")
def distances(spark: SparkSession, d: str) -> DataFrame:
    """SCL-18, SCL-19: three formulas, kept apart"""
    from hexloom.functions.geo import flat_m, local_m

    at = (F.lit(24.5), F.lit(25.0), F.col("lat"), F.col("lon"))
    return points(spark, d).select("source", "place_id", F.round(haversine_m(*at), 2).alias("great_circle_m"), F.round(flat_m(*at), 2).alias("flat_m"), F.round(local_m(*at), 2).alias("local_m"))


@query(f"WITH {POINTS_SQL} SELECT q, r, pq, pr, count(*) AS places FROM pt GROUP BY ALL")
def lattice_cells(spark: SparkSession, d: str) -> DataFrame:
    """GEO-01, GEO-02"""
    return points(spark, d).groupBy("q", "r", "pq", "pr").agg(F.count("*").alias("places"))


