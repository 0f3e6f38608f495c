"""Cell facts and catchment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import confidence as conf
from hexloom.functions import grid
from hexloom.operators import metrics as M
from hexloom.operators.report import catchment, catchment_context, ring
from hexloom.operators.serving import in_ring
from hexloom.plans import built_queries as built
from hexloom.plans.base import CELLS_SQL, POINTS_SQL, POP_SQL, cells, points, populations, query
from hexloom.runtime import table

ORIGIN, K = built.ORIGIN, built.K

_COUNTS = f"{CELLS_SQL},\nm AS ({M.sql_business_counts('q, r', 'pt')})"


@query(f"WITH {POINTS_SQL} {M.sql_business_counts('q, r', 'pt')}")
def cell_business_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG-01, AG-02, SCL-24, PRJ-05"""
    return M.business_counts(points(spark, d), ["q", "r"])


@query(f"WITH {POINTS_SQL} {M.sql_business_counts('h3_res9', '(SELECT * FROM pt WHERE h3_res9 IS NOT NULL)')}")
def area_business_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same by the delivered cell ids."""
    return M.business_counts(points(spark, d), ["h3_res9"])


@query(f"""WITH {_COUNTS} SELECT q, r, metric, value, CASE WHEN land_area_m2 > 0 AND land_fraction >= 0.05 THEN round(value / (land_area_m2 / 1e6), 4) END per_land_km2,
CASE WHEN NOT (land_area_m2 > 0 AND land_fraction >= 0.05) THEN 'too little land' END withheld FROM m JOIN cell USING (q, r) WHERE value >= 0.5""")
def metric_density_floor(spark: SparkSession, d: str) -> DataFrame:
    """AG-36, FLT-16"""
    pts = points(spark, d)
    m = M.business_counts(pts, ["q", "r"]).filter(F.col("value") >= 0.5).join(cells(spark, d, pts), ["q", "r"])
    land = (F.col("land_area_m2"), F.col("land_fraction"))
    return m.select("q", "r", "metric", "value", F.round(M.per_land_km2(F.col("value"), *land), 4).alias("per_land_km2"), M.withheld(*land).alias("withheld"))


@query(f"""WITH {POP_SQL}, kin AS (SELECT DISTINCT h3_res9, h3_res8 FROM places WHERE h3_res9 IS NOT NULL AND h3_res8 IS NOT NULL),
kid AS (SELECT h3_res9, h3_res8, land_area_m2, sum(land_area_m2) OVER (PARTITION BY h3_res8) s, count(*) OVER (PARTITION BY h3_res8) n FROM kin JOIN h3_cell ON h3_index = h3_res9)
SELECT h3_res9, h3_res8, round(population * CASE WHEN s > 0 THEN land_area_m2 / s ELSE 1.0 / n END, 4) population, 8 AS native_res FROM kid JOIN pop ON pop.h3_index = h3_res8""")
def population_apportion(spark: SparkSession, d: str) -> DataFrame:
    """JN-03, WN-01: parents' populations dealt to children by land"""
    kin = table(spark, d, "places").select("h3_res9", "h3_res8").dropna().dropDuplicates()
    kids = kin.join(table(spark, d, "h3_cell").select(F.col("h3_index").alias("h3_res9"), "land_area_m2"), "h3_res9")
    parents = populations(spark, d).select(F.col("h3_index").alias("h3_res8"), "population")
    got = M.apportioned(kids, parents, parent="h3_res8", weight="land_area_m2", value="population")
    return got.select("h3_res9", "h3_res8", F.round("population", 4).alias("population"), F.lit(8).alias("native_res"))


@query(f"""SELECT h3_index, builtup_pct, builtup_pct * coverage_ratio presence_pct, least(builtup_pct, builtup_pct * coverage_ratio) / nullif(greatest(builtup_pct, builtup_pct * coverage_ratio), 0) agreement_ratio,
{conf.sql_of_counts('builtup_pct', '(builtup_pct * coverage_ratio)')} confidence FROM h3_cell""")
def builtup_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """SCL-24"""
    c = table(spark, d, "h3_cell").select("h3_index", "builtup_pct", (F.col("builtup_pct") * F.col("coverage_ratio")).alias("p"))
    a, b = F.col("builtup_pct"), F.col("p")
    both = F.when(b.isNotNull(), conf.agreement(a, b)).otherwise(conf.agreement(a, a))
    return c.select("h3_index", "builtup_pct", b.alias("presence_pct"), both.alias("agreement_ratio"), conf.of_counts(a, b).alias("confidence"))


@query(f"WITH {_COUNTS} SELECT pq, pr, metric, sum(value) AS value, count(*) AS cells, {conf.sql_label('min(' + conf.sql_rank('confidence') + ')')} AS confidence FROM m JOIN cell USING (q, r) GROUP BY ALL")
def parent_rollup(spark: SparkSession, d: str) -> DataFrame:
    """GEO-02, AG-03, AG-12"""
    pts = points(spark, d)
    m = M.business_counts(pts, ["q", "r"]).join(cells(spark, d, pts).select("q", "r", "pq", "pr"), ["q", "r"])
    return m.groupBy("pq", "pr", "metric").agg(F.sum("value").alias("value"), F.count("*").alias("cells"), conf.weakest(F.col("confidence")).alias("confidence"))


@query(f"""WITH {_COUNTS}, {built.SQL_VINTAGES} SELECT q, r, 'people_per_competitor.' || metric AS metric, round(population / value, 2) AS value, {conf.sql_label('least(' + conf.sql_rank('confidence') + ', ' + conf.sql_rank('pop_confidence') + ')')} confidence,
least(CASE WHEN overture > 0 AND fsq > 0 THEN least(od, fd) WHEN overture > 0 THEN od ELSE fd END, pop_as_of) AS as_of, least(pop_res, 9) AS native_res
FROM m JOIN cell USING (q, r), dates WHERE metric <> 'total' AND population IS NOT NULL AND value > 0""")
def people_per_competitor(spark: SparkSession, d: str) -> DataFrame:
    """Q-02 for every cell: the weaker confidence, the older date and the coarser resolution of both; no ratio without competitors"""
    m = built.served_metrics(spark, d).select("q", "r", "metric", "value", "confidence", "as_of", "native_res")
    c = m.filter(F.col("metric").startswith("business_count.") & (F.col("metric") != "business_count.total") & (F.col("value") > 0))
    p = m.filter("metric = 'population'").select("q", "r", *[F.col(x).alias(f"p_{x}") for x in ("value", "confidence", "as_of", "native_res")])
    name = F.concat(F.lit("people_per_competitor."), F.substring_index("metric", ".", -1))
    return c.join(p, ["q", "r"]).select("q", "r", name.alias("metric"), F.round(F.col("p_value") / F.col("value"), 2).alias("value"), conf.weaker(F.col("confidence"), F.col("p_confidence")).alias("confidence"), conf.older(F.col("as_of"), F.col("p_as_of")).alias("as_of"), conf.coarser(F.col("native_res"), F.col("p_native_res")).alias("native_res"))


_RING = f"""{_COUNTS},
o AS (SELECT q oq, r orr FROM ({grid.sql_located(f'(SELECT {ORIGIN[0]} lat, {ORIGIN[1]} lon)')})),
ring AS (SELECT oq + da q, orr + db r FROM o, ({grid.sql_disk(K)}))"""


def _catchment(spark: SparkSession, d: str) -> DataFrame:
    own = ring(spark, *ORIGIN, K)
    return catchment(own, in_ring(built.served_cells(spark, d), [tuple(r) for r in own.collect()]))


@query(f"WITH {_RING} SELECT ring.q, ring.r, cell.land_fraction IS NOT NULL in_coverage, land_fraction, governorate FROM ring LEFT JOIN cell USING (q, r)")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    """JN-18, FLT-13, GEO-03"""
    return _catchment(spark, d).select("q", "r", F.col("land_fraction").isNotNull().alias("in_coverage"), "land_fraction", "governorate")


@query(f"""WITH {_RING} SELECT count(*) AS cells, round(sum(land_area_m2), 2) AS land_m2, count(*) * {grid.CELL_M2} AS raw_m2, round(avg(land_fraction), 6) AS mean_land_fraction, round(avg(builtup_pct), 6) AS mean_builtup_pct,
round(avg(growth_pct), 6) AS mean_growth_pct, round(avg(nullif(coverage_ratio, 0)), 6) AS mean_coverage_ratio, bool_or(density_distorted) AS distorted, round(sum(population), 4) AS population,
count(*) FILTER (builtup_pct >= 40) AS saturated, count(*) FILTER (builtup_pct < 10) AS open, count(*) FILTER (builtup_pct >= 10 AND builtup_pct < 40) AS developing FROM ring JOIN cell USING (q, r)""")
def report_context(spark: SparkSession, d: str) -> DataFrame:
    """AG-16, AG-18"""
    return catchment_context(_catchment(spark, d))


@query("SELECT r.radius::DOUBLE AS radius_m, arg_min(k, abs((3 * k * k + 3 * k + 1) * 105000.0 - pi() * radius * radius)) AS k FROM (SELECT unnest([0.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0]) radius) r, (SELECT unnest(range(0, 61)) k) GROUP BY 1")
def k_for_radius(spark: SparkSession, d: str) -> DataFrame:
    """SCL-26"""
    from hexloom.functions.geo import steps_for_radius

    radii = spark.createDataFrame([(r,) for r in (0.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)], "radius_m double")
    return radii.select("radius_m", steps_for_radius(F.col("radius_m"), float(grid.CELL_M2)).cast("bigint").alias("k"))


@query(f"""WITH {_COUNTS} SELECT q, r, ceil(round(population * 0.6, 6))::BIGINT pop_min, ceil(round(population * 1.4, 6))::BIGINT pop_max, greatest(builtup_pct - 15, 0) builtup_min, least(builtup_pct + 15, 100) builtup_max FROM cell WHERE population IS NOT NULL AND builtup_pct IS NOT NULL""")
def like_this_bands(spark: SparkSession, d: str) -> DataFrame:
    """SCL-29"""
    c = cells(spark, d).filter(F.col("population").isNotNull() & F.col("builtup_pct").isNotNull())
    edge = lambda f: F.ceil(F.round(F.col("population") * f, 6)).cast("bigint")
    return c.select("q", "r", edge(0.6).alias("pop_min"), edge(1.4).alias("pop_max"), F.greatest(F.col("builtup_pct") - 15, F.lit(0.0)).alias("builtup_min"), F.least(F.col("builtup_pct") + 15, F.lit(100.0)).alias("builtup_max"))


@query(f"""WITH {_COUNTS} SELECT metric, confidence, n, round(100.0 * n / sum(n) OVER (PARTITION BY metric), 4) AS pct FROM (SELECT metric, confidence, count(*) n FROM m GROUP BY ALL)""")
def track_confidence(spark: SparkSession, d: str) -> DataFrame:
    """AG-07, AG-20"""
    from pyspark.sql import Window

    n = M.business_counts(points(spark, d), ["q", "r"]).groupBy("metric", "confidence").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("metric")), 4))

