"""Catchment reports: a ring of cells around a point joined to cell facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions import confidence as conf
from hexloom.functions import grid


def ring(spark: SparkSession, lat: float, lon: float, k: int) -> DataFrame:
    """(q, r) of the 3k^2 + 3k + 1 cells within k steps of a point. k is at most the configured one."""
    if not 0 <= k <= T.max_k:
        raise ValueError(f"k must be 0 to {T.max_k}")
    if not (abs(lat) <= 90 and abs(lon) <= 180):
        raise ValueError("no such place")
    at = grid.located(spark.createDataFrame([(lat, lon)], "lat double, lon double")).select("q", "r")
    return grid.with_disk(at, k).select(F.col("dq").alias("q"), F.col("dr").alias("r"))


def catchment(ring_: DataFrame, cells: DataFrame) -> DataFrame:
    """All ring cells with their attributes; null attributes are outside coverage. The ring has at most 469 rows: it is broadcast."""
    return cells.join(F.broadcast(ring_.withColumn("_in", F.lit(1))), ["q", "r"], "right")


def inside(catchment_: DataFrame) -> DataFrame:
    return catchment_.filter(F.col("land_fraction").isNotNull())


def ring_cells(spark: SparkSession, lat: float, lon: float, k: int) -> list[tuple[int, int]]:
    """The ring's cells, at most 469."""
    return sorted(tuple(r) for r in ring(spark, lat, lon, k).collect())


#: Where a figure comes from, in the order of the text.
SOURCES = ("builtup", "fsq", "overture", "population")


def direction_of_good(metric: Column) -> Column:
    """Whether more of it is good for someone who looks for a place to open."""
    return F.when(metric.startswith("business_count."), "lower").when((metric == "population") | metric.startswith("people_per_competitor."), "higher").otherwise("context")


def full_report(cells: DataFrame, metrics: DataFrame, category: str | None = None) -> DataFrame:
    """One row for each metric that any cell of a catchment has, with all that says how far to trust it.

    cells, metrics: rows of the built tables in the ring. Every cell inside coverage
    counts: one without a row of the metric has no data, or, where it has businesses,
    none of that kind. Confidence is the weakest link, as_of the oldest, agreement the
    upper median where there are two sources, native_res the coarsest. Figures by area
    divide by the catchment's land, where there is enough of it. With a category only
    its count stays, and people_per_competitor is derived: the weaker confidence, the
    older date, the coarser resolution of both; without competitors it is left out.
    """
    if category:
        metrics = metrics.filter((F.col("track") != "business") | (F.col("metric") == f"business_count.{category}"))
    whole = cells.agg(F.count("*").alias("n"), F.sum("land_area_m2").alias("land"), F.avg("land_fraction").alias("share"))  # one row
    business = metrics.filter("track = 'business'").agg(F.count_distinct("q", "r").alias("with_business"))
    snaps = F.from_json("source_snapshots", "map<string,string>")
    stale = metrics.join(cells.select("q", "r", "population_stale"), ["q", "r"])
    ratios = F.sort_array(F.collect_list("agreement_ratio"))
    level = lambda name: F.count_if(F.col("confidence") == name).alias(f"cells_{name}")
    g = stale.groupBy("metric", "track").agg(
        F.sum("value").alias("value"), conf.weakest(F.col("confidence")).alias("confidence"), F.min("as_of").alias("as_of"), F.sum("overture").alias("overture"), F.sum("fsq").alias("fsq"),
        F.struct(*[F.max(snaps[s]).alias(s) for s in SOURCES]).alias("_s"), F.try_element_at(ratios, (F.floor(F.size(ratios) / 2) + 1).cast("int")).alias("_a"), F.min("native_res").alias("native_res"),
        F.bool_or((F.col("track") == "population") & F.col("population_stale")).alias("stale"), F.count("*").alias("_rows"), *map(level, reversed(conf.LEVELS)),
    ).join(F.broadcast(whole)).join(F.broadcast(business))
    enough = (F.col("share") >= T.land_fraction_floor) & (F.col("land") > 0)
    own = F.col("track") == "business"
    out = g.select(
        "metric", "track", "value", F.when(enough, F.round(F.col("value") / (F.col("land") / 1e6), 2)).alias("per_land_km2"), F.when(~enough, "too little land").alias("withheld"), "confidence",
        F.array_join(F.array_compact(F.array(*[F.when(F.col("_s")[s].isNotNull(), F.lit(s)) for s in SOURCES])), ",").alias("sources"), "as_of", F.to_json("_s").alias("source_snapshots"), "overture", "fsq",
        F.when(F.size(F.array_compact(F.array(*[F.col("_s")[s] for s in SOURCES]))) > 1, F.col("_a")).alias("agreement_ratio"), F.col("n").alias("cells_total"),
        F.when(own, F.col("n") - F.col("with_business")).otherwise(F.col("n") - F.col("_rows")).alias("cells_no_data"), F.when(own, F.col("with_business") - F.col("_rows")).otherwise(0).cast("bigint").alias("cells_none_present"),
        *[f"cells_{c}" for c in reversed(conf.LEVELS)], "stale", "native_res", direction_of_good(F.col("metric")).alias("direction_of_good"),
    )
    return out.unionByName(people_per_competitor(out, category)) if category else out


def people_per_competitor(report: DataFrame, category: str) -> DataFrame:
    """The ratio of two rows of a report, with what it inherits from them; none without both, or without competitors."""
    side = lambda name, p: report.filter(F.col("metric") == name).select([F.col(c).alias(f"{p}_{c}") for c in report.columns])
    both = side("population", "p").join(side(f"business_count.{category}", "c"), F.lit(True)).filter("c_value > 0")  # one row each
    p, c = lambda n: F.col(f"p_{n}"), lambda n: F.col(f"c_{n}")
    kinds = dict(report.dtypes)
    names = F.array_sort(F.array_distinct(F.filter(F.concat(F.split(p("sources"), ","), F.split(c("sources"), ",")), lambda x: x != "")))
    snaps = F.map_concat(F.from_json(p("source_snapshots"), "map<string,string>"), F.from_json(c("source_snapshots"), "map<string,string>"))
    merged = F.to_json(F.struct(*[snaps[s].alias(s) for s in SOURCES]))
    derived = {
        "metric": F.lit(f"people_per_competitor.{category}"), "track": F.lit("derived"), "value": F.round(p("value") / c("value"), 2), "confidence": conf.weaker(p("confidence"), c("confidence")),
        "sources": F.array_join(names, ","), "as_of": conf.older(p("as_of"), c("as_of")), "source_snapshots": merged, "stale": p("stale") | c("stale"), "native_res": conf.coarser(p("native_res"), c("native_res")),
        "direction_of_good": F.lit("higher"), **{n: c(n) for n in report.columns if n.startswith("cells_")},
    }
    return both.select([derived.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in report.columns])


def notes(ring_size: int, cells: DataFrame) -> DataFrame:
    """(note_no, note) of what a catchment's figures can't say."""
    c = cells.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("density_distorted"), F.lit(False)).alias("distorted"), F.coalesce(F.bool_or("population_stale"), F.lit(False)).alias("stale"))
    outside = F.when(F.col("n") < ring_size, F.format_string("%d of %d cells lie outside what has been processed and are left out; that is no absence of businesses.", F.lit(ring_size) - F.col("n"), F.lit(ring_size)))
    distorted = F.when(F.col("distorted"), "One cell or more is ruled by records that are no storefronts; it does not compare with an ordinary one.")
    stale = F.when(F.col("stale"), "Much has been built here since the population was counted; it is too low.")
    return c.select(F.posexplode(F.array(outside, distorted, stale)).alias("note_no", "note")).filter("note is not null").select((F.col("note_no") + 1).alias("note_no"), "note")


def catchment_context(catchment_: DataFrame) -> DataFrame:
    """One row: land, means over the cells that have a value, spread of saturation."""
    b = F.col("builtup_pct")
    return inside(catchment_).agg(
        F.count("*").alias("cells"), F.round(F.sum("land_area_m2"), 2).alias("land_m2"), (F.count("*") * grid.CELL_M2).alias("raw_m2"), F.round(F.avg("land_fraction"), 6).alias("mean_land_fraction"),
        F.round(F.avg(b), 6).alias("mean_builtup_pct"), F.round(F.avg("growth_pct"), 6).alias("mean_growth_pct"), F.round(F.avg(F.nullif(F.col("coverage_ratio"), F.lit(0.0))), 6).alias("mean_coverage_ratio"),
        F.bool_or("density_distorted").alias("distorted"), F.round(F.sum("population"), 4).alias("population"),
        F.count_if(b >= T.saturated_pct).alias("saturated"), F.count_if(b < T.greenfield_pct).alias("open"), F.count_if((b >= T.greenfield_pct) & (b < T.saturated_pct)).alias("developing"),
    )
