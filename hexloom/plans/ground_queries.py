"""Figures of regions, tiles and series: cross tables, masks, profiles, growth in parts, late rows, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions.confidence import LEVELS
from hexloom.operators import dedup as D
from hexloom.operators import search as S
from hexloom.operators import series
from hexloom.plans import built_queries as built
from hexloom.plans.base import CELLS_SQL, ORACLE, history, plausible, points, query
from hexloom.plans.coverage_queries import _PIX, _pixels, polygon_to_cells
from hexloom.plans.serving_queries import _GATED, SEARCH, _gated
from hexloom.runtime import table
from hexloom.streaming.snapshots import recomputed


@query(f"""WITH {CELLS_SQL}, {built._METRICS} SELECT track, count(*) FILTER (confidence = 'corroborated') AS corroborated, count(*) FILTER (confidence = 'single_source') AS single_source, count(*) FILTER (confidence = 'unavailable') AS unavailable, count(*) AS total,
round(100.0 * count(*) FILTER (confidence = 'corroborated') / count(*), 4) AS pct_corroborated FROM metric GROUP BY 1""")
def track_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """AG-20: tracks by confidence, with row totals and percentages"""
    n = built.served_metrics(spark, d).groupBy("track").pivot("confidence", list(reversed(LEVELS))).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(c) for c in LEVELS[1:]), F.col(LEVELS[0]))
    return n.select("track", *reversed(LEVELS), total.alias("total"), F.round(100.0 * F.try_divide(F.col("corroborated"), total), 4).alias("pct_corroborated"))


@query(f"""WITH {_PIX} SELECT CAST(floor("row" / 20.0) AS BIGINT) AS band, count(*) AS pixels, count(DISTINCT tile) AS tiles, count(*) FILTER (value > 3) AS valid, count(*) FILTER (value > 40) AS present,
sum(value) FILTER (value > 3) AS index_sum, round(avg(value) FILTER (value > 3 AND value > 40), 6) AS mean_present FROM px GROUP BY 1""")
def masked_raster(spark: SparkSession, d: str) -> DataFrame:
    """AG-37: valid and present pixels by mask, the mean where present, pixels and tiles"""
    p = _pixels(spark, d).withColumn("band", F.floor(F.col("row") / F.lit(20)).cast("bigint"))
    v = F.col("value")
    return p.groupBy("band").agg(
        F.count("*").alias("pixels"), F.count_distinct("tile").alias("tiles"), F.count_if(v > 3).alias("valid"), F.count_if(v > 40).alias("present"),
        F.sum(F.when(v > 3, v)).alias("index_sum"), F.round(F.avg(F.when((v > 3) & (v > 40), v)), 6).alias("mean_present"),
    )


@query("""WITH c AS (SELECT governorate, count(*) cells, round(quantile_cont(builtup_pct, 0.5), 6) p50, round(quantile_cont(builtup_pct, 0.25), 6) p25, round(avg((coverage_ratio < 0.5)::INT), 6) below_half FROM h3_cell WHERE governorate IS NOT NULL GROUP BY 1),
p AS (SELECT governorate, count(*) places, round(avg((snapshot >= '2026')::INT), 6) recent_share FROM places JOIN h3_cell ON h3_index = h3_res9 WHERE governorate IS NOT NULL GROUP BY 1)
SELECT governorate, cells, p50, p25, below_half, places, recent_share FROM c LEFT JOIN p USING (governorate)""")
def region_profile(spark: SparkSession, d: str) -> DataFrame:
    """AG-38: medians, lower quartiles, the share below a half, and the share of a period's rows"""
    cell = table(spark, d, "h3_cell").filter("governorate is not null")
    q = F.percentile("builtup_pct", F.array(F.lit(0.5), F.lit(0.25)))
    c = cell.groupBy("governorate").agg(F.count("*").alias("cells"), q.alias("q"), F.round(F.avg((F.col("coverage_ratio") < 0.5).cast("int")), 6).alias("below_half"))
    # Counted by cell first: a crowded cell is one row at the join.
    p = table(spark, d, "places").groupBy("h3_res9").agg(F.count("*").alias("n"), F.count_if(F.col("snapshot") >= "2026").alias("m"))
    p = p.join(cell.select(F.col("h3_index").alias("h3_res9"), "governorate"), "h3_res9").groupBy("governorate").agg(F.sum("n").alias("places"), F.round(F.sum("m") / F.sum("n"), 6).alias("recent_share"))
    return c.join(p, "governorate", "left").select("governorate", "cells", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p25"), "below_half", "places", "recent_share")


@query(f"{_GATED} SELECT row_number() OVER (ORDER BY ratio DESC, q, r) AS place, q, r, row_number() OVER (ORDER BY ratio DESC, q, r) <= 100 AS listed FROM matched")
def search_matches(spark: SparkSession, d: str) -> DataFrame:
    """SR-02: all matches in the stated order, listed or not; the cap follows the order"""
    m = S.matched(_gated(spark, d), SEARCH)
    at = F.row_number().over(Window.orderBy(F.desc("sort_value") if SEARCH.descending else F.asc("sort_value"), "q", "r"))  # the matches of one search
    return m.select(at.alias("place"), "q", "r").withColumn("listed", F.col("place") <= SEARCH.most)


@query("""WITH g AS (SELECT h3_index, builtup_pct AS after, CASE WHEN 1 + builtup_growth_pct_2015_2025 / 100 > 0 THEN builtup_pct / (1 + builtup_growth_pct_2015_2025 / 100) END AS before, land_fraction FROM h3_cell)
SELECT h3_index, round(after - before, 6) AS gained, CASE WHEN before > 0 THEN round(100 * (after - before) / before, 4) END AS growth_pct, before = 0 AND after > 0 AS from_nothing, CASE WHEN after > 0 THEN round((after - before) / after, 6) END AS new_fraction,
(coalesce(before > 0 AND 100 * (after - before) / before >= 50, false) OR coalesce(before = 0 AND after > 0, false)) AND land_fraction >= 0.05 AS stale FROM g""")
def growth_parts(spark: SparkSession, d: str) -> DataFrame:
    """SCL-23: absolute, in percent, from nothing, the new fraction, and whether a count of people is stale"""
    factor = 1 + F.col("builtup_growth_pct_2015_2025") / 100
    g = table(spark, d, "h3_cell").select("h3_index", "land_fraction", F.col("builtup_pct").alias("after"), F.when(factor > 0, F.col("builtup_pct") / factor).alias("before"))
    a, b = F.col("after"), F.col("before")
    pct, nothing = F.when(b > 0, 100 * (a - b) / b), (b == 0) & (a > 0)
    stale = (F.coalesce(pct >= T.stale_growth_pct, F.lit(False)) | F.coalesce(nothing, F.lit(False))) & (F.col("land_fraction") >= T.land_fraction_floor)
    return g.select("h3_index", F.round(a - b, 6).alias("gained"), F.round(pct, 4).alias("growth_pct"), nothing.alias("from_nothing"), F.when(a > 0, F.round((a - b) / a, 6)).alias("new_fraction"), stale.alias("stale"))


_LATE = f"""w AS (SELECT h3_index, metric, snapshot_id, max(written_at) wm, min(written_at) wn FROM h3_metric_history GROUP BY 1, 2, 3),
late AS (SELECT DISTINCT h3_index, metric FROM (SELECT *, min(wn) OVER (PARTITION BY h3_index, metric ORDER BY snapshot_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nxt FROM w) WHERE wm > nxt)"""


@query(f"""WITH {built._HISTORY}, {_LATE} SELECT h3_index, metric, snapshot_id, value, CASE WHEN hit THEN 'artifact_suspected' ELSE 'ok' END AS status, excluded AS excluded_from_corrected FROM ex JOIN late USING (h3_index, metric)""")
def late_backfill(spark: SparkSession, d: str) -> DataFrame:
    """STM-02: series into which a row came after its successors, detected again from all their rows"""
    raw = table(spark, d, "h3_metric_history").dropna(subset=["h3_index", "metric", "snapshot_id"])
    w = raw.groupBy("h3_index", "metric", "snapshot_id").agg(F.max("written_at").alias("wm"), F.min("written_at").alias("wn"))
    after = Window.partitionBy("h3_index", "metric").orderBy("snapshot_id").rowsBetween(1, Window.unboundedFollowing)
    late = w.withColumn("nxt", F.min("wn").over(after)).filter("wm > nxt").select("h3_index", "metric")

    def build(rows: DataFrame) -> DataFrame:
        ex = series.with_exclusion(series.with_artifacts(rows.filter(plausible()), built.SERIES, "snapshot_id", "value"), built.SERIES)
        return ex.select("h3_index", "metric", "snapshot_id", "value", F.when(F.col("hit"), "artifact_suspected").otherwise("ok").alias("status"), F.col("excluded").alias("excluded_from_corrected"))

    return recomputed(history(spark, d), late, built.SERIES, build)


@query("""SELECT feed, snapshot, count(*) AS lines, count(*) FILTER (json_valid(payload) AND json_array_length(json_extract(CASE WHEN json_valid(payload) THEN payload END, '$.unresolved_flags')) > 0) AS flagged FROM raw_place_files WHERE feed IS NOT NULL AND snapshot IS NOT NULL GROUP BY 1, 2""")
def flagged_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT-20: lines of a file with a non-empty array of flags"""
    flags = F.from_json(F.get_json_object("payload", "$.unresolved_flags"), "array<string>")
    n = F.size(F.coalesce(flags, F.array().cast("array<string>")))
    return table(spark, d, "raw_place_files").dropna(subset=["feed", "snapshot"]).groupBy("feed", "snapshot").agg(F.count("*").alias("lines"), F.count_if(n > 0).alias("flagged"))


@query(f"""WITH c AS ({ORACLE['polygon_to_cells']}), n AS (SELECT area_id, count(*) n FROM c GROUP BY 1), s AS (SELECT a.area_id a1, b.area_id a2, count(*) both_n FROM c a JOIN c b USING (q, r) WHERE a.area_id < b.area_id GROUP BY 1, 2)
SELECT a1 AS area_1, a2 AS area_2, both_n AS intersection, x.n + y.n - both_n AS "union", round(both_n / (x.n + y.n - both_n)::DOUBLE, 6) AS overlap FROM s JOIN n x ON x.area_id = a1 JOIN n y ON y.area_id = a2""")
def cell_sets(spark: SparkSession, d: str) -> DataFrame:
    """GEO-06: intersection and union of areas as sets of cells; the table of areas is fixed"""
    c = polygon_to_cells(spark, d)
    n = c.groupBy("area_id").agg(F.count("*").alias("n"))
    side = lambda p: c.select("q", "r", F.col("area_id").alias(f"area_{p}"))
    both = side(1).join(side(2), ["q", "r"]).filter("area_1 < area_2").groupBy("area_1", "area_2").agg(F.count("*").alias("intersection"))
    for p in (1, 2):
        both = both.join(n.select(F.col("area_id").alias(f"area_{p}"), F.col("n").alias(f"n{p}")), f"area_{p}")
    union = F.col("n1") + F.col("n2") - F.col("intersection")
    return both.select("area_1", "area_2", "intersection", union.alias("union"), F.round(F.col("intersection") / union, 6).alias("overlap"))


@query()
def qa_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Q-15, JN-09: the gate's line for records of one source that are near each other and alike in name"""
    n = D.duplicated(points(spark, d), T.intra_m, T.duplicate_similarity)
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("hits")).select(F.lit("C2 likely duplicates").alias("check"), "hits")


def history_manifest(spark: SparkSession, d: str, gaps: dict[str, str] | None = None) -> dict:
    """SNK-07: what a history holds and how its steps were sought. gaps: snapshots that are missing, with the reason."""
    h = table(spark, d, "h3_metric_history")
    snaps = [r[0] for r in h.select("snapshot_id").dropna().distinct().orderBy("snapshot_id").collect()]  # a calendar
    rows = h.groupBy("metric").agg(F.count("*").alias("n")).dropna().collect()
    return {
        "snapshots": snaps, "rows": {r.metric: r.n for r in sorted(rows, key=lambda r: r.metric)}, "known_gaps": [{"snapshot": s, "reason": why} for s, why in sorted((gaps or {}).items())],
        "detector": {"jump_pct": T.jump_pct, "flat_tol_pct": T.flat_pct, "min_flat_releases": T.min_flat, "min_base": T.min_base, "min_abs_jump": T.min_abs_jump}, "min_corrected_points": T.min_corrected_points,
    }


def coverage_documents(split: DataFrame, regions: DataFrame) -> tuple[dict, list[dict]]:
    """SNK-06: the summary and the list of regions of a coverage export; as many rows as there are scopes and regions."""
    summary = {r["scope"]: {k: v for k, v in r.asDict().items() if k != "scope"} for r in split.collect()}
    return summary, [r.asDict() for r in regions.collect()]


def gap_notes(spark: SparkSession, manifest: dict) -> DataFrame:
    """SCL-32: (missing_snapshot, note) of the gaps a manifest declares; nothing is interpolated."""
    gaps = spark.createDataFrame([(g["snapshot"], g["reason"]) for g in manifest["known_gaps"]], "missing_snapshot string, reason string")
    return gaps.select("missing_snapshot", F.format_string("%s is missing: %s.", "missing_snapshot", "reason").alias("note"))


