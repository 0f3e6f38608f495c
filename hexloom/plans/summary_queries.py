"""Summaries over the other queries: the gate of data checks, notes, unions of sources, tall reports, area weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import grid
from hexloom.plans.base import ORACLE, PLACES_SQL, POINTS_SQL, points, query, valid_places
from hexloom.plans.metric_queries import report_context
from hexloom.plans.quality_queries import carrier_check, coordinate_collapse, density_distortion, storefront_filter
from hexloom.plans.serving_queries import search_gate_counts
from hexloom.plans.time_queries import artifact_unbounded
from hexloom.runtime import table


def _sub(name: str) -> str:
    return f"({ORACLE[name]})"


@query(f"""SELECT 'C1 collapsed coordinates' AS "check", (SELECT count(*) FROM {_sub('coordinate_collapse')}) AS hits UNION ALL SELECT 'C2 crowded areas', (SELECT count(*) FROM {_sub('density_distortion')})
UNION ALL SELECT 'C3 no storefront', (SELECT count(*) FROM {_sub('storefront_filter')} WHERE not_storefront) UNION ALL SELECT 'C4 steps in series', (SELECT count(*) FROM {_sub('artifact_unbounded')})
UNION ALL SELECT 'C5 carried parents', (SELECT count(*) FROM {_sub('carrier_check')} WHERE verdict = 'fail')""")
def qa_gate(spark: SparkSession, d: str) -> DataFrame:
    """Q-15: one row for each check with what it found"""
    parts = [
        ("C1 collapsed coordinates", coordinate_collapse(spark, d)), ("C2 crowded areas", density_distortion(spark, d)), ("C3 no storefront", storefront_filter(spark, d).filter("not_storefront")),
        ("C4 steps in series", artifact_unbounded(spark, d)), ("C5 carried parents", carrier_check(spark, d).filter("verdict = 'fail'")),
    ]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("hits")).select(F.lit(name).alias("check"), "hits")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT gate, CASE gate WHEN 'searchable' THEN format('{{}} cells can be searched.', cells) WHEN 'uninhabited' THEN format('{{}} cells are left out: hardly anybody lives there.', cells) ELSE format('{{}} cells are left out: {{}}.', cells, replace(gate, '_', ' ')) END AS note FROM {_sub('search_gate_counts')}""")
def search_notes(spark: SparkSession, d: str) -> DataFrame:
    """SCL-16"""
    g = search_gate_counts(spark, d)
    note = F.when(F.col("gate") == "searchable", F.format_string("%d cells can be searched.", "cells")).when(F.col("gate") == "uninhabited", F.format_string("%d cells are left out: hardly anybody lives there.", "cells"))
    return g.select("gate", note.otherwise(F.format_string("%d cells are left out: %s.", "cells", F.replace("gate", F.lit("_"), F.lit(" ")))).alias("note"))


@query(f"""WITH {PLACES_SQL} SELECT h3_res8, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) FILTER (source = 'overture') AS overture, count(*) FILTER (source = 'fsq') AS fsq, min(l.snapshot) AS oldest FROM vp JOIN (SELECT source, snapshot FROM last) l USING (source) WHERE h3_res8 IS NOT NULL GROUP BY 1""")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    """AG-14, AG-15: sources of each area with their counts and the oldest vintage"""
    last = table(spark, d, "places").groupBy("source").agg(F.max("snapshot").alias("snapshot"))
    n = valid_places(spark, d).dropna(subset=["h3_res8"]).groupBy("h3_res8", "source").agg(F.count("*").alias("n")).join(last, "source")
    by = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(s)
    return n.groupBy("h3_res8").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), by("overture"), by("fsq"), F.min("snapshot").alias("oldest"))


@query(f"""SELECT name, value FROM (SELECT cells::DOUBLE AS cells, land_m2, mean_land_fraction, mean_builtup_pct, mean_growth_pct, population FROM {_sub('report_context')}) UNPIVOT INCLUDE NULLS (value FOR name IN (cells, land_m2, mean_land_fraction, mean_builtup_pct, mean_growth_pct, population))""")
def report_tall(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-10, SR-08: the report's figures one below the other"""
    names = ["cells", "land_m2", "mean_land_fraction", "mean_builtup_pct", "mean_growth_pct", "population"]
    c = report_context(spark, d).select(*[F.col(n).cast("double").alias(n) for n in names])
    return c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*").orderBy("name")


_BOX = (95_000, 388_000, 104_000, 393_000)


@query(f"""WITH {POINTS_SQL}, c AS (SELECT DISTINCT q, r, (q + CAST(floor((r - (r % 2 + 2) % 2) / 2.0) AS BIGINT)) * 350 - ((r % 2 + 2) % 2) * 175 AS x0, r * 300 AS y0 FROM pt),
w AS (SELECT q, r, greatest(0, least(x0 + 350, {_BOX[2]}) - greatest(x0, {_BOX[0]})) * greatest(0, least(y0 + 300, {_BOX[3]}) - greatest(y0, {_BOX[1]})) AS m2 FROM c) SELECT q, r, m2, round(m2 / 105000.0, 6) AS weight FROM w WHERE m2 > 0""")
def box_weights(spark: SparkSession, d: str) -> DataFrame:
    """JN-17: the share of each cell that lies in a rectangle; cells are rectangles, so the overlap is exact"""
    c = points(spark, d).select("q", "r").dropDuplicates()
    x, y = grid.centre(F.col("q"), F.col("r"))
    over = lambda lo, hi, a, b: F.greatest(F.lit(0), F.least(hi, F.lit(b)) - F.greatest(lo, F.lit(a)))
    m2 = over(x - grid.W // 2, x + grid.W // 2, _BOX[0], _BOX[2]) * over(y - grid.H // 2, y + grid.H // 2, _BOX[1], _BOX[3])
    return c.withColumn("m2", m2).filter("m2 > 0").withColumn("weight", F.round(F.col("m2") / float(grid.CELL_M2), 6))
