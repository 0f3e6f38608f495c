"""Series over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexloom.functions.categories import SQL_GROUPS, groups_of
from hexloom.functions.text import snapshot_date
from hexloom.operators import series as S
from hexloom.plans.base import HISTORY_SQL, PLAUSIBLE_SQL, history, plausible, query
from hexloom.runtime import table

SERIES = ["h3_index", "metric"]


def _good(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).filter(plausible())


_GOOD = f"{HISTORY_SQL},\ngood AS (SELECT * FROM hist WHERE {PLAUSIBLE_SQL})"
_W = "WINDOW w AS (PARTITION BY h3_index, metric ORDER BY snapshot_id)"
_FLAT = "abs(100 * (lead(value, 1) OVER w - value) / nullif(value, 0)) <= 15 AND abs(100 * (lead(value, 2) OVER w - value) / nullif(value, 0)) <= 15"
_HITS = f"""{_GOOD},
hits AS (SELECT *, row_number() OVER w AS ord, count(*) OVER (PARTITION BY h3_index, metric) n, 100 * (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) jump,
coalesce(100 * (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) >= 40 AND lag(value) OVER w >= 5 AND value - lag(value) OVER w >= 3 AND {_FLAT}, false) hit FROM good {_W}),
ex AS (SELECT *, coalesce(ord < max(ord) FILTER (hit) OVER (PARTITION BY h3_index, metric), false) excluded FROM hits)"""


@query(f"WITH {_HITS} SELECT h3_index, metric, snapshot_id, value, round(jump, 4) jump_pct FROM hits WHERE hit")
def artifact_points(spark: SparkSession, d: str) -> DataFrame:
    """WN-05"""
    return S.with_artifacts(_good(spark, d), SERIES, "snapshot_id", "value").filter("hit").select(*SERIES, "snapshot_id", "value", F.round("jump_pct", 4).alias("jump_pct"))


@query(f"""WITH {_GOOD}, u AS (SELECT *, 100 * (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) jump, coalesce(abs(100 * (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0)) >= 40 AND {_FLAT}, false) hit FROM good {_W})
SELECT h3_index, metric, snapshot_id, round(jump, 4) jump_pct FROM u WHERE hit""")
def artifact_unbounded(spark: SparkSession, d: str) -> DataFrame:
    """WN-06: both directions, no floors"""
    return S.with_artifacts(_good(spark, d), SERIES, "snapshot_id", "value", floors=False).filter("hit").select(*SERIES, "snapshot_id", F.round("jump_pct", 4).alias("jump_pct"))


@query(f"""WITH {_HITS}, t AS (SELECT h3_index, metric, count(*) points, count(*) FILTER (hit) hits, count(*) FILTER (NOT excluded) kept, arg_min(value, ord) f, arg_max(value, ord) l, arg_min(value, ord) FILTER (NOT excluded) b FROM ex GROUP BY ALL),
s AS (SELECT *, CASE WHEN hits = 0 THEN 'not_needed' WHEN kept < 8 THEN 'withheld_too_short' ELSE 'applied' END status, CASE WHEN points >= 2 THEN round(100 * (l - f) / nullif(f, 0), 1) + 0.0 END raw_pct FROM t),
c AS (SELECT *, CASE WHEN status = 'applied' AND kept >= 2 THEN round(100 * (l - b) / nullif(b, 0), 1) + 0.0 END corrected_pct FROM s)
SELECT h3_index, metric, points, hits, kept, raw_pct, corrected_pct, status, coalesce(abs(raw_pct - corrected_pct) >= 20, false) diverges FROM c""")
def corrected_series(spark: SparkSession, d: str) -> DataFrame:
    """WN-07 to WN-11"""
    return S.trends(S.with_exclusion(S.with_artifacts(_good(spark, d), SERIES, "snapshot_id", "value"), SERIES), SERIES, "value")


@query(f"""WITH {_HITS} SELECT metric, count(DISTINCT h3_index) AS series, count(DISTINCT h3_index) FILTER (hit) AS flagged, count(*) FILTER (hit) AS points_flagged, count(*) FILTER (excluded) AS points_excluded,
round(100.0 * count(DISTINCT h3_index) FILTER (hit) / count(DISTINCT h3_index), 1) AS flagged_pct FROM ex GROUP BY 1""")
def artifact_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG-39"""
    ex = S.with_exclusion(S.with_artifacts(_good(spark, d), SERIES, "snapshot_id", "value"), SERIES)
    # By series first: no distinct over all rows of a metric.
    s = ex.groupBy(*SERIES).agg(F.count_if("hit").alias("h"), F.count_if("excluded").alias("e"))
    out = s.groupBy("metric").agg(F.count("*").alias("series"), F.count_if(F.col("h") > 0).alias("flagged"), F.sum("h").alias("points_flagged"), F.sum("e").alias("points_excluded"))
    return out.withColumn("flagged_pct", F.round(100.0 * F.col("flagged") / F.col("series"), 1))


@query(f"WITH {_GOOD} SELECT h3_index, metric, count(*) AS points, CASE WHEN count(*) >= 2 THEN round(100 * (arg_max(value, snapshot_id) - arg_min(value, snapshot_id)) / nullif(arg_min(value, snapshot_id), 0), 1) + 0.0 END AS growth_pct FROM good GROUP BY ALL")
def growth_first_last(spark: SparkSession, d: str) -> DataFrame:
    """WN-10, WN-13"""
    g = _good(spark, d).groupBy(*SERIES).agg(F.count("*").alias("points"), F.min_by("value", "snapshot_id").alias("f"), F.max_by("value", "snapshot_id").alias("l"))
    return g.select(*SERIES, "points", S.growth_pct(F.col("f"), F.col("l"), F.col("points")).alias("growth_pct"))


@query(f"""WITH {_HITS}, s AS (SELECT h3_index, metric, max(n) n, arg_min(ord, (value, ord)) low_at, arg_min(ord, (-value, ord)) high_at, min(value) low, max(value) high FROM hits GROUP BY ALL)
SELECT h3_index, metric, low_at::INT AS low_at, high_at::INT AS high_at, CASE WHEN high - low <= 0.05 * high THEN 'flat' WHEN low_at > 1 AND low_at < n AND NOT (high_at > 1 AND high_at < n) THEN 'dip' WHEN high_at > 1 AND high_at < n AND NOT (low_at > 1 AND low_at < n) THEN 'peak' ELSE 'slope' END shape FROM s""")
def series_shape(spark: SparkSession, d: str) -> DataFrame:
    """WN-15"""
    return S.shape(S.with_artifacts(_good(spark, d), SERIES, "snapshot_id", "value"), SERIES, "value")


@query(f"""WITH {HISTORY_SQL}, o AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) ord FROM (SELECT DISTINCT snapshot_id FROM hist)),
i AS (SELECT h3_index, metric, ord, ord - row_number() OVER (PARTITION BY h3_index, metric ORDER BY ord) g FROM hist JOIN o USING (snapshot_id))
SELECT h3_index, metric, min(ord)::INT AS start, max(ord)::INT AS stop, count(*) AS length FROM i GROUP BY h3_index, metric, g""")
def row_runs(spark: SparkSession, d: str) -> DataFrame:
    """WN-16: unbroken stretches of snapshots"""
    h = history(spark, d)
    o = h.select("snapshot_id").dropDuplicates().withColumn("ord", F.row_number().over(Window.orderBy("snapshot_id")))  # calendar-sized
    return S.runs(h.join(F.broadcast(o), "snapshot_id"), SERIES, "ord")


@query("WITH s AS (SELECT snapshot_id, regexp_extract(snapshot_id, '^(\\d{4}-\\d{2}-\\d{2})', 1) AS snapshot_date, count(*) AS row_count FROM h3_metric_history GROUP BY ALL) SELECT snapshot_id, snapshot_date, row_count, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS next_id, date_diff('day', snapshot_date::DATE, (lead(snapshot_date) OVER (ORDER BY snapshot_id))::DATE) AS gap_days FROM s")
def release_calendar(spark: SparkSession, d: str) -> DataFrame:
    """SCL-10: the releases, their rows and the days to the next"""
    s = table(spark, d, "h3_metric_history").groupBy("snapshot_id").agg(F.count("*").alias("row_count")).withColumn("snapshot_date", snapshot_date(F.col("snapshot_id")))
    w = Window.orderBy("snapshot_id")  # calendar-sized
    gap = F.datediff(F.to_date(F.lead("snapshot_date").over(w)), F.to_date("snapshot_date")).cast("bigint")
    return s.select("snapshot_id", "snapshot_date", "row_count", F.lead("snapshot_id").over(w).alias("next_id"), gap.alias("gap_days"))


_SEEN = """spans AS (SELECT source, place_id, min(snapshot) a, max(snapshot) z FROM places GROUP BY 1, 2),
snaps AS (SELECT source, snapshot, lead(snapshot) OVER (PARTITION BY source ORDER BY snapshot) nxt FROM (SELECT DISTINCT source, snapshot FROM places)),
life AS (SELECT s.source, s.place_id, substr(a, 1, 10) created, substr(nxt, 1, 10) closed FROM spans s JOIN snaps ON snaps.source = s.source AND snaps.snapshot = s.z)"""
SPINE = [f"{y}-{m}" for y in range(2024, 2027) for m in ("03-31", "06-30", "09-30", "12-31")]


def _lives(spark: SparkSession, d: str) -> DataFrame:
    """Places with the date they first came and that of the first snapshot without them, null while they are there."""
    p = table(spark, d, "places")
    snaps = p.select("source", "snapshot").dropDuplicates().withColumn("nxt", F.lead("snapshot").over(Window.partitionBy("source").orderBy("snapshot")))
    spans = p.groupBy("source", "place_id").agg(F.min("snapshot").alias("a"), F.max("snapshot").alias("snapshot"))
    return spans.join(snaps, ["source", "snapshot"]).select("source", "place_id", snapshot_date(F.col("a")).alias("created"), F.when(F.col("nxt").isNotNull(), snapshot_date(F.col("nxt"))).alias("closed"))


def _spine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SPINE], "at string")


_SPINE = f"spine AS (SELECT unnest({SPINE}) AS \"at\")"


@query(f"WITH {_SEEN}, {_SPINE} SELECT \"at\", count(source) AS n_open FROM spine LEFT JOIN life ON created <= \"at\" AND (closed IS NULL OR closed > \"at\") GROUP BY 1")
def open_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Q-19: JN-21, FLT-17"""
    return S.open_as_of(_lives(spark, d), _spine(spark), "at", "created", "closed")


@query(f"WITH {_SEEN} SELECT y.year, count(source) AS created FROM (SELECT unnest(range(2020, 2031)) AS year) y LEFT JOIN life ON substr(created, 1, 4)::INT = y.year GROUP BY 1")
def year_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG-31: years without any are zero"""
    n = _lives(spark, d).groupBy(F.substring("created", 1, 4).cast("bigint").alias("year")).agg(F.count("*").alias("created"))
    return spark.range(2020, 2031).withColumnRenamed("id", "year").join(n, "year", "left").fillna(0, ["created"])


@query(f"WITH {_SEEN}, {_SPINE} SELECT \"at\", round(count(source) FILTER (created <= \"at\") / count(*)::DOUBLE, 6) AS settled_share FROM spine CROSS JOIN life GROUP BY 1")
def settled_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """AG-32: a running sum, not years times records"""
    lives = _lives(spark, d).withColumn("never", F.lit(None).cast("string"))
    total = lives.agg(F.count("*").alias("n"))
    return S.open_as_of(lives, _spine(spark), "at", "created", "never").join(F.broadcast(total), F.lit(True)).select("at", F.round(F.col("n_open") / F.col("n"), 6).alias("settled_share"))


@query(f"""WITH v AS (SELECT source, place_id, snapshot, arg_max(category, delivered_at) FILTER (category IS NOT NULL) category, arg_max(h3_res9, delivered_at) FILTER (h3_res9 IS NOT NULL) h3_res9 FROM places GROUP BY 1, 2, 3),
e AS (SELECT h3_res9, source, snapshot, unnest(list_append({SQL_GROUPS}, 'total')) metric FROM v WHERE h3_res9 IS NOT NULL)
SELECT h3_res9, source, metric, snapshot, count(*) AS value FROM e GROUP BY ALL""")
def history_fact(spark: SparkSession, d: str) -> DataFrame:
    """Q-11: SRC-07, AG-02 over all snapshots"""
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("delivered_at"))).alias(c)
    v = table(spark, d, "places").groupBy("source", "place_id", "snapshot").agg(at("category"), at("h3_res9")).dropna(subset=["h3_res9"])
    each = v.select("h3_res9", "source", "snapshot", F.explode(F.array_append(groups_of(F.col("source"), F.col("category")), F.lit("total"))).alias("metric"))
    return each.groupBy("h3_res9", "source", "metric", "snapshot").agg(F.count("*").alias("value"))
