"""Queries that go through the sinks, readers and streams, and the small functions left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from hexloom.files import shared_folder
from hexloom.functions.geo import box_around, circle
from hexloom.functions.text import first_filled
from hexloom.operators.dedup import near_pairs
from hexloom.plans.base import POINTS_SQL, points, query
from hexloom.runtime import table
from hexloom.sources import readers, sinks
from hexloom.streaming.snapshots import arrivals, ingest, ingested


@query("SELECT source, snapshot, count(*) AS n FROM places GROUP BY 1, 2")
def snapshot_archive(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, SNK-03, SRC-01: written as key=value folders and read back with partition discovery"""
    base = shared_folder(spark, "archive")
    sinks.write_facts(table(spark, d, "places").select("source", "snapshot", "place_id", "name", "category"), base, by=("source", "snapshot"), sort="place_id")
    back = spark.read.option("basePath", base).parquet(base)
    return back.groupBy(F.col("source").cast("string").alias("source"), F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m') AS \"month\", event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    """STM-01, STM-02: all that has arrived, each file once, exactly as often as it came"""
    at = shared_folder(spark, "stream")
    stream = arrivals(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    stream = stream.select(F.date_format("ts", "yyyy-MM").alias("month"), "event_type", "event_id")
    ingest(stream, f"{at}/out", f"{at}/checkpoint", key="month").awaitTermination()
    return ingested(spark, f"{at}/out").groupBy(F.col("month").cast("string").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT h3_index, ('0x' || h3_index)::BIGINT AS cell, h3_res FROM h3_cell WHERE regexp_matches(h3_index, '^[0-9a-f]{15}$')")
def cell_numbers(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18: ids as numbers, bad ones skipped"""
    return readers.parse_cells(table(spark, d, "h3_cell"), "h3_index").select("h3_index", "cell", "h3_res")


_HAV = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH {POINTS_SQL} SELECT a.source, a.place_id FROM pt a WHERE EXISTS (FROM pt b WHERE a.source <> b.source AND abs(a.lat - b.lat) <= 0.0005 AND abs(a.lon - b.lon) <= 0.0005 AND {_HAV} <= 20)")
def exists_match(spark: SparkSession, d: str) -> DataFrame:
    """JN-24, JN-12 by distance: marked on either side, however many partners"""
    p = points(spark, d)
    spot = p.groupBy("source", "lat", "lon").agg(F.count("*").alias("n")).withColumn("rep", F.xxhash64("source", "lat", "lon"))
    o, f = (spot.filter(F.col("source") == s).select("rep", "lat", "lon") for s in ("overture", "fsq"))
    ends = near_pairs(o, f, 20.0).select(F.explode(F.array("l_rep", "r_rep")).alias("rep")).dropDuplicates()
    return p.withColumn("rep", F.xxhash64("source", "lat", "lon")).join(ends, "rep", "left_semi").select("source", "place_id")


@query()
def exists_match_named(spark: SparkSession, d: str) -> DataFrame:
    """JN-24 with names: near and at least 0.82 alike"""
    from hexloom.operators.dedup import flagged_records

    return flagged_records(points(spark, d), 20.0, 0.82, across=True)


@query(f"WITH {POINTS_SQL}, l AS (SELECT round(lat, 6) la, round(lon, 6) lo, min(category) category FROM pt WHERE source = 'overture' GROUP BY 1, 2) SELECT pt.place_id, l.category AS found_category FROM pt JOIN l ON round(pt.lat, 6) = l.la AND round(pt.lon, 6) = l.lo WHERE pt.source = 'fsq'")
def rounding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN-20: looked up by coordinates rounded to six places"""
    p = points(spark, d).withColumns({"la": F.round("lat", 6), "lo": F.round("lon", 6)})
    known = p.filter("source = 'overture'").groupBy("la", "lo").agg(F.min("category").alias("found_category"))
    return p.filter("source = 'fsq'").join(known, ["la", "lo"]).select("place_id", "found_category")


@query("SELECT area_id, round(lat - 0.5 / 111.32, 9) AS ymin, round(lat + 0.5 / 111.32, 9) AS ymax, round(lon - 0.5 / (111.32 * cos(radians(lat))), 9) AS xmin, 65 AS corners FROM near_areas WHERE kind = 'circle'")
def accuracy_circles(spark: SparkSession, d: str) -> DataFrame:
    """SCL-30, SCL-31"""
    c = table(spark, d, "near_areas").filter("kind = 'circle'")
    box = box_around(F.col("lat"), F.col("lon"), 0.5)
    return c.select("area_id", F.round(box["ymin"], 9).alias("ymin"), F.round(box["ymax"], 9).alias("ymax"), F.round(box["xmin"], 9).alias("xmin"), F.size(circle(F.col("lat"), F.col("lon"), F.col("radius_m"))).alias("corners"))


@query("SELECT DISTINCT pair_id, band, (row_number() OVER (PARTITION BY band ORDER BY pair_id) - 1)::INT AS turn FROM (SELECT DISTINCT pair_id, band FROM dup_triage_sample)")
def interleaving(spark: SparkSession, d: str) -> DataFrame:
    """WN-12: a running number in each band, by which bands are shown in turn"""
    p = table(spark, d, "dup_triage_sample").select("pair_id", "band").dropDuplicates()
    return p.withColumn("turn", F.row_number().over(Window.partitionBy("band").orderBy("pair_id")) - 1)


@query("SELECT DISTINCT pair_id, coalesce(nullif(trim(name_a), ''), nullif(trim(name_b), ''), nullif(trim(governorate), ''), '?') AS label FROM dup_triage_sample")
def place_labels(spark: SparkSession, d: str) -> DataFrame:
    """SCL-14"""
    p = table(spark, d, "dup_triage_sample")
    return p.select("pair_id", F.coalesce(first_filled(F.col("name_a"), F.col("name_b"), F.col("governorate")), F.lit("?")).alias("label")).dropDuplicates()


@query("""WITH f AS (SELECT feed, snapshot, count(*) n, min(delivered_at) a FROM raw_place_files GROUP BY 1, 2), g AS (SELECT *, max(a) OVER (PARTITION BY feed ORDER BY snapshot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) later, min(a) OVER (PARTITION BY feed ORDER BY snapshot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nxt FROM f)
SELECT feed, snapshot, n AS lines, coalesce(a > nxt, false) AS out_of_order FROM g""")
def late_files(spark: SparkSession, d: str) -> DataFrame:
    """STM-02: files delivered after their successors"""
    f = table(spark, d, "raw_place_files").groupBy("feed", "snapshot").agg(F.count("*").alias("lines"), F.min("delivered_at").alias("a"))
    w = Window.partitionBy("feed").orderBy("snapshot").rowsBetween(1, Window.unboundedFollowing)
    return f.select("feed", "snapshot", "lines", F.coalesce(F.col("a") > F.min("a").over(w), F.lit(False)).alias("out_of_order"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts::DATE AS "day", epoch(date_trunc('second', ts))::DOUBLE AS s, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT user_id, "day", k, s, 2.0::DOUBLE AS tokens, 0 AS refused FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e."day", e.k, e.s, CASE WHEN least(3.0, b.tokens + (e.s - b.s) / 3600.0) >= 1 THEN least(3.0, b.tokens + (e.s - b.s) / 3600.0) - 1 ELSE least(3.0, b.tokens + (e.s - b.s) / 3600.0) END,
  b.refused + CASE WHEN least(3.0, b.tokens + (e.s - b.s) / 3600.0) >= 1 THEN 0 ELSE 1 END FROM b JOIN e ON e.user_id = b.user_id AND e."day" = b."day" AND e.k = b.k + 1)
SELECT user_id, strftime("day", '%Y-%m-%d') AS "day", max(k)::INT AS events, round(arg_max(tokens, k), 6) AS tokens, arg_max(refused, k) AS refused FROM b GROUP BY 1, 2""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """SCL-22: tokens left after each user's events of a day, refilled at one an hour up to three, in order"""
    e = table(spark, d, "events").dropna(subset=["user_id", "ts"])
    e = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.unix_timestamp("ts"))).alias("at"))  # a user's day
    start = F.struct(F.lit(3.0).alias("tokens"), F.element_at("at", 1).cast("double").alias("last"), F.lit(0).alias("refused"))

    def step(s, t):
        full = F.least(F.lit(3.0), s["tokens"] + (t - s["last"]) / 3600.0)
        return F.struct(F.when(full >= 1, full - 1).otherwise(full).alias("tokens"), t.cast("double").alias("last"), (s["refused"] + F.when(full >= 1, 0).otherwise(1)).alias("refused"))

    out = e.withColumn("s", F.aggregate("at", start, step))
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size("at").alias("events"), F.round("s.tokens", 6).alias("tokens"), F.col("s.refused").alias("refused"))
