"""Records of two sources beside each other: groups to verify, pairs within regions, matches by name, unions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hexloom.config import T
from hexloom.functions import categories as cat
from hexloom.functions import text as X
from hexloom.operators import dedup as D
from hexloom.plans.base import ORACLE, PLACES_SQL, POINTS_SQL, points, query, valid_places
from hexloom.plans.quality_queries import mutual_best_round
from hexloom.runtime import table

# Categories by the way their records are verified; flat ones as they are, paths by how they begin.
FOOD = ("restaurant", "coffee_shop", "cafe", "chicken_restaurant", "burger_restaurant", "desserts", "fast_food_restaurant", "pancake_house", "chocolatier", "theme_restaurant", "syrian_restaurant")
MEDICAL = ("doctor", "pharmacy", "ear_nose_and_throat", "hospital", "dentist", "cosmetic_dentist")
FOOD_PATHS = ("Dining and Drinking", "Food and Drink")
MEDICAL_PATHS = ("Health and Medicine", "Health")
# Fixed value: how alike two names must be to be one place by name alone.
BY_NAME = 0.9

_list = lambda words: ", ".join(f"'{w}'" for w in words)
_starts = lambda words: " OR ".join(f"starts_with(category, '{w}')" for w in words)


@query(f"""WITH {PLACES_SQL}, crowd AS (SELECT round(lat, 5) la, round(lon, 5) lo FROM vp WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT name) >= 3)
SELECT source, place_id, CASE WHEN coalesce(category, '') = '' THEN 'UNCLEAR/NO CATEGORY' WHEN source = 'overture' THEN CASE WHEN category IN ({_list(FOOD)}) THEN 'FOOD' WHEN category IN ({_list(MEDICAL)}) THEN 'MEDICAL/CLINIC' ELSE 'RETAIL/SERVICE' END
  WHEN {_starts(FOOD_PATHS)} THEN 'FOOD' WHEN {_starts(MEDICAL_PATHS)} THEN 'MEDICAL/CLINIC' ELSE 'RETAIL/SERVICE' END AS verification
FROM vp WHERE NOT {cat.SQL_NOT_STOREFRONT} AND NOT EXISTS (FROM crowd WHERE la = round(vp.lat, 5) AND lo = round(vp.lon, 5))""")
def verification_groups(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-06: how each record is verified, by category; crowded coordinates and records that are no storefront are left out"""
    s, c = F.col("source"), F.col("category")
    p = valid_places(spark, d).filter(~cat.not_storefront(s, c, F.col("name")))
    at = [F.round("lat", T.collapse_decimals).alias("la"), F.round("lon", T.collapse_decimals).alias("lo")]
    n = valid_places(spark, d).dropna(subset=["lat", "lon"]).groupBy(*at, "name").agg(F.count("*").alias("n")).groupBy("la", "lo").agg(F.sum("n").alias("n"), F.count("name").alias("names"))
    crowd = n.filter((F.col("n") >= T.collapse_group) & (F.col("names") >= T.collapse_group)).select("la", "lo")
    p = p.select("*", *at).join(crowd, ["la", "lo"], "left_anti")
    begins = lambda words: F.greatest(*[c.startswith(w) for w in words])
    flat = F.when(c.isin(*FOOD), "FOOD").when(c.isin(*MEDICAL), "MEDICAL/CLINIC").otherwise("RETAIL/SERVICE")
    path = F.when(begins(FOOD_PATHS), "FOOD").when(begins(MEDICAL_PATHS), "MEDICAL/CLINIC").otherwise("RETAIL/SERVICE")
    kind = F.when(F.coalesce(c, F.lit("")) == "", "UNCLEAR/NO CATEGORY").when(s == "overture", flat).otherwise(path)
    return p.select("source", "place_id", kind.alias("verification"))


def _with_region(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "h3_cell").select(F.col("h3_index").alias("h3_res9"), "governorate").dropDuplicates(["h3_res9"])
    return points(spark, d).join(region, "h3_res9", "left")


@query()
def region_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-10, JN-09: pairs within a region that are near and alike in name, of one source or of two"""
    got = D.region_pairs(_with_region(spark, d), "governorate", T.duplicate_m, T.duplicate_similarity)
    return got.withColumns({"metres": F.round("metres", 1), "likeness": F.round("likeness", 3)})


@query()
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """JN-14: one to one within an area by name alone, the most alike first"""
    got = D.matched_by_name(points(spark, d), "overture", "fsq", "h3_res8", BY_NAME)
    return got.select(F.col("l_id").alias("overture_id"), F.col("r_id").alias("fsq_id"), F.round("metres", 1).alias("metres"), F.round("likeness", 3).alias("likeness"))


@query()
def position_errors(spark: SparkSession, d: str) -> DataFrame:
    """Q-20, JN-14, AG-10: how far apart the two records of one name stand, as quantiles over all matches"""
    m = D.matched_by_name(points(spark, d), "overture", "fsq", "h3_res8", BY_NAME)
    q = F.percentile("metres", F.array(*[F.lit(v) for v in (0.5, 0.75, 0.9, 1.0)]))
    return m.agg(F.count("*").alias("pairs"), q.alias("q")).select("pairs", *[F.round(F.col("q")[i], 1).alias(n) for i, n in enumerate(("p50_m", "p75_m", "p90_m", "max_m"))])


_BONES = f"regexp_replace({X.sql_normalize('name')}, '[aeiou\\s]', '', 'g')"
_HAV = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""WITH {POINTS_SQL}, k AS (SELECT *, {_BONES} bones FROM pt WHERE name IS NOT NULL)
SELECT a.source, a.place_id FROM k a WHERE length(bones) > 0 AND EXISTS (FROM k b WHERE a.source <> b.source AND a.bones = b.bones AND abs(a.lat - b.lat) <= 0.001 AND abs(a.lon - b.lon) <= 0.001 AND {_HAV} <= 40)""")
def skeleton_match(spark: SparkSession, d: str) -> DataFrame:
    """JN-12, third strategy: near and of the same consonants"""
    p = points(spark, d).withColumn("bones", X.skeleton(X.normalize(F.col("name")))).filter(F.length("bones") > 0)
    spot = D.spots(p, ["source", "bones"]).select("source", "bones", "rep", "lat", "lon")
    o, f = (spot.filter(F.col("source") == s).select("rep", "bones", "lat", "lon") for s in ("overture", "fsq"))
    ends = D.near_pairs(o, f, T.duplicate_m).filter("l_bones = r_bones").select(F.explode(F.array("l_rep", "r_rep")).alias("rep")).dropDuplicates()
    return p.withColumn("rep", F.xxhash64("source", "bones", "lat", "lon")).join(ends, "rep", "left_semi").select("source", "place_id")


@query(f"SELECT overture_id AS match, unnest(['overture', 'fsq']) AS source, unnest([overture_id, fsq_id]) AS place_id FROM ({ORACLE['mutual_best_round']}) ORDER BY match, source")
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SR-12: the two records of a match one below the other"""
    m = mutual_best_round(spark, d)
    both = F.array(F.struct(F.lit("overture").alias("source"), F.col("overture_id").alias("place_id")), F.struct(F.lit("fsq").alias("source"), F.col("fsq_id").alias("place_id")))
    return m.select(F.col("overture_id").alias("match"), F.explode(both).alias("x")).select("match", "x.*").orderBy("match", "source")


@query(f"WITH {PLACES_SQL} SELECT source, place_id, name, category, NULL AS path FROM vp WHERE source = 'overture' UNION ALL SELECT source, place_id, name, NULL, category FROM vp WHERE source = 'fsq'")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """ST-01: sources of different columns as one table; a column that one lacks is null there"""
    p = valid_places(spark, d)
    o = p.filter("source = 'overture'").select("source", "place_id", "name", "category")
    f = p.filter("source = 'fsq'").select("source", "place_id", "name", F.col("category").alias("path"))
    return o.unionByName(f, allowMissingColumns=True)


@query(f"""WITH {POINTS_SQL}, k AS (SELECT source, list_sort(list(DISTINCT category)) al, list(DISTINCT category) FILTER (len(groups) > 0) mapped FROM pt WHERE category IS NOT NULL GROUP BY 1)
SELECT source, len(al) AS categories, array_to_string(list_filter(al, lambda x: NOT list_contains(mapped, x)), '|') AS unmapped FROM k""")
def unmapped_categories(spark: SparkSession, d: str) -> DataFrame:
    """ST-05: a source's categories without those that belong to a group"""
    c = points(spark, d).dropna(subset=["category"]).groupBy("source", "category").agg(F.max(F.size("groups")).alias("n"))
    k = c.groupBy("source").agg(F.array_sort(F.collect_set("category")).alias("al"), F.collect_set(F.when(F.col("n") > 0, F.col("category"))).alias("mapped"))  # a vocabulary
    return k.select("source", F.size("al").cast("bigint").alias("categories"), F.array_join(F.array_except("al", "mapped"), "|").alias("unmapped"))


@F.pandas_udf(StringType())
def folded(c: pd.Series) -> pd.Series:
    """NFKC, lower case, punctuation as blanks, blanks reduced; null for null."""
    return pd.Series([None if not isinstance(x, str) else " ".join("".join(ch if ch.isalnum() else " " for ch in unicodedata.normalize("NFKC", x).lower()).split()) for x in c], dtype="object")


@query()
def equal_when_folded(spark: SparkSession, d: str) -> DataFrame:
    """SCL-08: names that differ as typed and are equal once folded"""
    n = valid_places(spark, d).select("name").dropna().dropDuplicates().withColumn("folded", folded("name")).filter(F.length("folded") > 0)
    return n.groupBy("folded").agg(F.count("*").alias("spellings")).filter("spellings > 1")


@query(f"""WITH hist AS (SELECT h3_index, snapshot_id, max(value) AS value FROM h3_metric_history WHERE metric = 'builtup_pct' AND value BETWEEN 0 AND 100 GROUP BY 1, 2),
z AS (SELECT governorate, arg_max(m, snapshot_id) ground FROM (SELECT governorate, snapshot_id, avg(value) m FROM hist JOIN h3_cell USING (h3_index) WHERE governorate IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT governorate, avg(builtup_pct * coverage_ratio) presence FROM h3_cell WHERE governorate IS NOT NULL GROUP BY 1)
SELECT governorate, round(presence, 6) presence_pct, round(ground, 6) ground_pct, round(presence / nullif(ground, 0), 2) AS ratio, CASE WHEN round(presence / nullif(ground, 0), 2) >= 0.9 THEN 'dense' WHEN presence / nullif(ground, 0) IS NOT NULL THEN 'open' END AS fabric FROM s JOIN z USING (governorate)""")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """AG-41: presence of one table over ground cover of another at its latest epoch, by region"""
    region = table(spark, d, "h3_cell").filter("governorate is not null")
    h = table(spark, d, "h3_metric_history").filter("metric = 'builtup_pct' and value between 0 and 100").groupBy("h3_index", "snapshot_id").agg(F.max("value").alias("value"))
    by = h.join(region.select("h3_index", "governorate"), "h3_index").groupBy("governorate", "snapshot_id").agg(F.avg("value").alias("m"))
    ground = by.groupBy("governorate").agg(F.max_by("m", "snapshot_id").alias("ground"))
    presence = region.groupBy("governorate").agg(F.avg(F.col("builtup_pct") * F.col("coverage_ratio")).alias("presence"))
    ratio = F.round(F.try_divide(F.col("presence"), F.col("ground")), 2)
    fabric = F.when(ratio >= 0.9, "dense").when(ratio.isNotNull(), "open")
    return presence.join(ground, "governorate").select("governorate", F.round("presence", 6).alias("presence_pct"), F.round("ground", 6).alias("ground_pct"), ratio.alias("ratio"), fabric.alias("fabric"))
