"""Data checks, duplicates and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions import categories as cat
from hexloom.functions import text as X
from hexloom.operators import dedup as D
from hexloom.operators import metrics as M
from hexloom.plans.base import CELLS_SQL, PLACES_SQL, POINTS_SQL, cells, points, query, valid_places
from hexloom.runtime import table

_HAV = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH {PLACES_SQL} SELECT source, place_id, {cat.SQL_NOT_STOREFRONT} AS not_storefront, {cat.SQL_NOT_STOREFRONT_PLAIN} AS not_storefront_plain FROM vp")
def storefront_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05, FLT-06"""
    s, c, n = F.col("source"), F.col("category"), F.col("name")
    return valid_places(spark, d).select("source", "place_id", cat.not_storefront(s, c, n).alias("not_storefront"), cat.not_storefront_plain(c, n).alias("not_storefront_plain"))


@query(f"WITH {PLACES_SQL}, bad AS (SELECT DISTINCT source, name, lat, lon FROM vp WHERE {cat.SQL_NOT_STOREFRONT}) SELECT source, place_id FROM vp WHERE NOT EXISTS (FROM bad WHERE bad.source IS NOT DISTINCT FROM vp.source AND bad.name IS NOT DISTINCT FROM vp.name AND bad.lat IS NOT DISTINCT FROM vp.lat AND bad.lon IS NOT DISTINCT FROM vp.lon)")
def storefront_places(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07, JN-05: all rows that share source, name and place with one that is none go"""
    p = valid_places(spark, d)
    bad = p.filter(cat.not_storefront(F.col("source"), F.col("category"), F.col("name"))).select("source", "name", "lat", "lon").dropDuplicates()
    same = None
    for c in ("source", "name", "lat", "lon"):
        one = p[c].eqNullSafe(bad[c])
        same = one if same is None else same & one
    return p.join(bad, same, "left_anti").select("source", "place_id")


@query(f"WITH {PLACES_SQL} SELECT h3_res8, count(*) AS n FROM vp WHERE h3_res8 IS NOT NULL AND source = 'overture' AND {cat.SQL_NOT_STOREFRONT} GROUP BY 1 HAVING count(*) >= {T.distortion_min}")
def density_distortion(spark: SparkSession, d: str) -> DataFrame:
    """AG-22: areas with many rows of the first source that are no storefront"""
    bad = cat.not_storefront(F.col("source"), F.col("category"), F.col("name"))
    p = valid_places(spark, d).filter((F.col("source") == "overture") & bad).dropna(subset=["h3_res8"])
    return p.groupBy("h3_res8").agg(F.count("*").alias("n")).filter(F.col("n") >= T.distortion_min)


@query(f"WITH {POINTS_SQL} SELECT round(lat, 5) AS lat, round(lon, 5) AS lon, count(*) AS n, count(DISTINCT name) AS names FROM pt GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT name) >= 3")
def coordinate_collapse(spark: SparkSession, d: str) -> DataFrame:
    """WN-02, AG-21: coordinates that hold several different names"""
    p = points(spark, d).select(F.round("lat", T.collapse_decimals).alias("lat"), F.round("lon", T.collapse_decimals).alias("lon"), "name")
    # Names first, so that a crowded coordinate is spread by name.
    n = p.groupBy("lat", "lon", "name").agg(F.count("*").alias("n")).groupBy("lat", "lon").agg(F.sum("n").alias("n"), F.count("name").alias("names"))
    return n.filter((F.col("n") >= T.collapse_group) & (F.col("names") >= T.collapse_group))


@query(f"WITH {POINTS_SQL} SELECT a.source, a.place_id, count(b.place_id) AS n_near FROM pt a LEFT JOIN pt b ON a.source <> b.source AND abs(a.lat - b.lat) <= 0.001 AND abs(a.lon - b.lon) <= 0.001 AND {_HAV} <= 40 GROUP BY ALL")
def dup_candidates_blocked(spark: SparkSession, d: str) -> DataFrame:
    """JN-08 without names, ST-07: every place with its number of neighbours of the other source"""
    return D.neighbours(points(spark, d), T.duplicate_m, across=True)


@query(f"WITH {POINTS_SQL} SELECT a.source, a.place_id, count(b.place_id) AS n_near FROM pt a LEFT JOIN pt b ON a.place_id <> b.place_id AND abs(a.lat - b.lat) <= 0.0005 AND abs(a.lon - b.lon) <= 0.0005 AND {_HAV} <= 20 GROUP BY ALL")
def grid_bucket_links(spark: SparkSession, d: str) -> DataFrame:
    """JN-11: links within 20 m by squares"""
    return D.neighbours(points(spark, d), 20.0, across=False)


@query()
def dup_flags_named(spark: SparkSession, d: str) -> DataFrame:
    """JN-08, FLT: near, of the other source and alike in name"""
    return D.flagged_records(points(spark, d), T.duplicate_m, T.duplicate_similarity, across=True)


@query()
def intra_source_dups(spark: SparkSession, d: str) -> DataFrame:
    """JN-09, JN-10: near, of one source and alike in name"""
    return D.flagged_records(points(spark, d), T.intra_m, T.duplicate_similarity, across=False)


_NORM = X.sql_normalize("name")
#: Variants of a name in SQL: the parts between bars, and runs of one script in them.
_VARIANTS = """list_sort(list_distinct(list_filter(list_concat(list_transform(string_split(name, '|'), lambda x: trim(x)),
  list_filter(list_transform(flatten(list_transform(string_split(name, '|'), lambda x: regexp_extract_all(trim(x), '[A-Za-z0-9][A-Za-z0-9\\s&''\\-]*|[؀-ۿ][؀-ۿ\\s]*'))), lambda x: trim(x)), lambda x: length(x) >= 4)), lambda x: x <> '')))"""
_SPELT = f"array_to_string(list_sort(list_distinct(list_filter(list_transform({_VARIANTS}, lambda name: {_NORM}), lambda x: x <> ''))), '|')"


@query(f"""WITH RECURSIVE {POINTS_SQL}, n AS (SELECT place_id, {_SPELT} norm, lat, lon FROM pt WHERE name IS NOT NULL), o AS (SELECT * FROM n WHERE length(norm) > 0),
e AS (SELECT a.place_id a, b.place_id b FROM o a JOIN o b ON a.norm = b.norm AND a.place_id <> b.place_id AND abs(a.lat - b.lat) <= 0.0005 AND abs(a.lon - b.lon) <= 0.0005 AND {_HAV} <= 20),
reach(id, root) AS (SELECT place_id, place_id FROM o UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id)
SELECT id AS place_id, min(root) AS cluster FROM reach GROUP BY 1""")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """AG-23"""
    return D.clusters(points(spark, d), 20.0)


def _near(spark: SparkSession, d: str, metres: float) -> DataFrame:
    p = points(spark, d)
    side = lambda s: p.filter(F.col("source") == s).select(F.col("place_id").alias("rep"), "lat", "lon")
    return D.near_pairs(side("overture"), side("fsq"), metres)


@query(f"""WITH {POINTS_SQL}, c AS (SELECT a.place_id l_rep, b.place_id r_rep, round({_HAV}, 6) metres FROM pt a JOIN pt b ON a.source = 'overture' AND b.source = 'fsq' AND abs(a.lat - b.lat) <= 0.0005 AND abs(a.lon - b.lon) <= 0.0005 AND {_HAV} <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY l_rep ORDER BY metres, l_rep, r_rep) x, row_number() OVER (PARTITION BY r_rep ORDER BY metres, l_rep, r_rep) y FROM c)
SELECT l_rep AS overture_id, r_rep AS fsq_id FROM k WHERE x = 1 AND y = 1""")
def mutual_best_round(spark: SparkSession, d: str) -> DataFrame:
    """JN-13, one round by distance"""
    pairs = _near(spark, d, 20.0).withColumn("metres", F.round("metres", 6))
    return D.mutual_best(pairs, "l_rep", "r_rep", ["metres", "l_rep", "r_rep"]).select(F.col("l_rep").alias("overture_id"), F.col("r_rep").alias("fsq_id"))


@query()
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """JN-13: one-to-one, the most alike first"""
    got = D.matched(points(spark, d), "overture", "fsq", T.duplicate_m, T.duplicate_similarity)
    return got.select(F.col("l_id").alias("overture_id"), F.col("r_id").alias("fsq_id"), F.round("metres", 3).alias("metres"), F.round("likeness", 6).alias("likeness"))


@query(f"""WITH {CELLS_SQL}, m AS ({M.sql_business_counts('q, r', 'pt')}), p AS (SELECT pq, pr, metric, max(value) mx, sum(value) sm FROM m JOIN cell USING (q, r) GROUP BY ALL)
SELECT metric, count(*) AS parents, round(avg((coalesce(mx / nullif(sm, 0) >= 0.99, false))::INT), 6) AS carrier_share, CASE WHEN count(*) < 50 THEN 'too few' WHEN avg((coalesce(mx / nullif(sm, 0) >= 0.99, false))::INT) >= 0.9 THEN 'fail' WHEN avg((coalesce(mx / nullif(sm, 0) >= 0.99, false))::INT) >= 0.6 THEN 'warn' ELSE 'pass' END AS verdict FROM p GROUP BY 1""")
def carrier_check(spark: SparkSession, d: str) -> DataFrame:
    """AG-26: values that one child carries for its parent"""
    pts = points(spark, d)
    m = M.business_counts(pts, ["q", "r"]).join(cells(spark, d, pts).select("q", "r", "pq", "pr"), ["q", "r"])
    p = m.groupBy("pq", "pr", "metric").agg(F.coalesce(F.try_divide(F.max("value"), F.sum("value")) >= T.carrier_share, F.lit(False)).cast("int").alias("one"))
    share = F.avg("one")
    verdict = F.when(F.count("*") < T.carrier_min_parents, "too few").when(share >= T.carrier_fail, "fail").when(share >= T.carrier_warn, "warn").otherwise("pass")
    return p.groupBy("metric").agg(F.count("*").alias("parents"), F.round(share, 6).alias("carrier_share"), verdict.alias("verdict"))


_WORDS = ", ".join(f"'{w}'" for w in X.GENERIC)


@query(f"""WITH {PLACES_SQL}, n AS (SELECT DISTINCT name, {_NORM} norm FROM vp WHERE name IS NOT NULL), k AS (SELECT *, list_filter(string_split(norm, ' '), lambda w: length(w) > 1 AND w NOT IN ({_WORDS}) AND regexp_replace(w, '[aeiou]', '', 'g') NOT IN ({_WORDS})) kept FROM n)
SELECT name, norm, regexp_replace(norm, '[aeiou\\s]', '', 'g') AS bones, array_to_string(kept, ' ') AS distinctive FROM k""")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    """SCL-01, SCL-02, SCL-04"""
    n = valid_places(spark, d).select("name").dropna().dropDuplicates().withColumn("norm", X.normalize(F.col("name")))
    return n.select("name", "norm", X.skeleton(F.col("norm")).alias("bones"), X.strip_generic(F.col("norm")).alias("distinctive"))


@query(f"""WITH {PLACES_SQL} SELECT DISTINCT name, array_to_string({_VARIANTS}, '|') AS variants, {_SPELT} AS spellings FROM vp WHERE name IS NOT NULL""")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    """SCL-03, ST-06: spellings in one field, by bars and scripts, as the matchers compare them"""
    n = valid_places(spark, d).select("name").dropna().dropDuplicates()
    return n.select("name", F.array_join(F.array_sort(X.variants(F.col("name"))), "|").alias("variants"), X.spellings(F.col("name")).alias("spellings"))


@query("""WITH p AS (SELECT DISTINCT pair_id, lower(name_a) a, lower(name_b) b FROM dup_triage_sample WHERE length(name_a) > 1 AND length(name_b) > 1),
g AS (SELECT pair_id, list_distinct([substr(a, i, 2) for i in range(1, length(a))]) ga, list_distinct([substr(b, i, 2) for i in range(1, length(b))]) gb FROM p)
SELECT pair_id, len(list_intersect(ga, gb)) AS shared, round(len(list_intersect(ga, gb))::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS jaccard FROM g""")
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SCL-09"""
    p = table(spark, d, "dup_triage_sample").select("pair_id", F.lower("name_a").alias("a"), F.lower("name_b").alias("b")).filter((F.length("a") > 1) & (F.length("b") > 1)).dropDuplicates()
    p = p.select("pair_id", X.bigrams(F.col("a")).alias("ga"), X.bigrams(F.col("b")).alias("gb"))
    same = F.size(F.array_intersect("ga", "gb"))
    return p.select("pair_id", same.cast("bigint").alias("shared"), F.round(same / (F.size("ga") + F.size("gb") - same), 6).alias("jaccard"))


@query()
def name_similarity_eval(spark: SparkSession, d: str) -> DataFrame:
    """AG-27, SCL-05 to SCL-07: our likeness against the delivered score, by threshold"""
    p = table(spark, d, "dup_triage_sample").select("pair_id", "name_a", "name_b", "name_sim").dropna().dropDuplicates(["pair_id"])
    p = p.withColumn("own", X.name_likeness(X.spellings(F.col("name_a")), X.spellings(F.col("name_b"))))
    p = p.withColumn("t", F.explode(F.array(*[F.lit(v) for v in (0.6, 0.72, 0.8, 0.9)])))
    a, b = F.col("own") >= F.col("t"), F.col("name_sim") >= F.col("t")
    n = p.groupBy("t").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_own"), F.count_if(~a & b).alias("only_given"), F.count_if(~a & ~b).alias("neither"))
    return n.select(F.col("t").alias("threshold"), "both", "only_own", "only_given", "neither", F.round(F.try_divide(F.col("both"), F.col("both") + F.col("only_own")), 6).alias("precision"), F.round(F.try_divide(F.col("both"), F.col("both") + F.col("only_given")), 6).alias("recall"))


@query("""SELECT band, count(*) AS n, count(*) FILTER (name_sim >= 0.8) AS good, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high
FROM (SELECT *, count(*) OVER (PARTITION BY band)::DOUBLE n, avg((coalesce(name_sim >= 0.8, false))::INT) OVER (PARTITION BY band) p FROM (SELECT DISTINCT pair_id, band, name_sim FROM dup_triage_sample)) GROUP BY band, n, p""".replace("count(*) AS n,", "count(*) AS total,"))
def wilson_precision(spark: SparkSession, d: str) -> DataFrame:
    """AG-35"""
    p = table(spark, d, "dup_triage_sample").select("pair_id", "band", "name_sim").dropDuplicates()
    g = p.groupBy("band").agg(F.count("*").alias("total"), F.count_if(F.col("name_sim") >= 0.8).alias("good"))
    n, q = F.col("total").cast("double"), F.col("good") / F.col("total")
    half = 1.96 * F.sqrt(q * (1 - q) / n + 0.9604 / (n * n))
    return g.select("band", "total", "good", F.round((q + 1.9208 / n - half) / (1 + 3.8416 / n), 6).alias("low"), F.round((q + 1.9208 / n + half) / (1 + 3.8416 / n), 6).alias("high"))
