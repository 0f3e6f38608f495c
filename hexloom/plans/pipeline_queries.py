"""Queries of the general table operators: what changed, spikes, hot keys, drift, regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.operators.drift import appearing_alternatives, field_changes, unified_records
from hexloom.operators.near import points_in_regions
from hexloom.operators.skew import per_key, with_unit
from hexloom.operators.snapshots import fetch_values, latest_valid, replay_changes, squeezed
from hexloom.operators.spikes import implausible_readings
from hexloom.runtime import table

HOT_SHARE = 0.025


def _place_changes(spark: SparkSession, d: str) -> DataFrame:
    return replay_changes(table(spark, d, "places"), group="source", key=["place_id"], snapshot="snapshot", version="delivered_at", text=[squeezed("name"), F.col("category")], coords=["lat", "lon"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    places = _place_changes(spark, d).select(F.lit("places").alias("tbl"), F.concat_ws(":", "source", "place_id").alias("record_id"), "snapshot", "change")
    history = replay_changes(table(spark, d, "h3_metric_history"), group=None, key=["h3_index", "metric"], snapshot="snapshot_id")
    history = history.select(F.lit("h3_metric_history").alias("tbl"), F.concat_ws(":", "h3_index", "metric").alias("record_id"), F.col("snapshot_id").alias("snapshot"), "change")
    return places.unionByName(history)


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Each change of places with the name and category before and after."""
    places = table(spark, d, "places")
    got = fetch_values(_place_changes(spark, d), places, group="source", key=["place_id"], snapshot="snapshot", version="delivered_at", values=["name", "category", "lat", "lon"])
    return got.select("source", "place_id", "snapshot", "change", F.col("old.name").alias("old_name"), F.col("new.name").alias("new_name"), F.col("old.category").alias("old_category"), F.col("new.category").alias("new_category"))


_VALID = """SELECT source, place_id, snapshot, name, category, lat, lon FROM (
  SELECT *, row_number() OVER (PARTITION BY source, place_id, snapshot ORDER BY delivered_at DESC, name DESC, category DESC) rn
  FROM places) WHERE rn = 1"""

_CHANGES = f"""WITH v AS ({_VALID}),
snaps AS (SELECT source, snapshot, lag(snapshot) OVER w before, lead(snapshot) OVER w after FROM (SELECT DISTINCT source, snapshot FROM places) WINDOW w AS (PARTITION BY source ORDER BY snapshot)),
cur AS (SELECT v.*, before, after FROM v JOIN snaps USING (source, snapshot)),
ch AS (
  SELECT c.source, c.place_id, c.snapshot, CASE WHEN o.place_id IS NULL THEN 'added' ELSE 'changed' END AS change, o.name old_name, c.name new_name, o.category old_category, c.category new_category
  FROM cur c LEFT JOIN v o ON o.source = c.source AND o.place_id = c.place_id AND o.snapshot = c.before
  WHERE c.before IS NOT NULL AND (o.place_id IS NULL
    OR trim(regexp_replace(o.name, '\\s+', ' ', 'g')) IS DISTINCT FROM trim(regexp_replace(c.name, '\\s+', ' ', 'g'))
    OR o.category IS DISTINCT FROM c.category
    OR (o.lat IS NULL) <> (c.lat IS NULL) OR (o.lon IS NULL) <> (c.lon IS NULL)
    OR coalesce(abs(o.lat - c.lat) > 0.000010001, false) OR coalesce(abs(o.lon - c.lon) > 0.000010001, false))
  UNION ALL
  SELECT o.source, o.place_id, o.after, 'removed', o.name, NULL, o.category, NULL
  FROM cur o LEFT JOIN v c ON o.source = c.source AND o.place_id = c.place_id AND c.snapshot = o.after
  WHERE o.after IS NOT NULL AND c.place_id IS NULL)"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_reasons(spark, d).select("h3_index", "metric", "snapshot_id")


def _impossible(metric: str, v: np.ndarray) -> np.ndarray:
    bad = (v < 0) | np.isinf(v)
    if metric == "builtup_pct":
        bad |= v > 100
    if metric.startswith("business_count"):
        bad |= v != np.floor(v)
    return bad


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(
        table(spark, d, "h3_metric_history"), series=["h3_index", "metric"], kind="metric", order="snapshot_id", value="value", version="written_at",
        impossible=_impossible, stuck_for=lambda metric: metric in ("population", "builtup_pct"),
    )


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """How often the snapshot turns from one row of a cell to the next, as delivered."""
    rows = with_unit(table(spark, d, "places"), ["h3_res9", "snapshot"])
    return per_key(rows, "h3_res9", ordered="snapshot").select("h3_res9", "n_rows", "n_turns")


def _cell_results(spark: SparkSession, d: str) -> DataFrame:
    rows = with_unit(table(spark, d, "places"), ["h3_res9", "source", "place_id", "dup_suspected"])
    return per_key(rows, "h3_res9", members=["source", "place_id"], sums={"n_suspected": F.col("dup_suspected").cast("bigint"), "n_fsq": (F.col("source") == "fsq").cast("bigint")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "places")
    total = places.agg(F.count("*").alias("_all"))  # one row
    cells = per_key(with_unit(places, ["h3_res9"]), "h3_res9")
    return cells.join(F.broadcast(total), F.col("n_rows") >= F.col("_all") * HOT_SHARE).select("h3_res9")


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every cell beside its flag for distorted density."""
    flags = table(spark, d, "h3_cell").select(F.col("h3_index").alias("h3_res9"), "density_distorted").groupBy("h3_res9").agg(F.max("density_distorted").alias("density_distorted"))
    cells = _cell_results(spark, d).join(flags, "h3_res9", "left")
    return cells.select("h3_res9", "n_rows", F.col("n_members").alias("n_places"), "n_suspected", "n_fsq", "density_distorted")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return field_changes(table(spark, d, "raw_place_files"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return unified_records(table(spark, d, "raw_place_files"))


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Types that appear at a path of a feed beside those it had."""
    return appearing_alternatives(table(spark, d, "raw_place_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    points = latest_valid(table(spark, d, "places"), group="source", key="place_id", snapshot="snapshot", version="delivered_at", values=["lat", "lon"])
    return points_in_regions(points, table(spark, d, "near_areas"), key="place_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p2_found, p2_reasons, p4_found, p4_cells, p4_turns, p5_found, p5_table, p5_alternatives, p7_found)}

_RING = "[{'a': ring[i], 'b': ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END]} for i in range(1, len(ring) + 1)]"

_SPIKES = """WITH r AS (SELECT h3_index, metric, snapshot_id, arg_max(value, (written_at, value)) FILTER (value IS NOT NULL) AS value FROM h3_metric_history GROUP BY ALL),
f AS (SELECT *, value IS NOT NULL AND NOT isnan(value) AS known, coalesce(value < 0 OR isinf(value) OR (metric = 'builtup_pct' AND value > 100) OR (starts_with(metric, 'business_count') AND value <> floor(value)), false) AS bad FROM r),
s AS (SELECT h3_index, metric, list(value ORDER BY snapshot_id) v, list(snapshot_id ORDER BY snapshot_id) t FROM f WHERE known AND NOT bad GROUP BY ALL),
u AS (SELECT *, len(v) n, list_aggregate([abs(v[i + 1] - v[i]) for i in range(1, len(v)) if v[i + 1] <> v[i]], 'median') AS unit FROM s),
w AS (SELECT h3_index, metric, v, t, n, unit, a, a + k AS b, list_aggregate(v[greatest(1, a - 4):a - 1], 'median') lo, list_aggregate(v[a + k + 1:a + k + 4], 'median') hi
  FROM (SELECT *, unnest(range(1, n + 1)) a FROM u WHERE unit > 0), (SELECT unnest([0, 1]) k) WHERE a > 3 AND a + k + 3 <= n),
x AS (SELECT *, CASE WHEN v[a] > lo THEN 1 ELSE -1 END sg FROM w),
y AS (SELECT * FROM x WHERE sg * (v[a] - lo) > 10 * unit AND sg * (v[a] - hi) > 10 * unit AND sg * (v[b] - lo) > 10 * unit AND sg * (v[b] - hi) > 10 * unit
  AND NOT (sg * (v[a - 1] - lo) > 10 * unit AND sg * (v[a - 1] - hi) > 10 * unit) AND NOT (sg * (v[b + 1] - lo) > 10 * unit AND sg * (v[b + 1] - hi) > 10 * unit)),
p AS (SELECT h3_index, metric, t[i] snapshot_id, v[i] AS value, i, n, i - row_number() OVER (PARTITION BY h3_index, metric, v[i] ORDER BY i) AS island FROM (SELECT *, unnest(range(1, n + 1)) i FROM u WHERE metric IN ('population', 'builtup_pct'))),
g AS (SELECT *, count(*) OVER (PARTITION BY h3_index, metric, value, island) len, min(i) OVER (PARTITION BY h3_index, metric, value, island) st FROM p),
q AS (SELECT h3_index, metric, sum(len - 1) same FROM (SELECT DISTINCT h3_index, metric, value, island, len FROM g) GROUP BY ALL)"""

_LEAVES = """ok AS (SELECT raw_id, feed, snapshot, payload::JSON p FROM raw_place_files WHERE feed IS NOT NULL AND snapshot IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
lv AS (SELECT raw_id, feed, snapshot, substr(t.fullkey, 3) path, CASE t.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END kind, t.value v FROM ok, json_tree(ok.p) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[')),
fl AS (SELECT feed, snapshot, row_number() OVER w n, lag(snapshot) OVER w AS before, lead(snapshot) OVER w AS after FROM (SELECT DISTINCT feed, snapshot FROM raw_place_files WHERE feed IS NOT NULL AND snapshot IS NOT NULL) WINDOW w AS (PARTITION BY feed ORDER BY snapshot)),
ct AS (SELECT feed, snapshot, path, count(*) n_all, count(*) FILTER (kind = 'string') ns, count(*) FILTER (kind = 'number') nn, count(*) FILTER (kind = 'boolean') nb, count(*) FILTER (kind = 'array') na FROM lv GROUP BY 1, 2, 3)"""
_EVENTS = f"""{_LEAVES},
ats AS (SELECT c.feed, c.snapshot, c.path, f.n, f.before, f.after, CASE WHEN ns >= 0.9 * n_all THEN 'string' WHEN nn >= 0.9 * n_all THEN 'number' WHEN nb >= 0.9 * n_all THEN 'boolean' WHEN na >= 0.9 * n_all THEN 'array' END kind FROM ct c JOIN fl f USING (feed, snapshot)),
aw AS (SELECT *, coalesce(lag(n) OVER w = n - 1, false) met, lag(kind) OVER w pk, coalesce(lead(n) OVER w = n + 1, false) stays FROM ats WINDOW w AS (PARTITION BY feed, path ORDER BY n)),
ev AS (SELECT feed, snapshot, before, path, 'added' change FROM aw WHERE before IS NOT NULL AND NOT met UNION ALL SELECT feed, snapshot, before, path, 'type' FROM aw WHERE met AND kind <> pk UNION ALL SELECT feed, after, snapshot, path, 'removed' FROM aw WHERE after IS NOT NULL AND NOT stays),
rec AS (SELECT lv.feed, lv.snapshot, i.v AS id, lv.path, max(lv.kind || ':' || CASE WHEN lv.kind = 'number' THEN (lv.v::VARCHAR::DOUBLE)::VARCHAR ELSE lv.v::VARCHAR END) val FROM lv JOIN (SELECT raw_id, v::VARCHAR v FROM lv WHERE path = 'id') i USING (raw_id) GROUP BY 1, 2, 3, 4),
ids AS (SELECT DISTINCT feed, snapshot, id FROM rec),
steps AS (SELECT DISTINCT feed, snapshot, before FROM ev),
pair AS (SELECT s.feed, s.snapshot, s.before, a.id FROM steps s JOIN ids a ON a.feed = s.feed AND a.snapshot = s.snapshot JOIN ids b ON b.feed = s.feed AND b.snapshot = s.before AND b.id = a.id),
olds AS (SELECT b.feed, b.snapshot, b.id, r.path, r.val FROM pair b JOIN ev e ON e.feed = b.feed AND e.snapshot = b.snapshot AND e.change = 'removed' JOIN rec r ON r.feed = b.feed AND r.snapshot = b.before AND r.id = b.id AND r.path = e.path),
news AS (SELECT b.feed, b.snapshot, b.id, r.path, r.val FROM pair b JOIN ev e ON e.feed = b.feed AND e.snapshot = b.snapshot AND e.change = 'added' JOIN rec r ON r.feed = b.feed AND r.snapshot = b.snapshot AND r.id = b.id AND r.path = e.path),
sm AS (SELECT o.feed, o.snapshot, o.path old_field, n.path field, count(*) same FROM olds o JOIN news n ON o.feed = n.feed AND o.snapshot = n.snapshot AND o.id = n.id AND o.val = n.val GROUP BY 1, 2, 3, 4),
sc AS (SELECT sm.*, same / greatest(no, nn)::DOUBLE share FROM sm JOIN (SELECT feed, snapshot, path old_field, count(*) no FROM olds GROUP BY 1, 2, 3) USING (feed, snapshot, old_field) JOIN (SELECT feed, snapshot, path field, count(*) nn FROM news GROUP BY 1, 2, 3) USING (feed, snapshot, field)),
rn AS (SELECT feed, snapshot, old_field, field FROM (SELECT *, row_number() OVER (PARTITION BY feed, snapshot, old_field ORDER BY share DESC, same DESC, field) a, row_number() OVER (PARTITION BY feed, snapshot, field ORDER BY share DESC, same DESC, old_field) b FROM sc WHERE share >= 0.8 AND same >= 2) WHERE a = 1 AND b = 1)"""

ORACLE = {
    "p5_found": f"""WITH {_EVENTS} SELECT feed, snapshot, path AS field, '' AS old_field, change FROM ev WHERE NOT EXISTS (FROM rn WHERE rn.feed = ev.feed AND rn.snapshot = ev.snapshot AND (ev.change = 'removed' AND rn.old_field = ev.path OR ev.change = 'added' AND rn.field = ev.path))
UNION ALL SELECT feed, snapshot, field, old_field, 'renamed' FROM rn""",
    "p5_alternatives": f"""WITH {_LEAVES}, k AS (SELECT feed, snapshot, path field, n_all, unnest(['string', 'number', 'boolean', 'array']) alternative, unnest([ns, nn, nb, na]) n FROM ct), w AS (SELECT *, lag(n) OVER (PARTITION BY feed, field, alternative ORDER BY snapshot) was FROM k)
SELECT feed, snapshot, field, alternative, n AS "values", n_all AS "of" FROM w WHERE n > 0 AND was = 0""",
    "p1_found": _CHANGES
    + """,
hs AS (SELECT snapshot_id, lag(snapshot_id) OVER w before, lead(snapshot_id) OVER w after FROM (SELECT DISTINCT snapshot_id FROM h3_metric_history) WINDOW w AS (ORDER BY snapshot_id)),
h AS (SELECT DISTINCT h3_index, metric, snapshot_id, before, after FROM h3_metric_history JOIN hs USING (snapshot_id))
SELECT 'places' AS tbl, source || ':' || place_id AS record_id, snapshot, change FROM ch
UNION ALL SELECT 'h3_metric_history', h3_index || ':' || metric, snapshot_id, 'added' FROM h a WHERE before IS NOT NULL AND NOT EXISTS (FROM h b WHERE b.h3_index = a.h3_index AND b.metric = a.metric AND b.snapshot_id = a.before)
UNION ALL SELECT 'h3_metric_history', h3_index || ':' || metric, after, 'removed' FROM h a WHERE after IS NOT NULL AND NOT EXISTS (FROM h b WHERE b.h3_index = a.h3_index AND b.metric = a.metric AND b.snapshot_id = a.after)""",
    "p1_values": _CHANGES + " SELECT * FROM ch",
    "p2_found": _SPIKES + """
SELECT h3_index, metric, snapshot_id FROM f WHERE known AND bad
UNION SELECT h3_index, metric, t[a] FROM y UNION SELECT h3_index, metric, t[b] FROM y
UNION SELECT h3_index, metric, snapshot_id FROM g JOIN q USING (h3_index, metric) WHERE len >= 5 AND n - len >= 5 AND (same - (len - 1)) / (n - len)::DOUBLE <= 0.34""",
    "p2_reasons": _SPIKES + """, e AS (
SELECT h3_index, metric, snapshot_id, 1 AS k FROM f WHERE known AND bad UNION ALL SELECT h3_index, metric, t[a], 3 FROM y UNION ALL SELECT h3_index, metric, t[b], 3 FROM y
UNION ALL SELECT h3_index, metric, snapshot_id, 2 FROM g JOIN q USING (h3_index, metric) WHERE len >= 5 AND n - len >= 5 AND (same - (len - 1)) / (n - len)::DOUBLE <= 0.34)
SELECT h3_index, metric, snapshot_id, CASE min(k) WHEN 1 THEN 'impossible' WHEN 2 THEN 'stuck' ELSE 'spike' END AS reason FROM e GROUP BY 1, 2, 3""",
    "p4_found": "SELECT h3_res9 FROM places WHERE h3_res9 IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.025 * (SELECT count(*) FROM places)",
    "p4_cells": """SELECT h3_res9, count(*) n_rows, count(DISTINCT source || ':' || place_id) n_places, sum(dup_suspected::INT)::BIGINT n_suspected, sum((source = 'fsq')::INT)::BIGINT n_fsq, any_value(density_distorted) density_distorted
FROM places LEFT JOIN (SELECT h3_index h3_res9, max(density_distorted) density_distorted FROM h3_cell GROUP BY 1) USING (h3_res9) WHERE h3_res9 IS NOT NULL GROUP BY 1""",
    "p4_turns": """WITH o AS (SELECT *, row_number() OVER () AS n FROM places), t AS (SELECT h3_res9, snapshot IS DISTINCT FROM lag(snapshot) OVER w AS turn, row_number() OVER w AS k FROM o WHERE h3_res9 IS NOT NULL WINDOW w AS (PARTITION BY h3_res9 ORDER BY n))
SELECT h3_res9, count(*) AS n_rows, count(*) FILTER (turn AND k > 1) AS n_turns FROM t GROUP BY 1""",
    "p7_found": f"""WITH last AS (SELECT source, max(snapshot) snapshot FROM places GROUP BY 1),
p AS (SELECT * FROM (SELECT place_id, lat, lon, row_number() OVER (PARTITION BY source, place_id ORDER BY delivered_at DESC) rn FROM places JOIN last USING (source, snapshot)) WHERE rn = 1 AND lat IS NOT NULL AND lon IS NOT NULL),
a AS (SELECT area_id, kind, lat alat, lon alon, radius_m, CASE WHEN kind = 'polygon' THEN {_RING} END edges FROM near_areas)
SELECT area_id, place_id FROM a JOIN p ON CASE WHEN kind = 'circle'
  THEN 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(lat - alat) / 2), 2) + cos(radians(lat)) * cos(radians(alat)) * pow(sin(radians(lon - alon) / 2), 2)))) <= radius_m
  ELSE len([1 for e in edges if (e.a.lat > lat) <> (e.b.lat > lat) AND lon < (e.b.lon - e.a.lon) * (lat - e.a.lat) / nullif(e.b.lat - e.a.lat, 0) + e.a.lon]) % 2 = 1 END""",
}
