import json

import pytest
from pyspark.sql import functions as F

from hexloom.operators import sampling
from hexloom.operators.search import Search
from hexloom.operators.series import open_as_of, with_artifacts
from hexloom.operators.dedup import greedy_match
from hexloom.sources import readers, sinks
from hexloom.streaming.snapshots import arrivals, ingest, ingested, with_gaps


def test_archive_is_written_once(spark, tmp_path):
    base = f"file://{tmp_path}/a"
    df = spark.range(5).withColumn("v", F.lit("x"))
    first = sinks.archive_snapshot(df, base, "src", "2024-01", least_rows=3)
    assert sinks.archive_snapshot(df.limit(1), base, "src", "2024-01") == first and first["rows"] == 5
    with pytest.raises(ValueError):
        sinks.archive_snapshot(df.limit(1), base, "src", "2024-02", least_rows=3)
    sinks.archive_snapshot(df, base, "src", "2024-03")
    assert readers.latest_snapshot(spark, base) == "2024-03"
    assert readers.snapshots(spark, base, ["id"]).filter("snapshot = '2024-01'").count() == 5
    assert readers.latest_snapshot(spark, base + "none") is None


def test_facts_replace_their_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    mk = lambda rows: spark.createDataFrame(rows, "res int, metric string, v int")
    sinks.write_facts(mk([(8, "a", 1), (8, "b", 1)]), path)
    sinks.write_facts(mk([(8, "b", 2)]), path, sort="v")
    assert sorted((r.metric, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_schema_variants(spark):
    new = lambda t: spark.createDataFrame([], t)
    alpha = new("categories struct<main:string,alternate:array<string>>, bbox struct<minx:double,miny:double,maxx:double,maxy:double>")
    both = new("categories struct<primary:string>, taxonomy struct<primary:string>, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    assert "categories.main" in str(readers.category_of(alpha)) and "categories.primary" in str(readers.category_of(both))
    assert "taxonomy.primary" in str(readers.category_of(new("taxonomy struct<primary:string>")))
    with pytest.raises(LookupError):
        readers.category_of(new("names struct<primary:string>"))
    assert "minx" in str(readers.box_of(alpha)[0]) and "xmin" in str(readers.box_of(both)[0])
    with pytest.raises(LookupError):
        readers.box_of(new("bbox struct<a:double>"))


def test_nested_box_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/b"
    spark.createDataFrame([((1.0, 1.0, 2.0, 2.0), "x"), ((5.0, 5.0, 6.0, 6.0), "y")], "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, n string").write.parquet(path)
    got = readers.in_bbox(spark.read.parquet(path), 0, 0, 3, 3).select("n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmin" in plan.split("PushedFilters")[1] and [r.n for r in got.collect()] == ["x"]


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('# note\nname,v\n"a, ""b""\nline",1\n# more\nc,2\n')
    assert [tuple(r) for r in readers.commented_csv(spark, f"file://{tmp_path}/c.csv").collect()] == [('a, "b"\nline', "1"), ("c", "2")]
    rel = [{"tags": {"name": "g"}, "members": [{"role": "outer", "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 3.0, "lon": 4.0}]}, {"role": "inner", "geometry": [{"lat": 9.0, "lon": 9.0}]}]}]
    (tmp_path / "r.json").write_text(json.dumps(rel))
    assert [(r.name, r.lon, r.lat) for r in readers.rings(spark, f"file://{tmp_path}/r.json").orderBy("n").collect()] == [("g", 2.0, 1.0), ("g", 4.0, 3.0)]
    assert readers.stitched([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)], [(5, 5), (6, 6)]]) == [[(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 6)]]
    assert len(readers.file_fingerprints(spark, f"file://{tmp_path}/*.csv").first().fingerprint) == 16
    s = spark.createDataFrame([([("x", "a"), ("", "b")],), ([],)], "s array<struct<property:string,dataset:string>>")
    assert [r[0] for r in s.select(readers.record_source(F.col("s"))).collect()] == ["b", "unknown"]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    mk = lambda s, n: spark.range(n).select(F.lit(s).alias("snapshot"), "id").coalesce(1).write.mode("append").parquet(src)
    mk("b", 3)
    run = lambda: ingest(arrivals(spark, src, "snapshot string, id long"), out, cp).awaitTermination()
    run()
    run()
    mk("a", 2)  # an earlier snapshot that comes late
    run()
    assert {r.snapshot: r["count"] for r in ingested(spark, out).groupBy("snapshot").count().collect()} == {"a": 2, "b": 3}
    gaps = spark.createDataFrame([("m", "2024-05", "not published")], "metric string, missing_snapshot string, reason string")
    got = with_gaps(spark.createDataFrame([("m", 1), ("n", 2)], "metric string, v int"), gaps, "metric").collect()
    assert {r.metric: r.gap_note for r in got} == {"m": "2024-05 is missing: not published.", "n": None}


def test_a_short_batch_is_never_seen(spark, tmp_path):
    """Neither a batch under the floor nor one whose manifest is missing is read; a batch that runs again replaces itself."""
    from hexloom import files

    src, out, cp = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    mk = lambda s, n: spark.range(n).select(F.lit(s).alias("snapshot"), "id").coalesce(1).write.mode("append").parquet(src)
    run = lambda least: ingest(arrivals(spark, src, "snapshot string, id long"), out, cp, least_rows=least).awaitTermination()
    mk("a", 5)
    run(3)
    mk("b", 2)
    with pytest.raises(Exception, match="at least 3"):
        run(3)
    assert ingested(spark, out).count() == 5 and files.folders(spark, out) == ["batch=0"]
    run(1)
    assert ingested(spark, out).count() == 7
    spark.range(9).select(F.lit("c").alias("snapshot"), "id").write.partitionBy("snapshot").parquet(f"{out}/batch=7")
    assert ingested(spark, out).count() == 7
    with pytest.raises(FileNotFoundError):
        ingested(spark, src)


def test_unfinished_snapshots_are_not_read(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    df = spark.range(40).select("id", (F.col("id") / 10).alias("lon"), (F.col("id") / 10).alias("lat"), F.lit("x").alias("name"))
    for s in ("1", "2"):
        sinks.archive_snapshot(df.repartition(4, "id"), base, "src", s)
    df.write.parquet(f"{base}/snapshot=3")  # a write that died
    assert readers.published(spark, base) == ["1", "2"] and readers.latest_snapshot(spark, base) == "2" and readers.snapshots(spark, base).count() == 80
    got, plan = readers.catalogue_scan(spark, base, (1.0, 1.0, 2.0, 2.0), ["id", "name"])
    text = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 11 and got.columns == ["id", "name"] and plan["files"] < plan["files_of"] and 0 < plan["bytes"] < plan["bytes_of"]
    assert "GreaterThanOrEqual(lon,1.0)" in text and "_source" not in text


def test_one_collection_over_many_files(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 7).alias("q"), F.col("id").alias("r"), F.format_string('{"type":"Feature","id":%d}', "id").alias("feature"))
    for name, own in (("a", df), ("b", df.limit(0))):
        sinks.write_feature_collection(own, f"file://{tmp_path}/{name}", ["q", "r"])
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        got = json.loads(text)
        assert got["type"] == "FeatureCollection" and len(got["features"]) == own.count()
    assert len(list((tmp_path / "a").glob("part-*"))) > 1
    sinks.write_geojson_lines(df, f"file://{tmp_path}/lines")
    assert spark.read.json(f"file://{tmp_path}/lines").count() == 50


def test_tables_are_held_to_their_schema(spark):
    from hexloom.schemas import held_to

    df = spark.createDataFrame([(1, "a")], "a long, b string")
    assert held_to(df, "a bigint, b string") is df
    with pytest.raises(TypeError, match="b: string, not int"):
        held_to(df, "a bigint, b int")
    with pytest.raises(TypeError, match="c: missing"):
        held_to(df, "a bigint, b string, c int")


def test_tiles_and_hexagons(spark, tmp_path):
    (tmp_path / "t1.txt").write_text("1 2\nnan 4")
    (tmp_path / "t2.txt").write_text("")
    got = readers.tiles(spark, f"file://{tmp_path}/t*.txt", readers.pixel_grid, "tile string, row int, col int, value double")
    assert sorted(map(tuple, got.collect())) == [("t1.txt", 0, 0, 1.0), ("t1.txt", 0, 1, 2.0), ("t1.txt", 1, 1, 4.0)]
    (tmp_path / "m.json").write_text(json.dumps([{"name": n, "xmin": x, "ymin": 0, "xmax": x + 1, "ymax": 1} for n, x in (("a", 0), ("b", 1), ("c", 3))] + [{"name": "d"}]))
    assert sorted(r.name for r in readers.tiles_meeting(spark, f"file://{tmp_path}/m.json", (0.5, 0.5, 1.0, 2.0)).collect()) == ["a", "b"]
    (tmp_path / "pop.csv").write_text("# note\nh3,population\n8928308280FFFFF,12.5\nxyz,3\n8928308280bffff,\n8928308280bfff1,x\n")
    assert [tuple(r) for r in readers.hex_populations(spark, f"file://{tmp_path}/pop.csv").collect()] == [(0x8928308280FFFFF, 12.5)]


def test_late_rows_rebuild_their_series_only(spark):
    from hexloom.streaming.snapshots import recomputed

    rows = [(k, t, float(v)) for k, vs in {"a": [10, 10, 20, 20, 20], "b": [10, 20, 20, 20, 20]}.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    late = spark.createDataFrame([("a", 2), (None, 1)], "k string, t int")
    got = recomputed(df, late, ["k"], lambda d: with_artifacts(d, ["k"], "t", "v")).filter("hit").collect()
    assert [(r.k, r.t) for r in got] == [("a", 2)]


def test_artifacts(spark):
    v = {"jump": [10, 10, 20, 20, 21, 21], "small": [2, 2, 9, 9, 9], "back": [10, 10, 30, 10, 10], "drop": [20, 20, 10, 10, 10]}
    df = spark.createDataFrame([(k, i, float(x)) for k, xs in v.items() for i, x in enumerate(xs)], "k string, t int, v double")
    hits = lambda **o: sorted((r.k, r.t) for r in with_artifacts(df, ["k"], "t", "v", **o).filter("hit").collect())
    assert hits() == [("jump", 2)]
    assert hits(floors=False) == [("drop", 2), ("jump", 2), ("small", 2)]


def test_open_as_of(spark):
    recs = spark.createDataFrame([("2020", None), ("2021", "2022"), (None, "2021"), ("2022", "2022")], "c string, z string")
    spine = spark.createDataFrame([(y,) for y in ("2019", "2021", "2022")], "at string")
    got = {r["at"]: r.n_open for r in open_as_of(recs.dropna(subset=["c"]), spine, "at", "c", "z").collect()}
    assert got == {"2019": 0, "2021": 2, "2022": 1}


def test_greedy_takes_the_best_first(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (2, 11, 0.1), (3, 11, 0.8)], "l long, r long, s double")
    got = sorted((r.l, r.r) for r in greedy_match(pairs, "l", "r", [F.desc("s"), "l", "r"]).collect())
    assert got == [(1, 10), (3, 11)]
    assert greedy_match(pairs.limit(0), "l", "r", [F.desc("s"), "l", "r"]).collect() == []


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    got = sampling.stratified(df, ["g"], "id", floor=10, total=60).groupBy("g").count().collect()
    assert sum(r["count"] for r in got) == 60 and min(r["count"] for r in got) >= 10
    take = {r.g: r["count"] for r in sampling.proportional(df, "g", "id", total=100, floor=20).groupBy("g").count().collect()}
    assert take == {"hot": 90, "cold": 20}


def test_search_parameters():
    for bad in ({"category": "x"}, {"sort": "count"}, {"ranges": {"population": (2.0, 1.0)}}, {"order": "up"}, {"limit": 0}):
        with pytest.raises(ValueError):
            Search(**bad)
    assert Search(limit=9999).most == 500 and Search(sort="growth_pct").descending
