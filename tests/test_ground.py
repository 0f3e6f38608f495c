"""Checks that find nothing in the small tables, documents, transforms and lines."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.plans import ground_queries as G
from hexloom.plans import quality_queries as Q

PLACES = "source string, place_id long, name string, category string, groups string, lat double, lon double, h3_res9 string, h3_res8 string, dup_suspected boolean, snapshot string, pipeline_version string, delivered_at timestamp"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    now = dt.datetime(2026, 1, 1)
    row = lambda i, source, name, category, lat, lon, cell: (source, i, name, category, "", lat, lon, cell + "9", cell, False, "2026-01-01", "v", now)
    rows = [row(i, "overture", f"Agent {i}", "real_estate_service", 25.0 + i * 1e-3, 27.0, "a") for i in range(25)] + [row(100 + i, "overture", f"Agent {i}", "real_estate_service", 26.0 + i * 1e-3, 27.0, "b") for i in range(19)]
    rows += [row(200 + i, "fsq", f"Stall {i % 3}", "Retail > Apparel", 27.000001, 27.0, "c") for i in range(6)] + [row(300 + i, "fsq", "One name", "Retail > Apparel", 28.0, 27.0, "c") for i in range(6)]
    rows += [row(400, "fsq", "Rashidi Zumoto", "Retail > Apparel", 24.0, 27.0, "c"), row(401, "fsq", "Rashidi Zumotto", "Retail > Apparel", 24.0005, 27.0, "c"), row(402, "fsq", "Head office Nile", "Retail > Apparel", 23.0, 27.0, "d"), row(403, "fsq", "Quad", "Learning > College Quad", 22.0, 27.0, "d")]
    spark.createDataFrame(rows, PLACES).write.parquet(f"{at}/places.parquet")
    return at


def test_crowded_areas(spark, tables):
    assert [tuple(r) for r in Q.density_distortion(spark, tables).collect()] == [("a", 25)]


def test_collapsed_coordinates(spark, tables):
    assert [(r.lat, r.n, r.names) for r in Q.coordinate_collapse(spark, tables).collect()] == [(27.0, 6, 3)]


def test_no_storefronts(spark, tables):
    got = {r.place_id for r in Q.storefront_filter(spark, tables).filter("not_storefront").collect()}
    assert got == set(range(25)) | set(range(100, 119)) | {402, 403}


def test_duplicates_in_the_gate(spark, tables):
    # agents 111 m apart, the stacked stalls and the one name, and a pair of spellings
    assert G.qa_duplicates(spark, tables).first().hits == 25 + 19 + 6 + 6 + 2


def test_manifest_and_notes(spark, data):
    m = G.history_manifest(spark, data, {"2099-01-01": "not published"})
    assert m["snapshots"] == sorted(m["snapshots"]) and m["detector"]["jump_pct"] == 40 and sum(m["rows"].values()) > 0 and json.loads(json.dumps(m)) == m
    assert [r.note for r in G.gap_notes(spark, m).collect()] == ["2099-01-01 is missing: not published."]
    split = spark.createDataFrame([("all", 3, 2), ("inhabited", 1, 1)], "scope string, cells long, corroborated long")
    summary, regions = G.coverage_documents(split, spark.createDataFrame([("A", 1.5)], "governorate string, pct double"))
    assert summary["all"] == {"cells": 3, "corroborated": 2} and regions == [{"governorate": "A", "pct": 1.5}]


def test_transforms(spark):
    df = spark.createDataFrame([(0.0, 33.0), (30.0, 31.0), (60.0, 35.9)], "lat double, lon double")
    e, n = geo.utm(F.col("lat"), F.col("lon"), 36)
    got = df.select(e.alias("e"), n.alias("n")).collect()
    assert abs(got[0].e - 500_000) < 1e-6 and abs(got[0].n) < 1e-6
    assert 300_000 < got[1].e < 310_000 and 3_320_000 < got[1].n < 3_321_000 and got[2].e > 500_000
    # Scale: a step of 0.001 degrees north is as long on the ellipsoid, but for the grid's 0.9996.
    step = spark.createDataFrame([(30.0, 33.0), (30.001, 33.0)], "lat double, lon double").select(geo.utm(F.col("lat"), F.col("lon"), 36)[1].alias("n")).collect()
    f, a = 1 / 298.257223563, 6378137.0
    e2 = f * (2 - f)
    m = a * (1 - e2) / (1 - e2 * math.sin(math.radians(30.0005)) ** 2) ** 1.5
    assert abs((step[1].n - step[0].n) / 0.9996 - m * math.radians(0.001)) < 1e-4
    for lat, lon in ((0.0, 10.0), (45.0, -100.0), (-70.0, 30.0)):
        t = math.radians(lat)
        for _ in range(60):
            t -= (2 * t + math.sin(2 * t) - math.pi * math.sin(math.radians(lat))) / (2 + 2 * math.cos(2 * t))
        x, y = 2 * math.sqrt(2) / math.pi * a * math.radians(lon) * math.cos(t), math.sqrt(2) * a * math.sin(t)
        la, lo = geo.mollweide_place(F.lit(x), F.lit(y))
        r = spark.range(1).select(la.alias("la"), lo.alias("lo")).first()
        assert abs(r.la - lat) < 1e-6 and abs(r.lo - lon) < 1e-6
    assert spark.range(1).select(geo.mollweide_place(F.lit(2e7), F.lit(8e6))[1]).first()[0] is None


def test_lines():
    line = [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0)]
    assert geo.line_length(line) == 150 and geo.line_part(line, 80, 120) == [(80.0, 0.0), (100.0, 0.0), (100.0, 20.0)]
    assert geo.line_part(line, -5, 10) == [(0.0, 0.0), (10.0, 0.0)] and geo.line_part(line, 140, 999) == [(100.0, 40.0), (100.0, 50.0)] and geo.line_part([], 0, 5) == []
    import numpy as np

    from hexloom.operators.near import even_odd

    rings = [np.array(r) for r in geo.line_buffer(line, 10.0)]
    inside = lambda x, y: any(even_odd(np.array([x]), np.array([y]), r)[0] for r in rings)
    assert inside(50, 9.9) and inside(-9.8, 0.1) and inside(109.8, 25) and not inside(50, 10.2) and not inside(-10.2, 0)


def test_vocabulary_is_loaded(spark, tmp_path):
    from hexloom.functions import categories as cat

    path = tmp_path / "v.json"
    path.write_text(json.dumps({"flat": {"cafe": ["tea_house"]}, "paths": {}, "below": {"gym": ["Sport"]}}))
    by = cat.load_rules(str(path))
    df = spark.createDataFrame([("overture", "tea_house"), ("overture", "cafe"), ("fsq", "Sport > Pool"), ("fsq", "Sportive"), ("fsq", None)], "s string, c string")
    assert [r[0] for r in df.select(cat.groups_of(F.col("s"), F.col("c"), by)).collect()] == [["cafe"], [], ["gym"], [], []]
    full = spark.createDataFrame([("overture", "steakhouse"), ("fsq", "Dining and Drinking > Restaurant > Italian Restaurant"), ("fsq", "Dining and Drinking > Restaurants"), ("fsq", "Retail > Pharmacy")], "s string, c string")
    assert [r[0] for r in full.select(cat.groups_of(F.col("s"), F.col("c"))).collect()] == [["restaurant"], ["restaurant"], [], ["pharmacy"]]
    path.write_text(json.dumps({"flat": {"zoo": ["zoo"]}, "paths": {}, "below": {}}))
    with pytest.raises(ValueError, match="zoo"):
        cat.load_rules(str(path))
    path.write_text("{}")
    with pytest.raises(KeyError):
        cat.load_rules(str(path))
