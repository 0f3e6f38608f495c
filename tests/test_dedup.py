"""Queries without SQL against brute force on small fixtures."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hexloom.functions import grid
from hexloom.functions.text import likeness
from hexloom.operators import dedup as D

PLACE = "source string, place_id long, name string, lat double, lon double, rep long, n int, grams string"


def metres(a, b):
    y1, x1, y2, x2 = map(math.radians, (a[3], a[4], b[3], b[4]))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def world(seed=1, n=160):
    rnd = random.Random(seed)
    names = ["Rashidi Pharmacy", "Rashidy Pharmacy", "Zumoto Cafe", "Zumotto Coffee", "Falaki Gym", "Bank Misri", None, "", "كافيه", "Al Nour"]
    rows = []
    for i in range(n):
        lat, lon = 25 + rnd.randrange(6) * 0.0004 + rnd.random() * 0.0003, 27 + rnd.randrange(3) * 0.0005
        if i % 9 == 0 and rows:
            lat, lon = rows[-1][3], rows[-1][4]
        rows.append((rnd.choice(["overture", "fsq"]), i, rnd.choice(names), lat, lon, 0, 0, ""))
    return rows


@pytest.fixture(scope="module")
def places(spark):
    return grid.located(spark.createDataFrame(world(), PLACE).drop("rep", "n", "grams")).cache()


def norm_of(spark, rows):
    from hexloom.functions.text import spellings

    df = spark.createDataFrame([(r[1], r[2]) for r in rows], "i long, name string").select("i", spellings(F.col("name")).alias("n"))
    return {r.i: r.n for r in df.collect()}


@pytest.mark.parametrize("across", [True, False])
def test_neighbours(spark, places, across):
    rows = world()
    want = {a[1]: sum(metres(a, b) <= 40 and (a[0] != b[0] if across else a[1] != b[1]) for b in rows) for a in rows}
    assert {r.place_id: r.n_near for r in D.neighbours(places, 40.0, across).collect()} == want


@pytest.mark.parametrize("across", [True, False])
def test_flags_against_all_pairs(spark, places, across):
    rows, norm = world(), norm_of(spark, world())
    want = defaultdict(set)
    for a in rows:
        for b in rows:
            if a[1] == b[1] or (a[0] == b[0]) == across or not norm[a[1]] or not norm[b[1]]:
                continue
            if (a[0], norm[a[1]], a[3], a[4]) != (b[0], norm[b[1]], b[3], b[4]) and metres(a, b) <= 60 and likeness(norm[a[1]], norm[b[1]]) >= 0.72:
                want[a[1]].add((b[0], norm[b[1]], b[3], b[4]))
    got = {r.place_id: r.n_alike for r in D.flagged(places, 60.0, 0.72, across).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_clusters(spark, places):
    rows, norm = world(), norm_of(spark, world())
    own = [r for r in rows if norm[r[1]]]
    root = {r[1]: r[1] for r in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            if a[1] < b[1] and norm[a[1]] == norm[b[1]] and metres(a, b) <= 50:
                x, y = find(a[1]), find(b[1])
                root[max(x, y)] = min(x, y)
    assert {r.place_id: r.cluster for r in D.clusters(places, 50.0).collect()} == {x: find(x) for x in root}


def test_empty_places(spark):
    none = grid.located(spark.createDataFrame([], PLACE).drop("rep", "n", "grams"))
    assert D.neighbours(none, 40.0, True).collect() == [] and D.flagged(none, 40.0, 0.7, True).collect() == [] and D.clusters(none, 40.0).collect() == []


def test_token_bucket(spark, tmp_path):
    from hexloom.plans.source_queries import token_bucket

    rnd = random.Random(3)
    rows = [(rnd.randrange(3), f"2025-01-0{rnd.randint(1, 2)} {rnd.randrange(24):02d}:{rnd.randrange(60):02d}:00") for _ in range(60)]
    spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    days = defaultdict(list)
    for u, t in rows:
        days[u, t[:10]].append(int(t[11:13]) * 3600 + int(t[14:16]) * 60)
    for k, at in days.items():
        tokens, last, refused = 3.0, min(at), 0
        for t in sorted(at):
            tokens, last = min(3.0, tokens + (t - last) / 3600), t
            if tokens >= 1:
                tokens -= 1
            else:
                refused += 1
        want[k] = (len(at), round(tokens, 6), refused)
    got = {(r.user_id, str(r.day)): (r.events, r.tokens, r.refused) for r in token_bucket(spark, str(tmp_path)).collect()}
    assert got == want


def test_features_are_closed_rings(spark):
    from hexloom.operators.coverage import feature

    text = spark.createDataFrame([(3, 4, "x")], "q long, r long, name string").select(feature(F.col("q"), F.col("r"), F.struct("name"))).first()[0]
    ring = json.loads(text)["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and len(ring) == 7 and json.loads(text)["properties"] == {"name": "x"}


def test_interleaved_counts_nothing_twice(spark):
    assert Counter(grid.disk_offsets(3)).most_common(1)[0][1] == 1 and len(grid.disk_offsets(3)) == 37
