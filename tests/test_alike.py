"""Alike names near each other against brute force, with names of unequal length."""

import random
from collections import defaultdict

import pytest

from hexloom.functions import grid
from hexloom.functions.text import _may_be_alike, likeness
from hexloom.operators import dedup as D
from tests.test_dedup import metres

PLACE = "source string, place_id long, name string, lat double, lon double"


def names(rnd, n):
    """Words out of few syllables, kinds and a suffix; some cut, misspelt or doubled."""
    word = lambda: "".join(rnd.choice(["ha", "ki", "ju", "ghu", "dhi", "ta", "mo", "rri", "ib", "9"]) for _ in range(rnd.randint(1, 4)))
    out = []
    for _ in range(n):
        parts = [word() for _ in range(rnd.randint(1, 3))] + rnd.choice([[], ["cafe"], ["pharmacy"], ["coffee", "bahr", "noor"], ["a"], ["mall", "studio"]])
        rnd.shuffle(parts)
        out.append(" ".join(parts))
        if rnd.random() < 0.3:
            out.append(" ".join([word(), out[-1], *(word() for _ in range(5))]))
        if rnd.random() < 0.4:
            x = list(rnd.choice(out))
            k = rnd.randrange(len(x))
            x[k : k + 1] = rnd.choice([[], [rnd.choice("abht")], [x[k], x[k]]])
            out.append(" ".join("".join(x).split()) or "x")
    return out + ["", "aou", "ie", "hkjhkjhkjh hkjhkjhkjh kikiki", "block", "hi block ghuta", "x" * 70]


def rows(seed=5, n=260):
    rnd = random.Random(seed)
    pool = names(rnd, 20)
    return [(rnd.choice(["overture", "fsq"]), i, rnd.choice(pool), 25 + rnd.random() * 0.0016, 27 + rnd.random() * 0.0016) for i in range(n)]


def test_bounds_lose_nothing():
    pool = names(random.Random(2), 90)
    pool += [f"{a}|{b}" for a, b in zip(pool[:40], pool[20:60]) if a and b]
    for least in (0.5, 0.72, 0.82, 0.95):
        assert [(a, b) for a in pool for b in pool if a and b and likeness(a, b) >= least and not any(_may_be_alike(x, y, least) for x in a.split("|") for y in b.split("|"))] == []


@pytest.mark.parametrize(("across", "least"), [(True, 0.72), (False, 0.72), (True, 0.82)])
def test_pairs_of_unequal_names(spark, across, least):
    own = rows()
    df = grid.located(spark.createDataFrame(own, PLACE))
    reps = {r.rep: r for r in D.spots(D.named(df), ["source", "norm"]).collect()}
    got = {frozenset((p.l_rep, p.r_rep)) for p in D.alike_pairs(df, 60.0, least, across).collect()}
    want, rare = set(), set()
    for x, a in reps.items():
        for y, b in reps.items():
            if (a.source > b.source if across else a.source == b.source and x < y) and metres((0, 0, 0, a.lat, a.lon), (0, 0, 0, b.lat, b.lon)) <= 60 and likeness(a.norm, b.norm) >= least:
                want.add(frozenset((x, y)))
                if min(len(a.norm), len(b.norm)) < 0.8 * max(len(a.norm), len(b.norm)):
                    rare.add(frozenset((x, y)))
    assert got == want and len(rare) > 0


def test_flags_of_unequal_names(spark):
    own = [("overture", 1, "Hi Block", 25.0, 27.0), ("fsq", 2, "Block", 25.0001, 27.0), ("overture", 3, "Jidhaku Ghu Marrihu Lotaribu Zamunqi", 25.1, 27.0), ("fsq", 4, "Dhaku Gho Mar", 25.1001, 27.0)]
    want = defaultdict(int)
    for a in own:
        for b in own:
            want[a[1]] += a[0] != b[0] and metres((0, 0, 0, *a[3:]), (0, 0, 0, *b[3:])) <= 40 and likeness(a[2].lower(), b[2].lower()) >= 0.72
    got = {r.place_id: r.n_alike for r in D.flagged(grid.located(spark.createDataFrame(own, PLACE)), 40.0, 0.72, True).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_stacked_records_are_matched_one_to_one(spark):
    own = [("overture", i, "Rashidi Zumoto", 25.0, 27.0) for i in (1, 2, 3)] + [("fsq", i, "Rashidi Zumoto", 25.0, 27.0) for i in (11, 12)]
    own += [("fsq", 13, "Rashidi Zumotto", 25.0001, 27.0), ("overture", 4, "Falaki Motors", 25.0, 27.0)]
    got = D.matched(grid.located(spark.createDataFrame(own, PLACE)), "overture", "fsq", 40.0, 0.72).collect()
    assert sorted((r.l_id, r.r_id) for r in got) == [(1, 11), (2, 12), (3, 13)]


def test_ties_beyond_fifty_rounds(spark):
    n = 60
    pairs = spark.range(n).withColumnRenamed("id", "o").crossJoin(spark.range(n).withColumnRenamed("id", "f"))
    got = D.greedy_match(pairs, "o", "f", []).collect()
    assert len(got) == n and len({r.o for r in got}) == len({r.f for r in got}) == n


def test_stacked_records_are_flagged(spark):
    own = [("fsq", i, "Rashidi Zumoto", 25.0, 27.0) for i in (1, 2, 3)] + [("fsq", 4, "Rashidi Zumotto", 25.0001, 27.0), ("overture", 5, "Rashidi Zumoto", 25.0, 27.0), ("fsq", 6, "Cafe", 25.2, 27.0), ("fsq", 7, "Cafe", 25.2, 27.0)]
    df = grid.located(spark.createDataFrame(own, PLACE))
    assert {r.place_id: r.n_alike for r in D.flagged_records(df, 40.0, 0.72, False).collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 6: 1, 7: 1}
    assert {r.place_id: r.n_alike for r in D.flagged_records(df, 40.0, 0.72, True).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 4}


def test_record_flags_against_all_pairs(spark):
    from tests.test_dedup import norm_of, world

    own = [r[:5] for r in world()]
    norm = norm_of(spark, world())
    want = {a[1]: sum(a[1] != b[1] and a[0] == b[0] and bool(norm[a[1]] and norm[b[1]]) and metres(a, b) <= 60 and likeness(norm[a[1]], norm[b[1]]) >= 0.72 for b in own) for a in own}
    got = {r.place_id: r.n_alike for r in D.flagged_records(grid.located(spark.createDataFrame(own, PLACE)), 60.0, 0.72, False).collect()}
    assert got == {k: v for k, v in want.items() if v}


# Pairs of our own writing: two names, and whether they mean one place.
LABELLED = [
    ("Bahr Falafel", "Bahr Falafel", True), ("Bahr Falafel", "bahr  FALAFEL!", True), ("Zumoto Trattoria", "Zumotto Trattoria", True), ("مطعم النخيل | Nakhil Garden", "Nakhil Garden", True),
    ("فلافل بحر", "Bahr Falafel | فلافل بحر", True), ("Rashidi Optics", "Rashidi Optics Shubra", True), ("Café Lumière", "Cafe Lumiere", True), ("Tirana Books", "Tirana's Books", True),
    ("Koshary Farouk", "Koshari Farouk", True), ("Orchid Flowers & Gifts", "Orchid Flowers Gifts", True), ("سمسم", "Semsem", True), ("كرز", "Karaz", True), ("Velo Bikes ( فيلو )", "Velo Bikes", True),
    ("Hassan Hardware", "Hasan Hardware", True), ("Pistachio House", "Pistachio House Downtown", True), ("Jasmin Tailor", "Jasmine Tailor", True),
    ("Orion Studio", "Vega Studio", False), ("Falcon Marketing Agency", "Lotus Marketing Agency", False), ("City Mall", "Sindbad Burger - City Mall", False), ("Grand Plaza", "Royal Plaza", False), ("Cairo Center", "Giza Center", False),
    ("Tak clinic", "Tam clinic", False), ("Dr. Samir Wahba", "Dr. Nadia Fawzy", False), ("Amber Lab", "Amberline Photographic Supplies", False), ("صيدلية", "بنك", False), ("Blue Door", "Green Gate", False), ("Maadi Branch", "Zamalek Branch", False),
    ("Lavender Spa", "Cedar Spa", False), ("The Group", "The Company", False), ("Noor Salon", "Nile Salon", False), ("Kite School", "Chess School", False), ("Pharaoh Tours Downtown Mall", "Downtown Mall", False), ("Mint", "Mantis", False),
]


def test_labelled_pairs(spark):
    from pyspark.sql import functions as F

    from hexloom.functions.text import name_likeness, spellings

    df = spark.createDataFrame(LABELLED, "a string, b string, same boolean")
    rows = df.select("a", "b", "same", (name_likeness(spellings(F.col("a")), spellings(F.col("b"))) >= 0.72).alias("got")).collect()
    hit, said, true = sum(r.got and r.same for r in rows), sum(r.got for r in rows), sum(r.same for r in rows)
    wrong = [(r.a, r.b) for r in rows if r.got != r.same]
    assert hit >= 0.95 * said and hit >= 0.95 * true, wrong


@pytest.mark.parametrize("lat", [0.0, 47.0, 60.0, 75.0, -83.0, 89.9995])
def test_neighbours_at_every_latitude(spark, lat):
    rnd = random.Random(4)
    import math

    wide = 0.0012 / max(math.cos(math.radians(lat)), 1e-3)
    own = [("fsq" if i % 2 else "overture", i, "Zumoto Rashidi", lat + rnd.random() * 0.0004, 27 + rnd.random() * wide) for i in range(120)]
    df = spark.createDataFrame(own, PLACE)
    near = {(a[1], b[1]) for a in own for b in own if a[1] != b[1] and metres((0, 0, 0, *a[3:]), (0, 0, 0, *b[3:])) <= 40}
    for across in (True, False):
        want = {i: sum((i, j) in near and (not across or (i + j) % 2 == 1) for j in range(120)) for i in range(120)}
        assert {r.place_id: r.n_near for r in D.neighbours(df, 40.0, across).collect()} == want
        want = {i: sum((i, j) in near and (i + j) % 2 == across for j in range(120)) for i in range(120)}
        assert {r.place_id: r.n_alike for r in D.flagged_records(df, 40.0, 0.72, across).collect()} == {k: v for k, v in want.items() if v}


def test_pairs_within_a_region(spark):
    """Of one source and of two; another region, however near, makes no pair; stacked records stand for one another."""
    own = [("fsq", 1, "Rashidi Zumoto", 25.0, 27.0, "A"), ("fsq", 2, "Rashidi Zumotto", 25.0001, 27.0, "A"), ("overture", 3, "Rashidi Zumoto", 25.0, 27.0, "A"), ("overture", 4, "Rashidi Zumoto", 25.0, 27.0, "A"),
           ("fsq", 5, "Rashidi Zumoto", 25.0, 27.0, "B"), ("fsq", 6, "Rashidi Zumoto", 25.0, 27.0, None), ("fsq", 7, "Falaki Motors", 25.0, 27.0, "A"), ("fsq", 8, "Rashidi Zumoto", 25.01, 27.0, "A")]
    df = spark.createDataFrame(own, "source string, place_id long, name string, lat double, lon double, region string")
    got = sorted((r.region, r.pair_type, r.place_id_1, r.place_id_2, r.n_1, r.n_2) for r in D.region_pairs(df, "region", 40.0, 0.72).collect())
    assert got == [("A", "cross_source", 1, 3, 1, 2), ("A", "cross_source", 2, 3, 1, 2), ("A", "intra_source", 1, 2, 1, 1), ("A", "intra_source", 3, 3, 2, 2)]
    assert D.region_pairs(df.limit(0), "region", 40.0, 0.72).collect() == []


def test_matches_by_name_alone(spark):
    """Against brute force: every two names of an area, best first, without those excluded."""
    rnd = random.Random(9)
    pool = [n for n in names(rnd, 40) if len(n) > 2]
    own = [(rnd.choice(["overture", "fsq"]), i, rnd.choice(pool), 25 + rnd.random(), 27 + rnd.random(), rnd.choice(["a", "b", None])) for i in range(160)]
    df = spark.createDataFrame(own, "source string, place_id long, name string, lat double, lon double, area string")
    from pyspark.sql import functions as F

    from hexloom.functions.text import spellings

    spelt = {r.name: r.s for r in df.select("name", spellings(F.col("name")).alias("s")).distinct().collect()}
    excluded = [(own[0][2], own[0][2])]
    pairs = []
    for a in own:
        for b in own:
            if a[0] == "overture" and b[0] == "fsq" and a[5] and a[5] == b[5] and (a[2], b[2]) not in excluded:
                s = likeness(spelt[a[2]], spelt[b[2]])
                if s > 0.9:
                    pairs.append((-s, metres((0, 0, 0, *a[3:5]), (0, 0, 0, *b[3:5])), a[1], b[1]))
    want, used = set(), set()
    for _, _, x, y in sorted(pairs):
        if x not in used and y not in used:
            want.add((x, y))
            used |= {x, y}
    got = {(r.l_id, r.r_id) for r in D.matched_by_name(df, "overture", "fsq", "area", 0.9, spark.createDataFrame(excluded, "name_a string, name_b string")).collect()}
    assert len(want) > 5 and got == want
    with pytest.raises(ValueError):
        D.matched_by_name(df, "overture", "fsq", "area", 0.5)


def test_bounds_of_many_pairs_at_once():
    """Are those of two names, long ones too; the likeness behind them is likeness() where it counts."""
    import pandas as pd

    from hexloom.functions.text import likeness_beyond, may_be_alike_all

    pool = [x for x in names(random.Random(3), 70) if x]
    a, b = zip(*[(x, y) for x in pool for y in pool])
    for least in (0.5, 0.72, 0.9):
        want = [_may_be_alike(x, y, least) for x, y in zip(a, b)]
        assert may_be_alike_all(pd.Series(a), pd.Series(b), least).tolist() == want and 0 < sum(want) < len(want)
        for x, y in zip(a, b):
            got, is_ = likeness_beyond(x, y, least), likeness(x, y)
            assert got == is_ if is_ >= least else got < least


def test_region_pairs_in_one_pass(spark):
    """Against brute force, of one source and of two at once, in squares that are told by matrices."""
    rnd = random.Random(21)
    pool = [n for n in names(rnd, 90) if len(n) > 2]
    own = [(rnd.choice(["fsq", "overture", "x"]), i, rnd.choice(pool), 25 + rnd.random() * 0.0007, 27 + rnd.random() * 0.0007, rnd.choice("AAAB")) for i in range(260)]
    df = spark.createDataFrame(own, "source string, place_id long, name string, lat double, lon double, region string")
    from pyspark.sql import functions as F

    from hexloom.functions.text import spellings

    spelt = {r.name: r.s for r in df.select("name", spellings(F.col("name")).alias("s")).distinct().collect()}
    bones = {k: "".join(c for c in v if c not in "aeiou |") for k, v in spelt.items()}
    grams = {k: {v[i : i + 2] for i in range(max(1, len(v) - 1))} for k, v in bones.items()}
    found = {}
    for least in (0.6, 0.72):
        want = set()
        for a in own:
            for b in own:
                # The left one is of the later source; which of one source it is, a hash tells.
                if a[1] != b[1] and a[0] >= b[0] and a[5] == b[5] and metres((0, 0, 0, *a[3:5]), (0, 0, 0, *b[3:5])) <= 40 and grams[a[2]] & grams[b[2]]:
                    if likeness(spelt[a[2]], spelt[b[2]]) >= least:
                        want.add((a[5], a[0] == b[0], *sorted((a[1], b[1]))))
        pairs = D.region_pairs(df, "region", 40.0, least)
        assert pairs._jdf.queryExecution().toString().split("== Physical Plan ==")[0].count("MapInPandas") == 3  # one in each logical plan
        got = {(r.region, r.pair_type == "intra_source", r.place_id_1, r.place_id_2) for r in pairs.collect()}
        assert got <= want and all(x[1] for x in want - got)  # an order of two may be alike where the other is not
        found[least] = len(got)
    assert found[0.6] > found[0.72] > 50


def test_records_that_have_one_alike(spark):
    """Those of flagged_records(), while most pairs of a full square are not compared."""
    rnd = random.Random(17)
    pool = [n for n in names(rnd, 60) if len(n) > 2]
    own = [(rnd.choice(["fsq", "overture", None]), i, rnd.choice(pool), 25 + rnd.random() * 0.003, 27 + rnd.random() * 0.003) for i in range(500)]
    own += [("fsq", 1000 + i, "Rashidi Zumoto", 25.02 + i * 1e-6, 27.0) for i in range(150)] + [("x", 2000 + i, "Far Away", 25.05, 27.0) for i in range(3)]
    df = grid.located(spark.createDataFrame(own, PLACE))
    want = {r.place_id for r in D.flagged_records(df, 60.0, 0.72, False).collect()}
    got = D.duplicated(df, 60.0, 0.72)
    assert {(r.source, r.n) for r in got.collect()} >= {("x", 3)} and sum(r.n for r in got.collect()) == len(want) > 200
    crowd = D.spots(D.named(df.filter("place_id between 1000 and 1999")), ["source", "norm"]).drop("n")
    assert D._met(crowd, 60.0, 0.72, False).count() == 150 * 149 // 2
    met = D._met(crowd, 60.0, 0.72, False, ends=True)
    assert met.count() < 300 and met.selectExpr("explode(array(l_rep, r_rep)) r").distinct().count() == 150


def test_matrices_leave_out_no_pair():
    """Whatever the bound by letters accepts is among the pairs of the matrices; runs are those of difflib."""
    from difflib import SequenceMatcher

    import numpy as np

    from hexloom.functions.text import Held, letters, ratio

    pool = [x for x in names(random.Random(31), 120) if x] + ["", "aeiou", "aa cafe", "bbbbbb", "bbbb bbbb", "a" * 80, "xyz" * 40]
    held = Held(letters.func(__import__("pandas").Series(pool)))
    i, j = (x.ravel() for x in np.indices((len(pool), len(pool))))
    at = np.arange(len(pool))
    for least in (0.3, 0.72, 0.9):
        want = set(np.flatnonzero(held.may_be_alike(i, j, least)).tolist())
        m = held.matrices(at, least)
        x, y = Held.meeting(m, m)
        got = set((x * len(pool) + y).tolist())
        assert want <= got and len(got) < 0.9 * len(i)
    for a in pool[:90]:
        for b in pool[-90:] + ["ab" * 120]:
            assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_squares_over_many_batches(spark):
    """A square that goes on over batches and blocks of pairs gives all its pairs; pairs are not rows of a join."""
    own = [("fsq", i, f"Rashidi Zumoto {'abcdefghij'[i % 10]}", 25.0 + i * 1e-6, 27.0) for i in range(90)]
    df = grid.located(spark.createDataFrame(own, PLACE))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        pairs = D.alike_pairs(df, 60.0, 0.72, False)
        assert pairs.count() == 90 * 89 // 2 and "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
