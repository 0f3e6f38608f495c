import json
import math

import pytest
from pyspark.sql import functions as F

from hexloom import config
from hexloom.functions import categories as cat
from hexloom.functions import confidence as conf
from hexloom.functions import geo, grid
from hexloom.functions import text as X
from hexloom.functions.register import register_functions
from hexloom.operators.metrics import apportioned


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_lattice(spark):
    assert len(grid.disk_offsets(2)) == 19
    cells = spark.range(-60, 60).withColumnRenamed("id", "q").crossJoin(spark.range(-60, 60).withColumnRenamed("id", "r"))
    p, s = grid.parent_of(F.col("q"), F.col("r"))
    parents = cells.select(p.alias("p"), s.alias("s")).groupBy("p", "s").count()
    assert parents.filter("abs(p) < 8 and abs(s) < 8").select("count").distinct().collect() == [(7,)]
    kids = cells.select("q", "r", p.alias("p"), s.alias("s")).withColumn("k", grid.children_of(F.col("p"), F.col("s")))
    assert kids.filter(~F.array_contains("k", F.struct("q", "r"))).count() == 0
    x, y = grid.centre(F.col("q"), F.col("r"))
    back = cells.select("q", "r", x.alias("x"), y.alias("y"))
    q2, r2 = grid.cell_of(F.col("x"), F.col("y"))
    assert back.filter((q2 != F.col("q")) | (r2 != F.col("r"))).count() == 0
    assert len(one(spark, grid.boundary(F.lit(3), F.lit(4)))[0]) == 7


def test_geo(spark):
    m = one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0]
    assert math.isclose(m, 6371000 * math.pi / 180, rel_tol=1e-9)
    k = [one(spark, geo.steps_for_radius(F.lit(r), 105000.0))[0] for r in (0.0, 500.0, 1000.0)]
    assert k[:2] == [0, 1] and k[2] >= 2
    assert one(spark, geo.segment_m(F.lit(0.0), F.lit(3.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))[0] == 3
    assert one(spark, geo.segment_m(F.lit(0.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))[0] == 3
    assert [one(spark, geo.round_away(F.lit(v), 2))[0] for v in (0.125, float("nan"), float("inf"))] == [0.13, 0, 0]
    assert one(spark, geo.round_even(F.lit(0.125), 2))[0] == 0.12


def test_confidence(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (2, 3), (3, 4), (1, 3)], "a int, b int")
    got = [r[0] for r in rows.select(conf.of_counts(F.col("a"), F.col("b"))).collect()]
    assert got == ["unavailable", "single_source", "single_source", "corroborated", "single_source"]
    assert one(spark, conf.older(F.lit(""), F.lit("2024-01-01")))[0] == "2024-01-01"
    assert spark.range(0).agg(conf.weakest(F.lit("corroborated"))).first()[0] == "unavailable"


def test_categories(spark):
    rows = spark.createDataFrame([("fsq", "Food and Drink > Dining Room > Pizza Kitchen"), ("fsq", "Food and Drink > Dining Rooms"), ("overture", "gym"), ("overture", None)], "s string, c string")
    assert [r[0] for r in rows.select(cat.delimited(cat.groups_of(F.col("s"), F.col("c")))).collect()] == ["|restaurant|", "", "|gym|", ""]


def test_names(spark):
    assert X.likeness("rashidi pharmacy", "rashidi pharmacy") == 1 and X.likeness("pharmacy", "pharmacy ali") == 0 and X.likeness("", "a") == 0
    assert X.likeness("rashidi pharmacy", "rashidy pharmacy") > 0.72 > X.likeness("rashidi pharmacy", "zumoto pharmacy")
    n = one(spark, X.normalize(F.lit("  Café-Rashidi  صيدلية!")), X.strip_generic(F.lit("cafe rashidi")), X.strip_generic(F.lit("cafe")), X.bigrams(F.lit("abab")), X.bigrams(F.lit("a")))
    assert n[0] == "cafe rashidi sydly" and list(n[1:]) == ["rashidi", "", ["ab", "ba"], ["a"]]
    t = "Café Œuvre — ÇELEBİ ٣ شارع الثورة | كازوزه"
    assert one(spark, X.normalize(F.lit(t)), X.spellings(F.lit("Kazouza | كازوزه")))[:] == (X.normal(t), "kazouza|kzwzh") and X.likeness("kazouza|kzwzh", "kzwzh") == 1
    assert one(spark, X.text_map(F.lit("{bad")), X.text_map(F.lit('{"a": "1"}')))[:] == ({}, {"a": "1"})
    assert [one(spark, X.plural(F.lit(w)))[0] for w in ("bakery", "gym", "bus", "day")] == ["bakeries", "gyms", "buses", "days"]


def test_thresholds(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(config.DEFAULTS))
    assert config.load(str(path)) == config.T
    with pytest.raises(KeyError, match="max_k"):
        config.load({k: v for k, v in config.DEFAULTS.items() if k != "max_k"})
    with pytest.raises(TypeError, match="max_k"):
        config.load(config.DEFAULTS | {"max_k": "12"})


def test_apportioning_keeps_the_sum(spark):
    kids = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 3.0), ("c", "z", 0.0), ("d", "z", None), ("e", "none", 1.0)], "k string, p string, w double")
    got = {r.k: r.v for r in apportioned(kids, spark.createDataFrame([("p", 8.0), ("z", 4.0)], "p string, v double"), parent="p", weight="w", value="v").collect()}
    assert got == {"a": 2.0, "b": 6.0, "c": 2.0, "d": 2.0}


def test_registered(spark):
    register_functions(spark)
    assert spark.sql("SELECT round(haversine_m(0, 0, 0, 1)), agreement_ratio(2, 4), name_likeness('a rashidi', 'a rashidi')").first()[1:] == (0.5, 1.0)


def test_pages_are_clamped():
    from hexloom.plans.serving_queries import page

    assert [page(), page(0, -3), page(50, 20), page(9999, 1)] == [(200, 0), (200, 0), (50, 20), (500, 1)]
