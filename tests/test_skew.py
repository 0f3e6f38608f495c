import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hexloom.operators.skew import chunked, per_key, with_unit

SCHEMA = "k string, who long, tag string, x int, _chunk int, n int, _m int"


def write(spark, tmp_path, rows, files=3):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.randrange(20), rnd.choice("xy"), rnd.choice([1, 2, None]), 0, 0, 0) for _ in range(3000)]
    df = write(spark, tmp_path, rows)
    keyed = with_unit(df, ["k", "who", "tag", "x"])
    got = {r.k: (r.n_rows, r.n_members, r.n_turns, r.s) for r in per_key(keyed, "k", members=["who"], ordered="tag", sums={"s": F.col("x")}, chunk_rows=100).collect()}
    own = defaultdict(list)
    for r in keyed.collect():
        if r.k is not None:
            own[r.k].append((r._unit, r._row, r.tag, r.who, r.x))
    want = {}
    for k, v in own.items():
        v.sort()
        want[k] = (len(v), len({w for *_, w, _ in v}), sum(a[2] != b[2] for a, b in zip(v, v[1:])), sum(x for *_, x in v if x))
    assert got == want


def test_chunks_are_of_one_size(spark, tmp_path):
    df = write(spark, tmp_path, [("hot", i, "x", 1, 0, 0, 0) for i in range(990)] + [(f"k{i}", i, "x", 1, 0, 0, 0) for i in range(110)])
    n = [r["count"] for r in chunked(with_unit(df, ["k"]), "k", 100).groupBy("_chunk").count().collect()]
    assert n == [100] * 11
    pos = sorted(r._pos for r in chunked(with_unit(df, ["k"]), "k", 100).collect())
    assert pos == list(range(1100))


@pytest.mark.parametrize("rows", [[], [(None, 1, "x", 1, 0, 0, 0)]])
def test_empty(spark, tmp_path, rows):
    df = write(spark, tmp_path, rows, 1)
    assert per_key(with_unit(df, ["k", "who"]), "k", members=["who"]).collect() == []
