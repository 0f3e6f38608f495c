import random

from hexloom.operators.graph import components
from hexloom.operators.similarity import prefix_pairs


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_prefix_pairs_are_all_pairs(spark):
    rnd = random.Random(4)
    sets = [(i % 3, i, sorted({rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 6))})) for i in range(90)] + [(None, 999, ["a"]), (0, 998, None)]
    want = set()
    for x, i, a in sets:
        for y, j, b in sets:
            if x is not None and x == y and i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5:
                want.add((i, j))
    got = {tuple(r) for r in prefix_pairs(spark.createDataFrame(sets, "block long, id long, grams array<string>"), 0.5).collect()}
    assert got == want
