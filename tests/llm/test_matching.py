import random

from hexloom.llm import matching as M
from hexloom.llm import variants as V
from hexloom.runtime import cut


def near(seed=0):
    rnd = random.Random(seed)
    for _ in range(400):
        a = rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128)
        b = a
        for i in rnd.sample(range(128), rnd.randint(0, M.RADIUS)):
            b ^= 1 << i
        yield a, b


def test_close_vectors_share_a_key():
    for a, b in near():
        ka, kb = (set(M.probe_keys(M._halves(x), side).tolist()) for x, side in ((a, False), (b, True)))
        assert ka & kb


def test_keys_select():
    rnd = random.Random(1)
    v = [sum(1 << i for i in rnd.sample(range(128), 10)) for _ in range(120)]
    keys = [(set(M.probe_keys(M._halves(x), False).tolist()), set(M.probe_keys(M._halves(x), True).tolist())) for x in v]
    met = sum(bool(a & b) for i, (a, _) in enumerate(keys) for j, (_, b) in enumerate(keys) if i != j)
    assert met < 0.02 * 120 * 119


def test_cells():
    rnd = random.Random(2)
    for _ in range(300):
        lat, lon = rnd.uniform(-70, 70), rnd.uniform(-179, 179)
        la, lo = lat + rnd.uniform(-0.004, 0.004), lon + rnd.uniform(-0.004, 0.004)
        from hexloom.operators.near import haversine_m

        if haversine_m(lat, lon, la, lo) <= M.MAX_M:
            assert M.cells_near(la, lo, 0.0)[0] in M.cells_near(lat, lon, M.MAX_M)


SIDE = "id long, name string, category string, lat double, lon double, cells int, words string"


def test_matches_against_all_pairs(spark):
    rnd = random.Random(5)
    syl = ["ba", "du", "fi", "ka", "mu", "ni", "ra", "su", "ti", "za"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(3))
    base = [(f"{word()} {word()}", 25 + rnd.random() * 0.05, 25 + rnd.random() * 0.05) for _ in range(150)]
    typo = lambda n: n[:3] + rnd.choice("bdk") + n[4:] if rnd.random() < 0.3 else n
    left = [(i, f"{n} Cafe", "cafe", a, b, 0, "") for i, (n, a, b) in enumerate(base)]
    right = [(1000 + i, typo(n).upper(), "Coffee", a + rnd.uniform(-1, 1) * 0.001, b, 0, "") for i, (n, a, b) in enumerate(base) if i % 2]
    left += [(900, None, "cafe", 25.0, 25.0, 0, ""), (901, "", None, 25.0, 25.0, 0, ""), (902, "Cafe", None, 25.0, 25.0, 0, ""), (903, "bafika dudumu", None, None, 25.0, 0, "")]
    right += [(1900, None, None, None, None, 0, "")]
    pairs, *words = M.matches(spark.createDataFrame(left + left[:5], SIDE), spark.createDataFrame(right, SIDE))
    got = {(r.l_id, r.r_id): r for r in pairs.collect()}
    from hexloom.llm.names import core_words
    from hexloom.operators.near import haversine_m

    want = {(a, b) for a, n, _, y, x, *_ in left for b, m, _, v, u, *_ in right if None not in (n, m, y, v) and bin(M.signature(core_words(n)) ^ M.signature(core_words(m))).count("1") <= M.RADIUS and core_words(n) and haversine_m(y, x, v, u) <= M.MAX_M}
    assert want <= set(got)
    true = {(i, 1000 + i) for i in range(150) if i % 2}
    sure = {(r.l_id, r.r_id) for r in M.sure_matches(pairs, *words).collect()}
    assert len(true & sure) >= 0.95 * len(true) and len(sure - true) <= 3
    empty = spark.createDataFrame([], SIDE)
    assert M.matches(empty, empty)[0].collect() == []


ENTRY = "block long, entry long, name string, id long, grams string"
ALIAS = "given_name string, alias string"


def test_variant_groups(spark):
    names = {1: ["Khaled Zutumu Tajaghu", "K. Zutumu Tajaghu", "د. خالد زوتومو تاجاغو", "Mohamed Zutumu Tajaghu", "Khubaza Thazija Bakery", "Khobaza Thaziga Bak.", None, ""], 2: ["Khaled Zutumu Tajaghu", "Khaled Zutumu Tajaghu", "M. Bafiku Dumani", "Mohamed Bafiku Dumani", "Mostafa Bafiku Dumani"]}
    rows = [(b, b * 100 + i, n, 7, "x") for b, ns in names.items() for i, n in enumerate(ns)]
    al = spark.createDataFrame([("Khaled", "خالد"), ("Mohamed", "Hamada"), ("Mostafa", "Sasa")], ALIAS)
    got = sorted(map(tuple, V.same_entries(spark.createDataFrame(rows + rows[:3], ENTRY), al).collect()))
    assert got == [(100, 101), (100, 102), (101, 102), (104, 105), (200, 201)]
    assert V.same_entries(spark.createDataFrame([], ENTRY), al).collect() == []


def test_mixture():
    post = M.mixture([((5, 4, 2), 900), ((5, 3, 2), 100), ((0, 0, 0), 5000), ((0, 4, 0), 200), ((2, 1, 1), 50)])
    assert post[5, 4, 2] > 0.9 > 0.1 > post[0, 0, 0] and M.mixture([]) == {}


def test_confidence_is_calibrated(spark):
    """Pairs of one name and place, of one name elsewhere, and of other names near by: confidence tells how many are one."""
    rnd = random.Random(8)
    syl = ["ba", "du", "fi", "ka", "mu", "ni", "ra", "su", "ti", "za", "gho", "le"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(3))
    pool = [word() for _ in range(60)]
    base = [(f"{rnd.choice(pool)} {word()}", 25 + rnd.random() * 0.02, 25 + rnd.random() * 0.02) for _ in range(700)]
    typo = lambda n: "".join(rnd.choice("bdk") if rnd.random() < 0.06 and c.isalpha() else c for c in n)
    left = [(i, n, "cafe" if i % 3 else "gym", a, b, 0, "") for i, (n, a, b) in enumerate(base)]
    right = [(10000 + i, typo(n), "Coffee" if i % 3 else "Sport", a + rnd.gauss(0, 0.0004), b, 0, "") for i, (n, a, b) in enumerate(base) if i % 5]
    got = [(r.confidence, r.r_id - r.l_id == 10000) for r in M.matches(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE))[0].collect()]
    for lo, hi in ((0.0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        own = [(c, t) for c, t in got if lo <= c < hi]
        if len(own) >= 20:
            assert abs(sum(c for c, _ in own) - sum(t for _, t in own)) <= 0.15 * len(own)
    assert sum(c >= 0.8 for c, _ in got) >= 350 and sum(c < 0.2 for c, _ in got) >= 100


def test_categories_go_together_at_every_size(spark):
    rows = [("cafe", f"c{i % 40}", 1.0) for i in range(400)] + [("gym", "Sport", 1.0)] * 30 + [("gym", None, 1.0), (None, "Sport", 1.0), ("gym", "c1", 0.2)]
    got = {tuple(r) for r in M.going_together(spark.createDataFrame(rows, "l_cat string, r_cat string, dice double")).collect()}
    assert ("gym", "Sport") in got and not any(None in r for r in got) and ("gym", "c1") not in got


def test_one_vector_in_many_cells(spark):
    """A chain's vector, found all over, meets in each of its cells only."""
    n = 300
    v = 0b1011 << 20
    left = [(i, v, v, [i]) for i in range(n)]
    right = [(i, v, v ^ 1, [i, i + 1]) for i in range(0, n, 2)]
    schema = "id long, b0 long, b1 long, cells array<long>"
    got = M.close_vectors(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted(r.cell for r in got) == list(range(n))


def test_multiplied_rows_are_not_broadcast(spark):
    """However small the tables look before cells and keys are made of them: nothing of theirs goes through the driver."""
    left = cut(spark.createDataFrame([(i, f"w{i}", "cafe", 25.0, 25.0, i, i, [1]) for i in range(1, 41)], "id long, words string, category string, lat double, lon double, b0 long, b1 long, cells array<long>"))
    right = cut(left.withColumn("id", left.id + 100))
    pairs = M.scored_pairs(left, right)
    assert pairs.count() >= 40 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    sure = M.sure_matches(cut(pairs).selectExpr("l_id", "r_id", "metres", "dice", "1.0D confidence"), left.select("id", "words"), right.select("id", "words"))
    assert "Broadcast" not in sure._jdf.queryExecution().executedPlan().toString()
