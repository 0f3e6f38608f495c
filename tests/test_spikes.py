import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hexloom.operators import spikes as S


def found(spark, rows):
    df = spark.createDataFrame(rows, "h3_index string, metric string, snapshot_id string, value double, written_at long, _values string, v string")
    from hexloom.plans.pipeline_queries import _impossible

    got = S.implausible_readings(df, series=["h3_index", "metric"], kind="metric", order="snapshot_id", value="value", version="written_at", impossible=_impossible, stuck_for=lambda m: m != "business_count.total")
    return sorted((r.h3_index, r.snapshot_id, r.reason) for r in got.collect())


def series(name, metric, values):
    return [(name, metric, f"s{i:02d}", v, 0, "clash", "clash") for i, v in enumerate(values)]


def base(n=24, seed=0):
    rnd = random.Random(seed)
    return [100 + 2 * math.sin(i) + rnd.random() for i in range(n)]


def test_kinds_of_readings(spark):
    up = base()
    up[10] = 900.0
    two = base(seed=1)
    two[8] = two[9] = 5.0
    step = base(12, 2) + [v + 500 for v in base(12, 3)]
    edge = base(seed=4)
    edge[1] = 900.0
    three = base(seed=8)
    three[9] = three[10] = three[11] = 700.0
    stuck = base(seed=5)
    stuck[6:12] = [stuck[6]] * 6
    stairs = [float(i // 4) for i in range(24)]
    bad = base(seed=6)
    bad[3], bad[4], bad[5], bad[6] = -1.0, float("inf"), None, float("nan")
    rows = [r for n, v in (("up", up), ("two", two), ("step", step), ("edge", edge), ("three", three), ("stuck", stuck), ("stairs", stairs), ("flat", [7.0] * 24), ("bad", bad)) for r in series(n, "population", v)]
    rows += series("count", "business_count.total", [5.0, 6.0, 5.5, 6.0]) + series("pct", "builtup_pct", [50.0, 100.5])
    rows += [(None, "population", "s", 1.0, 0, "", ""), ("x", None, "s", -1.0, 0, "", ""), ("x", "population", None, -1.0, 0, "", "")]
    want = [("bad", "s03", "impossible"), ("bad", "s04", "impossible"), ("count", "s02", "impossible"), ("pct", "s01", "impossible"), *[("stuck", f"s{i:02d}", "stuck") for i in range(6, 12)], ("two", "s08", "spike"), ("two", "s09", "spike"), ("up", "s10", "spike")]
    assert found(spark, rows + rows[:40]) == want
    assert found(spark, []) == []


def test_later_row_counts(spark):
    rows = series("a", "population", base())
    rows.append(("a", "population", "s05", -3.0, 9, "", ""))
    assert found(spark, rows) == [("a", "s05", "impossible")]


def measured(x):
    """The columns source_bases() reads, of series of one source."""
    return [("m", list(range(len(v))), d.tolist()) for v, d in zip(x, S.deviations(x))]


def test_what_a_source_does_in_all_its_series_is_no_spike(spark):
    """The sparse part decides: the rule alone would report the pulse that all series of a source share."""
    shared, own = [], []
    for k in range(80):
        v = base(seed=k)
        w = list(v)
        v[12] += 60 + 40 * random.Random(k).random()
        if k == 7:
            w[12] += 80
        if k == 9:
            v[5] += 90
        shared.append(v)
        own.append(w)
    assert all(12 in S.spike_positions(np.array(v), range(24)) for v in shared)
    rows = [r for k, v in enumerate(shared) for r in series(f"a{k}", "population", v)] + [r for k, v in enumerate(own) for r in series(f"b{k}", "builtup", v)]
    assert found(spark, rows) == [("a9", "s05", "spike"), ("b7", "s12", "spike")]


def test_bases_are_summed_over_tasks(spark):
    """The directions do not depend on how the series are dealt to tasks, and hold the planted pulse."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (200, S.PROFILE)).cumsum(axis=1) * 0.2 + 50
    x[:, 7] += 30
    df = spark.createDataFrame(measured(x), "_source string, _ord array<int>, _dev array<double>")
    got = [np.array(S.source_bases(df.repartition(n)).first()._basis).reshape(S.PROFILE, -1) for n in (1, 7)]
    assert all(g.shape[1] >= 1 and np.linalg.norm(g[7]) >= 0.95 for g in got)
    assert np.allclose(got[0] @ got[0].T, got[1] @ got[1].T, atol=1e-6)


def test_long_series_fold_into_profiles(spark):
    n = 3 * S.PROFILE + 5
    v = [100 + math.sin(i) + random.Random(i).random() for i in range(n)]
    v[40] += 200
    rows = [("a", "population", f"s{i:03d}", x, 0, "", "") for i, x in enumerate(v)]
    assert found(spark, rows) == [("a", "s040", "spike")]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(7, 30), st.floats(11, 300), st.sampled_from([1, 2]), st.booleans())
def test_spikes_of_one_series_are_sparse(seed, n, height, width, trend):
    """Where a source shows nothing in common, every reading that the rule reports stands off the level around it."""
    rnd = np.random.default_rng(seed)
    v = 1000 + rnd.normal(0, 1, n).cumsum() * 0.3 + (np.arange(n) * rnd.normal(0, 2) if trend else 0)
    at = int(rnd.integers(0, n))
    v[at : at + width] += height * S.median_step(v) * rnd.choice([-1, 1]) * 1.2
    rule = S.spike_positions(v, range(n))
    assert all(abs(S.deviations(v[None])[0][i]) > S.SPARSE_STEPS for i in rule)
