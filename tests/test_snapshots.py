import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hexloom.operators.snapshots import SnapshotIndex, fetch_values, latest_valid, replay_changes, squeezed

SCHEMA = "source string, place_id long, snapshot string, name string, category string, lat double, lon double, delivered_at timestamp, fp_text string, _g int, extra string"


def at(h):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)


def row(source, pid, snap, name="a", cat="c", lat=1.0, lon=2.0, h=0):
    return (source, pid, snap, name, cat, lat, lon, at(h), "clash", 1, "x")


def changes(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return replay_changes(df, group="source", key=["place_id"], snapshot="snapshot", version="delivered_at", text=[squeezed("name"), F.col("category")], coords=["lat", "lon"])


def found(spark, data):
    return sorted((r.source, r.place_id, r.snapshot, r.change) for r in changes(spark, data).collect())


def brute(data):
    valid = {}
    for s, p, snap, n, c, la, lo, t, *_ in data:
        if None in (s, p, snap):
            continue
        if (s, p, snap) not in valid or valid[s, p, snap][0] < t:
            valid[s, p, snap] = (t, None if n is None else " ".join(n.split()), c, la, lo)
    snaps = {}
    for s, _, snap in valid:
        snaps.setdefault(s, set()).add(snap)

    def differ(a, b):
        return (a is None) != (b is None) if None in (a, b) else abs(a - b) > 0.00001

    out = []
    for s, own in snaps.items():
        own = sorted(own)
        for a, b in zip(own, own[1:]):
            old = {p: v for (q, p, x), v in valid.items() if q == s and x == a}
            new = {p: v for (q, p, x), v in valid.items() if q == s and x == b}
            out += [(s, p, b, "added") for p in new.keys() - old.keys()] + [(s, p, b, "removed") for p in old.keys() - new.keys()]
            out += [(s, p, b, "changed") for p in new.keys() & old.keys() if old[p][1:3] != new[p][1:3] or differ(old[p][3], new[p][3]) or differ(old[p][4], new[p][4])]
    return sorted(out)


def test_rules(spark):
    data = [
        row("o", 1, "s1"), row("o", 1, "s2"), row("o", 1, "s3", name=" a "),
        row("o", 2, "s1"), row("o", 2, "s3"),
        row("o", 3, "s1", lat=1.0), row("o", 3, "s2", lat=1.000009), row("o", 3, "s3", lat=1.00004),
        row("o", 4, "s2", name="x", h=0), row("o", 4, "s2", name="y", h=5), row("o", 4, "s3", name="y"),
        row("o", 5, "s1", name=None), row("o", 5, "s2", name=None), row("o", 5, "s3", name=""),
        row("o", 6, "s1", lat=None), row("o", 6, "s2", lat=None), row("o", 6, "s3", lat=0.0),
        row("f", 9, "t1"), row(None, 9, "t1"), row("o", None, "s2"), row("o", 7, None),
    ]
    got = found(spark, data + data[:5])
    assert got == brute(data)
    assert ("o", 2, "s2", "removed") in got and ("o", 2, "s3", "added") in got and ("o", 3, "s3", "changed") in got and ("o", 3, "s2", "changed") not in got


def test_random_against_brute_force(spark):
    rnd = random.Random(1)
    data = []
    for p in range(60):
        for s in range(6):
            if rnd.random() < 0.8:
                for h in range(rnd.choice([1, 1, 2])):
                    data.append(row(rnd.choice("of"), p, f"s{s}", rnd.choice(["a", " a", "a  b", "a b", None]), rnd.choice(["c", "c", None]), rnd.choice([1.0, 1.0 + 4e-8, 1.000011, None]), 2.0, h=h * 3 + s))
    assert found(spark, data) == brute(data)


def test_hot_key_and_empty(spark):
    data = [row("o", 1, "s1")] * 300 + [row("o", p, f"s{s}") for p in range(2, 40) for s in (1, 2)]
    assert found(spark, data) == [("o", 1, "s2", "removed")]
    assert found(spark, []) == []


def test_values_are_fetched_for_changes_only(spark):
    data = [row("o", 1, "s1", name="a"), row("o", 1, "s2", name="b"), row("o", 2, "s1"), row("o", 2, "s2")]
    got = fetch_values(changes(spark, data), spark.createDataFrame(data, SCHEMA), group="source", key=["place_id"], snapshot="snapshot", version="delivered_at", values=["name"]).collect()
    assert [(r.place_id, r.old.name, r.new.name) for r in got] == [(1, "a", "b")]


def index_at(spark, tmp_path):
    return SnapshotIndex(spark, f"file://{tmp_path}/index", group="source", key=["place_id"], snapshot="snapshot", version="delivered_at", text=[F.col("name")], coords=["lat"], buckets=3)


SNAPS = {
    "s1": [row("o", 1, "s1"), row("o", 2, "s1"), row("o", 2, "s1"), row("o", None, "s1"), row("f", 7, "s1")],
    "s2": [row("o", 1, "s2", name="y"), row("o", 3, "s2"), row("o", 4, "s2", lat=1.0)],
    "s3": [row("o", 1, "s3", name="y"), row("o", 3, "s3", name="z"), row("o", 4, "s3", lat=1.5)],
}


def listed(df):
    return sorted((r.source, r.place_id, r.snapshot, r.before, r.change) for r in df.collect())


def test_index_swaps(spark, tmp_path):
    """Delivered one by one or together, the changes are the same, and so is the index."""
    df = lambda *names: spark.createDataFrame([r for n in names for r in SNAPS[n]], SCHEMA)
    want = [("o", 1, "s2", "s1", "changed"), ("o", 2, "s2", "s1", "removed"), ("o", 3, "s2", "s1", "added"), ("o", 3, "s3", "s2", "changed"), ("o", 4, "s2", "s1", "added"), ("o", 4, "s3", "s2", "changed")]
    one, all_ = index_at(spark, tmp_path / "a"), index_at(spark, tmp_path / "b")
    assert one.current() is None and one.changes() is None and listed(one.advance(df("s1"))) == []
    got = listed(one.advance(df("s2"), old=df("s1"))) + listed(one.advance(df("s3"), old=df("s2")))
    assert sorted(got) == listed(all_.advance(df("s1", "s2", "s3"))) == want
    held = lambda i: sorted(map(tuple, i._read("index", i.current()["version"]).collect()))
    assert held(one) == held(all_) and {r[0] for r in held(one)} == {"o", "f"}
    assert listed(one.changes()) == [w for w in want if w[2] == "s3"]
    from hexloom import files

    assert len([n for n in files.folders(spark, one.path) if n.startswith("v-")]) == 2
    with pytest.raises(ValueError, match="s2"):
        one.advance(df("s2"))


def test_a_run_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """Before the swap the old index counts; after it the changes are written."""
    from hexloom import files

    df = lambda n: spark.createDataFrame(SNAPS[n], SCHEMA)
    index = index_at(spark, tmp_path)
    index.advance(df("s1"))
    was = index.current()
    with monkeypatch.context() as m:
        m.setattr(files, "write_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.advance(df("s2"), old=df("s1"))
    assert index.current() == was
    want = listed(index.advance(df("s2"), old=df("s1")))
    with monkeypatch.context() as m:
        m.setattr(files, "delete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.advance(df("s3"), old=df("s2"))
    assert len(want) == 4 and [w[2:] for w in listed(index.changes())] == [("s3", "s2", "changed")] * 2


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    from hexloom import files

    at = f"file://{tmp_path}/x.json"
    for k in (1, 2):
        files.write_json(spark, at, {"k": k})
        assert files.read_json(spark, at) == {"k": k}
    assert [p.name for p in tmp_path.iterdir() if "tmp" in p.name and not p.name.startswith(".")] == []


@pytest.mark.parametrize("bound", [0, 10])
def test_latest_valid(spark, bound, monkeypatch):
    import hexloom.operators.snapshots as m

    monkeypatch.setattr(m, "bounded_collect", lambda df: None if bound == 0 else [tuple(r) for r in df.collect()])
    data = [row("o", 1, "s1"), row("o", 1, "s2", name="new", h=2), row("o", 1, "s2", name="old", h=1), row("o", 2, "s1"), row("f", 3, "s1")]
    got = latest_valid(spark.createDataFrame(data, SCHEMA), group="source", key="place_id", snapshot="snapshot", version="delivered_at", values=["name"]).collect()
    assert sorted(map(tuple, got)) == [("f", 3, "a"), ("o", 1, "new")]
