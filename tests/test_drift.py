import json

from hexloom.operators.drift import appearing_alternatives, canonical, field_changes, kind_of, leaves, unified_records


def line(i, feed, snap, x, raw=0):
    return (raw or i, feed, "src", snap, i, x if isinstance(x, str) or x is None else json.dumps(x), "clash")


def changes(spark, rows):
    df = spark.createDataFrame(rows, "raw_id long, feed string, source string, snapshot string, line_no long, payload string, path string")
    return sorted(map(tuple, field_changes(df).collect()))


def file(feed, snap, make, n=12):
    return [line(i, feed, snap, make(i)) for i in range(n)]


def test_all_kinds_of_change(spark):
    a = file("f", "1", lambda i: {"id": f"r{i}", "name": f"n{i}", "n": i, "gone": i % 3 == 0, "lat": i * 0.5, "lon": i * 0.25})
    b = file("f", "2", lambda i: {"id": f"r{i}", "names": {"primary": f"n{i}"}, "n": str(i), "new": [i], "lat": i * 0.5, "lon": i * 0.25})
    c = file("f", "3", lambda i: {"id": f"r{i}", "names": {"primary": f"n{i}"}, "n": str(i), "new": [i], "bbox": {"ymin": i * 0.5, "xmin": i * 0.25}})
    rows = c + a + b + [line(50, "f", "2", '{"id": "cut", "na'), line(51, "f", "2", None), line(52, "f", "2", "[1]"), b[0], line(53, "f", None, {"id": 1}), line(54, None, "1", {"id": 1})]
    assert changes(spark, rows) == [
        ("f", "2", "gone", "", "removed"), ("f", "2", "n", "", "type"), ("f", "2", "names.primary", "name", "renamed"), ("f", "2", "new", "", "added"),
        ("f", "3", "bbox.xmin", "lon", "renamed"), ("f", "3", "bbox.ymin", "lat", "renamed"),
    ]


def test_odd_values_and_nulls(spark):
    a = file("f", "1", lambda i: {"id": i, "v": 1.5 * i, "w": None})
    b = file("f", "2", lambda i: {"id": i, "v": "odd" if i == 3 else 2.5 * i, "w": None if i else 1})
    assert changes(spark, a + b) == [("f", "2", "w", "", "added")]
    mixed = file("f", "2", lambda i: {"id": i, "v": "odd" if i < 4 else 2.5 * i})
    assert changes(spark, a + mixed) == []
    assert changes(spark, []) == []
    unread = [line(i, "f", "2", "{") for i in range(3)]
    assert changes(spark, a + unread) == [("f", "2", "id", "", "removed"), ("f", "2", "v", "", "removed")]


def test_leaves():
    assert leaves('{"a": {"b": 1, "c": null, "d": {}}, "e": [1, {"x": 2}]}') == {"a.b": 1, "e": [1, {"x": 2}]}
    assert leaves("") is None and leaves(None) is None and leaves("3") is None
    assert [kind_of(x) for x in (True, 1, 1.5, "a", [1])] == ["boolean", "number", "number", "string", "array"]
    assert canonical(3) == canonical(3.0) and canonical([1, 2]) != canonical([2, 1])


LINE = "raw_id long, feed string, source string, snapshot string, line_no long, payload string, path string"


def test_unified_follows_the_schemas(spark):
    """New names and types are followed from the files alone; branches keep what was converted."""
    a = file("f", "1", lambda i: {"id": f"r{i}", "shoe": f"n{i}", "size": i, "tags": ["x"], "feed": "clash"})
    b = file("f", "2", lambda i: {"id": f"r{i}", "boot": {"name": f"n{i}"}, "size": f"{i}" if i < 11 else "odd", "tags": "y", "feed": "clash"}, 20)
    c = file("g", "2", lambda i: {"id": i, "shoe": f"m{i}", "size": True})
    bad = [line(90, "f", "2", "{"), line(91, "f", "2", None), line(92, "g", "2", {"id": "z", "shoe": "s", "boot": {"name": "b"}})]
    rows = [(k, *r[1:]) for k, r in enumerate(a + b + c + bad)]
    df = spark.createDataFrame(rows, LINE)
    got = unified_records(df)
    by = {(r.feed, r.snapshot, r.rec_id): r for r in got.collect()}
    assert len(rows) == got.count() and {"shoe", "size__number", "size__boolean", "tags__array", "feed_2"} <= set(got.columns) and "boot_name" not in got.columns
    assert dict(got.dtypes)["size"] == "string" and dict(got.dtypes)["tags"] == "string"
    one, two, three, both = by["f", "1", "r3"], by["f", "2", "r3"], by["g", "2", "3.0"], by["g", "2", "z"]
    assert (one.shoe, one.size, one.size__number, one.tags, one.tags__array, one.feed_2) == ("n3", "3.0", 3.0, "x", ["x"], "clash")
    assert (two.shoe, two.size, two.size__number, two.tags, two.tags__array) == ("n3", "3", None, "y", None)
    assert (three.shoe, three.size, three.size__boolean, json.loads(three.other_fields)) == ("m3", "true", True, {})
    assert both.shoe == "s" and json.loads(both.other_fields) == {"boot.name": "b"}
    assert sum(r.other_fields is None for r in by.values()) == 1
    few = unified_records(df, most=1)
    assert "size" not in few.columns and all(r.other_fields is None or "size" in r.other_fields or r.rec_id == "z" for r in few.collect())
    assert unified_records(df.limit(0)).columns == ["raw_id", "feed", "snapshot", "line_no", "rec_id", "other_fields"]


def test_alternatives(spark):
    a = file("f", "1", lambda i: {"id": i, "v": 1.5 * i, "w": "x"})
    b = file("f", "2", lambda i: {"id": i, "v": "odd" if i == 3 else 2.5 * i, "w": "x"})
    c = file("f", "3", lambda i: {"id": i, "v": "odd" if i < 5 else True, "w": "x"})
    got = sorted(map(tuple, appearing_alternatives(spark.createDataFrame(a + b + c, LINE)).collect()))
    assert got == [("f", "2", "v", "string", 1, 12), ("f", "3", "v", "boolean", 7, 12)]
    assert appearing_alternatives(spark.createDataFrame([], LINE)).collect() == []
