"""Schemas that drift between files of JSON lines.

Tagged-union inference: every task fuses the lines it reads into one schema for
each file that keeps all types met on a path beside each other, with their counts
(string, number, boolean, array: the branches of a tagged union). Schemas fuse by
adding counts, so they combine in any order. Consecutive schemas of a feed then
tell which paths came, went or took another type, and the values of records in
both files tell a renamed field from two unrelated ones.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.operators.graph import components
from hexloom.runtime import cut

KINDS = ("string", "number", "boolean", "array")
#: A path has the type of at least this share of its values.
MAIN_SHARE = 0.9
#: Renamed: the values agree for this share of the records in both files that have the old or the new field.
SAME_SHARE = 0.8
LEAST_SAME = 2


def leaves(payload: str | None) -> dict[str, object] | None:
    """Dotted leaf paths and their non-null values; None for a line that is no JSON object."""
    try:
        top = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out, todo = {}, [("", top)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else k, v) for k, v in x.items()]
        elif x is not None:
            out[at] = x
    return out


def kind_of(x: object) -> str:
    return "boolean" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "array" if isinstance(x, list) else "string"


def canonical(x: object) -> str:
    """One text for equal values: 3 and 3.0 agree, arrays keep their order."""
    if isinstance(x, int | float) and not isinstance(x, bool):
        return repr(float(x)) if abs(x) < 1e300 else str(x)
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)


def fused_schemas(lines: DataFrame) -> DataFrame:
    """(feed, snapshot, path, string, number, boolean, array): counts of values by type.

    lines: feed, snapshot, payload. A file's readable lines also count under the path
    '' so that a file without fields is still there. Fused within each task first:
    a feed that holds most of the lines costs its tasks no more than any other.
    """

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        empty = True
        for b in batches:
            for feed, snapshot, payload in zip(b["feed"], b["snapshot"], b["payload"]):
                counts[feed, snapshot, "", "string"] += 1
                for path, x in (leaves(payload) or {}).items():
                    counts[feed, snapshot, path, kind_of(x)] += 1
            if len(counts) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["feed", "snapshot", "path", "kind", "n"])
                counts.clear()
            empty = False
        if counts or empty:
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["feed", "snapshot", "path", "kind", "n"])

    parts = lines.select("feed", "snapshot", "payload").dropna(subset=["feed", "snapshot"]).mapInPandas(fuse, "feed string, snapshot string, path string, kind string, n bigint")
    return parts.groupBy("feed", "snapshot", "path").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS))


def main_type() -> Column:
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return F.coalesce(*(F.when(F.col(k) >= MAIN_SHARE * total, F.lit(k)) for k in KINDS))


def path_events(schemas: DataFrame) -> DataFrame:
    """(feed, snapshot, before, path, change, kind): added, removed or type of each path against the file before."""
    files = schemas.filter(F.col("path") == "").select("feed", "snapshot")
    w = Window.partitionBy("feed").orderBy("snapshot")  # one row for each file of the feed
    files = files.select("feed", "snapshot", F.row_number().over(w).alias("n"), F.lag("snapshot").over(w).alias("before"), F.lead("snapshot").over(w).alias("after"))
    at = schemas.filter(F.col("path") != "").select("feed", "snapshot", "path", main_type().alias("kind")).join(files, ["feed", "snapshot"])
    p = Window.partitionBy("feed", "path").orderBy("n")
    at = at.withColumns({"pn": F.lag("n").over(p), "pk": F.lag("kind").over(p), "nn": F.lead("n").over(p)})
    met = F.coalesce(F.col("pn") == F.col("n") - 1, F.lit(False))
    event = lambda s, b, change: F.struct(F.col(s).alias("snapshot"), F.col(b).alias("before"), F.lit(change).alias("change"))
    events = F.array_compact(F.array(
        F.when(F.col("before").isNotNull() & ~met, event("snapshot", "before", "added")),
        F.when(met & (F.col("kind") != F.col("pk")), event("snapshot", "before", "type")),
        F.when(F.col("after").isNotNull() & ~F.coalesce(F.col("nn") == F.col("n") + 1, F.lit(False)), event("after", "snapshot", "removed")),
    ))
    return at.select("feed", "path", "kind", F.explode(events).alias("e")).select("feed", "e.snapshot", "e.before", "path", "e.change", "kind")


def _renames(lines: DataFrame, events: DataFrame, id_path: str) -> DataFrame:
    """(feed, snapshot, old_field, field) of fields that go and come with the same values."""
    gone = F.array_sort(F.collect_set(F.when(F.col("change") == "removed", F.col("path"))))
    came = F.array_sort(F.collect_set(F.when(F.col("change") == "added", F.col("path"))))
    both = events.groupBy("feed", "snapshot", "before").agg(gone.alias("gone"), came.alias("came")).filter((F.size("gone") > 0) & (F.size("came") > 0))
    wanted = both.select("feed", F.explode(F.array(
        F.struct(F.col("before").alias("snapshot"), F.col("snapshot").alias("at"), F.lit(0).alias("side"), F.col("gone").alias("paths")),
        F.struct(F.col("snapshot").alias("snapshot"), F.col("snapshot").alias("at"), F.lit(1).alias("side"), F.col("came").alias("paths")),
    )).alias("w")).select("feed", "w.*")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for feed, at, side, paths, payload in zip(b["feed"], b["at"], b["side"], b["paths"], b["payload"]):
                x = leaves(payload)
                if x and id_path in x:
                    rows.append((feed, at, side, canonical(x[id_path]), {p: f"{kind_of(x[p])[0]}{canonical(x[p])}" for p in paths if p in x}, list(paths)))
            yield pd.DataFrame(rows, columns=["feed", "at", "side", "id", "v", "paths"])

    lines = lines.select("feed", "snapshot", "payload").dropna(subset=["feed", "snapshot"])
    values = lines.join(wanted, ["feed", "snapshot"]).mapInPandas(pick, "feed string, at string, side int, id string, v map<string,string>, paths array<string>")
    # Of repeated lines of a record one counts: the largest text, the same on every run.
    values = values.groupBy("feed", "at", "side", "id").agg(F.max_by(F.struct("v", "paths"), F.to_json("v")).alias("x"))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("x.v").isNotNull()))
    pairs = values.groupBy("feed", "at", "id").agg(
        F.max_by("x", F.when(F.col("side") == 0, 1)).alias("o"), F.max_by("x", F.when(F.col("side") == 1, 1)).alias("n"), side(0).alias("has_o"), side(1).alias("has_n")
    ).filter("has_o and has_n")
    # One row for each field and for each two fields with equal values; fields that differ are never paired.
    one = lambda o, n: F.struct(o.cast("string").alias("old_field"), n.cast("string").alias("field"))
    olds, news = F.map_keys("o.v"), F.map_keys("n.v")
    equal = F.flatten(F.transform(olds, lambda o: F.transform(F.filter(news, lambda n: F.col("n.v")[n] == F.col("o.v")[o]), lambda n: one(o, n))))
    each = F.concat(F.transform(olds, lambda o: one(o, F.lit(None))), F.transform(news, lambda n: one(F.lit(None), n)), equal)
    tally = _cut(pairs.select("feed", "at", F.explode(each).alias("e")).groupBy("feed", "at", "e.old_field", "e.field").agg(F.count("*").alias("n")))
    had = lambda c, other, n: tally.filter(F.col(c).isNotNull() & F.col(other).isNull()).select("feed", "at", c, F.col("n").alias(n))
    score = tally.filter("old_field is not null and field is not null").withColumnRenamed("n", "same")
    score = score.join(had("old_field", "field", "no"), ["feed", "at", "old_field"]).join(had("field", "old_field", "nn"), ["feed", "at", "field"])
    score = score.withColumn("share", F.try_divide("same", F.greatest("no", "nn"))).filter((F.col("share") >= SAME_SHARE) & (F.col("same") >= LEAST_SAME))
    best = lambda mine, other: Window.partitionBy("feed", "at", mine).orderBy(F.desc("share"), F.desc("same"), other)
    score = score.withColumn("ro", F.row_number().over(best("old_field", "field"))).withColumn("rn", F.row_number().over(best("field", "old_field")))
    return score.filter("ro = 1 and rn = 1").select("feed", F.col("at").alias("snapshot"), "old_field", "field")


def schema_history(lines: DataFrame, id_path: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fused schemas, events of paths, renames (feed, snapshot, old_field, field))."""
    fused = _cut(fused_schemas(lines))
    events = _cut(path_events(fused))
    return fused, events, _cut(_renames(lines, events, id_path))


def field_changes(lines: DataFrame, id_path: str = "id") -> DataFrame:
    """(feed, snapshot, field, old_field, change) between consecutive files of a feed.

    lines: feed, snapshot, payload (JSON text). change: added, removed, renamed or
    type; old_field is '' but for renamed. Lines that are null, cut off or no object
    give no fields; a field that is null or left out in all lines of a file is not in
    it; a path without a type that nine in ten of its values have is never reported
    as type. Rows with a null feed or snapshot are ignored; repeated lines change
    nothing; an empty table gives no rows.
    """
    _, events, renamed = schema_history(lines, id_path)
    went = renamed.select("feed", "snapshot", F.explode(F.array(F.struct(F.col("old_field").alias("path"), F.lit("removed").alias("change")), F.struct(F.col("field").alias("path"), F.lit("added").alias("change")))).alias("x")).select("feed", "snapshot", "x.*")
    plain = events.join(went, ["feed", "snapshot", "path", "change"], "left_anti").select("feed", "snapshot", F.col("path").alias("field"), F.lit("").alias("old_field"), "change")
    return plain.unionByName(renamed.select("feed", "snapshot", "field", "old_field", F.lit("renamed").alias("change")))


def appearing_alternatives(lines: DataFrame) -> DataFrame:
    """(feed, snapshot, field, alternative, values, of): types met at a path in a file, but not in the feed's last file before it that has the path.

    values of the `of` values at the path have the type. Nulls, unreadable lines and
    empty tables as in field_changes().
    """
    fused = fused_schemas(lines).filter("path <> ''")
    before = Window.partitionBy("feed", "path").orderBy("snapshot")  # one row for each file
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    new = [F.when((F.col(k) > 0) & (F.lag(k).over(before) == 0), F.struct(F.lit(k).alias("alternative"), F.col(k).alias("values"))) for k in KINDS]
    got = fused.withColumns({"of": total, "_new": F.array_compact(F.array(*new))})
    return got.select("feed", "snapshot", F.col("path").alias("field"), F.explode("_new").alias("x"), "of").select("feed", "snapshot", "field", "x.*", "of")


def _cut(df: DataFrame) -> DataFrame:
    return cut(df)


#: Most fields that get columns of their own; the values of the rarest beyond stay in other_fields.
MOST_COLUMNS = 500
_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>"}


def lineages(fused: DataFrame, renamed: DataFrame) -> DataFrame:
    """(path, field, string, number, boolean, array): every path with the field it belongs to and the field's counts by type.

    Paths that a rename joins, in any feed, are one field; it bears the path that holds
    most of its values.
    """
    counts = fused.filter("path <> ''").groupBy("path").agg(*(F.sum(k).alias(k) for k in KINDS))
    ids = _cut(counts.withColumn("id", F.xxhash64("path")).withColumn("n", sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))))
    same = components(renamed.select(F.xxhash64("old_field").alias("a"), F.xxhash64("field").alias("b")))
    own = ids.join(same, "id", "left").withColumn("group", F.coalesce("component", "id"))
    fields = own.groupBy("group").agg(F.max_by("path", F.struct("n", "path")).alias("field"), *(F.sum(k).alias(k) for k in KINDS))
    return own.select("group", "path", F.col("n").alias("path_n")).join(fields, "group").drop("group")


def converted(x: object, kind: str) -> object:
    """The value as another type: numbers from text, the only entry for an array of one, text from all; None where that can't be."""
    if kind_of(x) == kind:
        return [canonical(v) for v in x] if kind == "array" else float(x) if kind == "number" else x
    if kind == "array":
        return [canonical(x)]
    if isinstance(x, list):
        return converted(x[0], kind) if len(x) == 1 else None
    if kind == "string":
        return canonical(x)
    if kind == "boolean":
        return {"true": True, "false": False}.get(x.lower()) if isinstance(x, str) else None
    try:
        return None if isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def column_of(path: str) -> str:
    return path.replace(".", "_").replace("`", "_")


def unified_records(lines: DataFrame, id_path: str = "id", keep: tuple = ("raw_id", "feed", "snapshot", "line_no"), most: int = MOST_COLUMNS) -> DataFrame:
    """One consistent table of all lines: `keep`, rec_id, a column for each field, typed branches of those with several types, other_fields.

    The columns follow from the fused schemas and the renames between files, not from a
    list. A field's column has the type most of its values have; a value of another type
    stands converted in it, and as it came in the branch <field>__<type>. Where a line
    has several paths of a field, the one with more values overall gives the value and
    the rest stay in other_fields (a JSON object by path), as do the fields beyond `most`.
    Every line gives a row; an unreadable one has null fields and other_fields. Fields
    whose names clash with one another or with `keep` are told apart by a number.
    """
    fused, _, renamed = schema_history(lines, id_path)
    known = lineages(fused, renamed).filter(F.col("field") != id_path)
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    ranked = known.select("field", *KINDS).dropDuplicates(["field"]).orderBy(total.desc(), "field").limit(most)  # a table's columns: few enough for the driver
    fields: dict[str, tuple[str, dict[str, str]]] = {}
    names = {*keep, "rec_id", "other_fields"}
    columns: list[tuple[str, str]] = []
    for r in ranked.collect():
        main = max(KINDS, key=lambda k: (r[k], -KINDS.index(k)))
        name = base = column_of(r.field)
        at = 2
        while name in names:
            name, at = f"{base}_{at}", at + 1
        branches = {k: f"{name}__{k}" for k in KINDS if k != main and r[k]}
        names.update([name, *branches.values()])
        columns += [(name, main), *((c, k) for k, c in branches.items())]
        fields[r.field] = (name, {main: name, **branches})
    kinds = dict(columns)
    paths = {r.path: (r.field, r.path_n) for r in known.join(F.broadcast(ranked.select("field")), "field", "left_semi").select("path", "field", "path_n").collect()} if fields else {}

    def unify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols: dict[str, list] = {c: [None] * len(b) for c in ["rec_id", *kinds, "other_fields"]}
            for i, payload in enumerate(b["payload"]):
                x = leaves(payload)
                if x is None:
                    continue
                other: dict[str, object] = {}
                best: dict[str, tuple[int, str]] = {}
                for p in x:
                    if p in paths:
                        field, n = paths[p]
                        best[field] = max(best.get(field, (-1, "")), (n, p))
                for p, v in x.items():
                    if p == id_path:
                        cols["rec_id"][i] = canonical(v)
                    elif p not in paths or best[paths[p][0]][1] != p:
                        other[p] = v
                    else:
                        name, branches = fields[paths[p][0]]
                        kind = kind_of(v)
                        cols[name][i] = converted(v, kinds[name])
                        if branches[kind] != name:
                            cols[branches[kind]][i] = converted(v, kind)
                cols["other_fields"][i] = json.dumps(other, ensure_ascii=False, sort_keys=True)
            out = b[list(keep)].copy()
            for c, v in cols.items():
                out[c] = pd.Series(v, index=out.index, dtype="float64" if kinds.get(c) == "number" else "object")
            yield out

    types = dict(lines.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "rec_id string", *(f"`{c}` {_TYPES[k]}" for c, k in columns), "other_fields string"])
    return lines.select(*keep, "payload").mapInPandas(unify, schema)
