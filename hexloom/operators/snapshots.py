"""What changed between full snapshots.

A narrow index (key, snapshot number, fingerprints) is kept in buckets of the
key; the rows of a snapshot probe the entries of the snapshot before; values of
the old side are fetched for changes only; then the new entries are the index.

`SnapshotIndex` keeps the index on disk, from delivery to delivery. A delivery is one
snapshot or a backlog of several: their entries and those of the index lie in the
key's bucket, so one shuffle of narrow entries probes all consecutive pairs at once.
`replay_changes` delivers a table that holds all its snapshots.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom import files
from hexloom.runtime import bounded_collect, cut

TOLERANCE_DEG = 0.00001
_EPS = 1e-9


def squeezed(c: str) -> Column:
    """Trimmed, runs of whitespace reduced to one blank (any Unicode white space)."""
    return F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " "))


def _bin(c: str, tol: float) -> Column:
    return F.floor(F.col(c) / F.lit(tol)).cast("bigint")


def fingerprints(df: DataFrame, text: Sequence[Column], coords: Sequence[str], tol: float) -> DataFrame:
    """Adds fp_text (differs only if a text differs) and fp_geo (equal only if within tol)."""
    nulls = [F.coalesce(c, F.lit("\x00")) for c in text]
    bins = [F.coalesce(_bin(c, tol).cast("string"), F.lit("\x00")) for c in coords]
    return df.withColumn("fp_text", F.xxhash64(F.lit(0), *nulls)).withColumn("fp_geo", F.xxhash64(F.lit(0), *bins))


def differs(a: Column, b: Column, tol: float) -> Column:
    """Numbers differ by more than tol; null equals null only."""
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(F.abs(a - b) > F.lit(tol + _EPS))


def valid_entries(df: DataFrame, ids: Sequence[str], version: str | None) -> DataFrame:
    """One entry per ids: that of the row with the latest version.

    Ties on the version are settled by the fingerprints, so that every re-run
    picks the same row. Combined map-side: copies of a hot key never meet unreduced.
    """
    order = F.struct(F.col(version) if version else F.lit(0), "fp_text", "fp_geo")
    return df.groupBy(*ids).agg(F.max(order).alias("_o")).select(*ids, "_o.fp_text", "_o.fp_geo")


class SnapshotIndex:
    """Bucketed key-to-hash index of each group's last snapshot, in a folder all executors share.

    `advance(new)` probes the index with the rows of new full snapshots, writes what
    changed and the new index into a version of its own, and swaps: one file names the
    version that counts and is replaced in one step. A run that dies before leaves the
    old index as it was, one that dies after has its changes written: `changes()` reads
    them. The version before is kept, older ones are dropped.

    group: column within which snapshots follow each other (None: the whole table).
    Only `text` and `coords` count for changed, `coords` beyond `tol`.
    """

    def __init__(self, spark, path: str, *, group: str | None, key: Sequence[str], snapshot: str, version: str | None = None, text: Sequence[Column] = (), coords: Sequence[str] = (), tol: float = TOLERANCE_DEG, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.group, self.key, self.snapshot, self.version = group, list(key), snapshot, version
        self.text, self.coords, self.tol = list(text), list(coords), tol
        self.ids = ["_g", *self.key, "_s"]

    def current(self) -> dict | None:
        at = f"{self.path}/CURRENT.json"
        return files.read_json(self.spark, at) if files.exists(self.spark, at) else None

    def _read(self, part: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version}/{part}")

    def changes(self) -> DataFrame | None:
        """What the last advance() found; None before the first."""
        was = self.current()
        return self._read("changes", was["version"]) if was else None

    def _lean(self, df: DataFrame) -> DataFrame:
        base = df.withColumn("_g", F.col(self.group) if self.group else F.lit("")).withColumn("_s", F.col(self.snapshot)).dropna(subset=self.ids)
        return fingerprints(base, self.text, self.coords, self.tol).select(*self.ids, *([self.version] if self.version else []), *self.coords, "fp_text", "fp_geo")

    def _calendar(self, entries: DataFrame, held: DataFrame | None, known: Sequence | None) -> tuple[DataFrame, list | None]:
        """(_g, _s, _n, _before, _after): snapshots in order; and those in the index, where they are few."""
        none = self.spark.createDataFrame([], entries.select("_g", "_s").schema)
        new = entries.select("_g", "_s").distinct() if known is None else self.spark.createDataFrame([tuple(r) for r in known], none.schema)
        snaps = new.withColumn("_held", F.lit(False))
        if held is not None:
            snaps = snaps.unionByName(held.select("_g", "_s").distinct().withColumn("_held", F.lit(True)))
        schema = snaps.schema
        rows = bounded_collect(snaps)
        if rows is not None:  # calendar-sized, its bound checked
            last: dict = {r["_g"]: r["_s"] for r in rows if r["_held"]}
            if late := sorted({r["_s"] for r in rows if not r["_held"] and r["_g"] in last and r["_s"] <= last[r["_g"]]}):
                raise ValueError(f"delivered after their successors: {', '.join(map(str, late))}")
            snaps = self.spark.createDataFrame([tuple(r) for r in rows], schema)
        order = Window.partitionBy("_g").orderBy("_s")
        snaps = snaps.withColumns({"_n": F.row_number().over(order), "_before": F.lag("_s").over(order), "_after": F.lead("_s").over(order)})
        return (F.broadcast(snaps), sorted(set(last.values()))) if rows is not None else (snaps, None)

    def advance(self, new: DataFrame, old: DataFrame | None = None, snapshots: Sequence | None = None) -> DataFrame:
        """([group], *key, snapshot, before, change): what the snapshots in `new` change, one after the other.

        new: one or more full snapshots, each later than the group's last one; old: rows
        of the snapshots in the index, from which old coordinates are fetched where bins
        differ (needed with coords only); snapshots: the pairs of group ('' without) and
        snapshot in `new`, where the caller knows them. change: added, removed or changed. The first
        snapshot of a group gives no rows; a gap in a record's snapshots gives removed
        and later added. Groups without new snapshots stay as they are.

        Rows with a null key, group or snapshot belong to no record and are ignored.
        Repeated rows count once, of several versions the latest. No rows: no changes.
        Other columns are never read.
        """
        was, version = self.current(), f"v-{uuid.uuid4().hex}"
        held = self._read("index", was["version"]) if was else None
        lean = self._lean(new)
        index = valid_entries(lean, self.ids, self.version)
        snaps, olds = self._calendar(lean, held, snapshots)
        index = (index if held is None else index.unionByName(held)).join(snaps, ["_g", "_s"])
        # All snapshots of a key lie in its bucket: one shuffle of entries probes every consecutive pair.
        bucket = Window.partitionBy("_g", *self.key).orderBy("_n")
        probe = index.withColumns({
            "_pn": F.lag("_n").over(bucket), "_nn": F.lead("_n").over(bucket),
            "_pt": F.lag("fp_text").over(bucket), "_pg": F.lag("fp_geo").over(bucket),
        })
        event = lambda s, before, change: F.struct(F.col(s).alias("_s"), F.col(before).alias("_b"), F.lit(change).alias("change"))
        met = F.coalesce(F.col("_pn") == F.col("_n") - 1, F.lit(False))
        stays = F.coalesce(F.col("_nn") == F.col("_n") + 1, F.lit(False))
        events = F.array_compact(F.array(
            F.when(F.col("_before").isNotNull() & ~met, event("_s", "_before", "added")),
            F.when(met & (F.col("_pt") != F.col("fp_text")), event("_s", "_before", "changed")),
            F.when(met & (F.col("_pt") == F.col("fp_text")) & (F.col("_pg") != F.col("fp_geo")), event("_s", "_before", "moved?")),
            F.when(F.col("_after").isNotNull() & ~stays, event("_after", "_s", "removed")),
        ))
        last = F.col("_after").isNull()
        probe = cut(probe.select(*self.ids, "fp_text", "fp_geo", last.alias("_last"), events.alias("_e")).filter("_last or size(_e) > 0"))
        found = probe.select("_g", *self.key, F.explode("_e").alias("_e")).select("_g", *self.key, "_e.*")
        if self.coords:
            if old is not None and olds is not None:
                old = old.filter(F.col(self.snapshot).isin(olds))
            rows = lean if old is None else lean.unionByName(self._lean(old))
            found = found.filter("change <> 'moved?'").unionByName(self._moved(found.filter("change = 'moved?'"), rows))
        found = found.select(*([F.col("_g").alias(self.group)] if self.group else []), *self.key, F.col("_s").alias(self.snapshot), F.col("_b").alias("before"), "change")
        found.write.parquet(f"{self.path}/{version}/changes")
        entries = probe.filter("_last").select(*self.ids, "fp_text", "fp_geo")
        entries.repartition(*([self.buckets] if self.buckets else []), "_g", *self.key).sortWithinPartitions("_g", *self.key).write.parquet(f"{self.path}/{version}/index")
        files.write_json(self.spark, f"{self.path}/CURRENT.json", {"version": version, "before": was["version"] if was else None})
        for name in files.folders(self.spark, self.path):
            if name.startswith("v-") and name not in (version, was["version"] if was else None):
                files.delete(self.spark, f"{self.path}/{name}")
        return self._read("changes", version)

    def _moved(self, maybe: DataFrame, lean: DataFrame) -> DataFrame:
        """Those of `maybe` whose coordinates differ: old and new values are fetched for them only."""
        maybe = maybe.select("_g", *self.key, "_s", "_b")
        sides = maybe.select("_g", *self.key, F.col("_s").alias("_at"), F.explode(F.array("_s", "_b")).alias("_s"), "_b")
        order = F.struct(F.col(self.version) if self.version else F.lit(0), "fp_text", "fp_geo")
        values = lean.join(sides, self.ids).groupBy("_g", *self.key, "_at", "_b").agg(
            F.max_by(F.struct(*self.coords), F.when(F.col("_s") == F.col("_at"), order)).alias("_new"),
            F.max_by(F.struct(*self.coords), F.when(F.col("_s") == F.col("_b"), order)).alias("_old"),
        )
        moved = F.lit(False)
        for c in self.coords:
            moved = moved | differs(F.col(f"_new.{c}"), F.col(f"_old.{c}"), self.tol)
        return values.filter(moved).select("_g", *self.key, F.col("_at").alias("_s"), "_b", F.lit("changed").alias("change"))


def replay_changes(df: DataFrame, *, group: str | None, key: Sequence[str], snapshot: str, **how) -> DataFrame:
    """The changes of a table that holds all its snapshots, delivered to a fresh index: the backlog at once, then each group's latest.

    Columns, rules and further arguments are those of SnapshotIndex.
    """
    index = SnapshotIndex(df.sparkSession, files.shared_folder(df.sparkSession, "index"), group=group, key=key, snapshot=snapshot, **how)
    g = F.col(group) if group else F.lit("")
    pairs = bounded_collect(df.select(g.alias("g"), F.col(snapshot).alias("s")).dropna().distinct())
    if pairs is None:
        return index.advance(df)
    of: dict = {}
    for r in pairs:
        of.setdefault(r.g, []).append(r.s)
    latest = {(k, max(v)) for k, v in of.items() if len(v) > 1}
    if not latest:
        return index.advance(df, snapshots=pairs)
    # Literals, so that the scan skips what is not delivered.
    is_last = F.concat_ws("\x1f", g, snapshot).isin(sorted(f"{a}\x1f{b}" for a, b in latest)) & F.col(snapshot).isin(sorted({b for _, b in latest}))
    backlog = df.filter(~is_last)
    before = index.advance(backlog, snapshots=[r for r in pairs if tuple(r) not in latest])
    # The first changes are read again where they were written: a second delivery keeps the version before.
    return before.unionByName(index.advance(df.filter(is_last), old=backlog, snapshots=sorted(latest)))


def fetch_values(changes: DataFrame, df: DataFrame, *, group: str | None, key: Sequence[str], snapshot: str, version: str | None, values: Sequence[str]) -> DataFrame:
    """`changes` with structs old and new of the values on either side (null where there is none)."""
    ids = [*([group] if group else []), *key]
    sides = changes.select(*ids, F.col(snapshot).alias("_at"), "change", F.explode(F.array(F.struct(F.col(snapshot).alias("_s"), F.lit(1).alias("_w")), F.struct(F.col("before").alias("_s"), F.lit(0).alias("_w")))).alias("_x")).select(*ids, "_at", "change", "_x.*")
    rows = df.select(*ids, F.col(snapshot).alias("_s"), *([version] if version else []), *values)
    order = F.struct(F.col(version) if version else F.lit(0), F.xxhash64(*values))
    pick = lambda w: F.max_by(F.struct(*values), F.when(F.col("_w") == w, order))
    return sides.join(rows, [*ids, "_s"]).groupBy(*ids, F.col("_at").alias(snapshot), "change").agg(pick(0).alias("old"), pick(1).alias("new"))


def latest_valid(df: DataFrame, *, group: str, key: str, snapshot: str, version: str, values: Sequence[str]) -> DataFrame:
    """(group, key, *values) of each key's valid row in its group's latest snapshot.

    The filter on the latest snapshots is made of literals, so that the scan skips
    the others. Ties on the version: the row whose values have the largest hash.
    """
    df = df.select(group, key, snapshot, version, *values)
    last = df.groupBy(group).agg(F.max(snapshot).alias("_last")).dropna()
    rows = bounded_collect(last)
    if rows is None:
        now = df.join(last, group).filter(F.col(snapshot) == F.col("_last"))
    else:
        now = df.filter(F.concat_ws("\x1f", group, snapshot).isin([f"{g}\x1f{s}" for g, s in rows]) & F.col(snapshot).isin([s for _, s in rows]))
    order = F.struct(version, F.xxhash64(F.lit(0), *values))
    return now.dropna(subset=[group, key]).groupBy(group, key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(group, key, "_v.*")
