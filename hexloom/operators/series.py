"""Time series of cells: bulk-import steps, corrected trends, shapes, runs.

Series are ordered by snapshot id and positional over the rows present: a missing
snapshot is no zero. Windows are by series, whose length is the number of snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.config import T


def _w(series: Sequence[str], order: str):
    return Window.partitionBy(*series).orderBy(order)


def with_artifacts(df: DataFrame, series: Sequence[str], order: str, value: str, floors: bool = True) -> DataFrame:
    """df with ord (from 1), n, jump_pct and hit.

    hit: a jump of T.jump_pct or more after which the next T.min_flat - 1 readings
    stay within T.flat_pct of the new level. With floors only upward jumps from a base
    of T.min_base by at least T.min_abs_jump count; without, jumps either way.
    """
    w = _w(series, order)
    v, prev = F.col(value), F.lag(value).over(w)
    flat = [F.abs(100 * F.try_divide(F.lead(value, k).over(w) - v, v)) <= T.flat_pct for k in range(1, T.min_flat)]
    jump = 100 * F.try_divide(v - prev, prev)
    hit = (jump >= T.jump_pct) & (prev >= T.min_base) & (v - prev >= T.min_abs_jump) if floors else F.abs(jump) >= T.jump_pct
    for f in flat:
        hit = hit & f
    return df.withColumns({"ord": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*series)), "jump_pct": jump, "hit": F.coalesce(hit, F.lit(False))})


def with_exclusion(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """df (of with_artifacts) with base_ord, the last hit's place, and excluded: before it."""
    base = F.max(F.when(F.col("hit"), F.col("ord"))).over(Window.partitionBy(*series))
    return df.withColumn("base_ord", base).withColumn("excluded", F.coalesce(F.col("ord") < F.col("base_ord"), F.lit(False)))


def growth_pct(first: Column, last: Column, n: Column) -> Column:
    """First to last in percent, one decimal; null below two readings or from nothing."""
    return F.when(n >= 2, F.round(100 * F.try_divide(last - first, first), 1))


def trends(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """One row a series of with_exclusion's rows: raw and corrected growth and what became of the correction."""
    kept = ~F.col("excluded")
    pick = lambda f, cond: f(value, F.when(cond, F.col("ord")))
    t = df.groupBy(*series).agg(
        F.count("*").alias("points"), F.count_if("hit").alias("hits"), F.count_if(kept).alias("kept"), F.min_by(value, "ord").alias("first"), F.max_by(value, "ord").alias("last"), pick(F.min_by, kept).alias("base"),
    )
    status = F.when(F.col("hits") == 0, "not_needed").when(F.col("kept") < T.min_corrected_points, "withheld_too_short").otherwise("applied")
    raw = growth_pct(F.col("first"), F.col("last"), F.col("points"))
    corrected = F.when(status == "applied", growth_pct(F.col("base"), F.col("last"), F.col("kept")))
    t = t.select(*series, "points", "hits", "kept", raw.alias("raw_pct"), corrected.alias("corrected_pct"), status.alias("status"))
    return t.withColumn("diverges", F.coalesce(F.abs(F.col("raw_pct") - F.col("corrected_pct")) >= T.divergence_points, F.lit(False)))


def shape(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """One row a series: flat, dip, peak or slope, by where its least and greatest reading stand. df has ord and n."""
    s = df.groupBy(*series).agg(F.max("n").alias("n"), F.min_by("ord", F.struct(value, "ord")).alias("low_at"), F.min_by("ord", F.struct(-F.col(value), "ord")).alias("high_at"), F.min(value).alias("low"), F.max(value).alias("high"))
    inner = lambda c: (F.col(c) > 1) & (F.col(c) < F.col("n"))
    kind = F.when(F.col("high") - F.col("low") <= 0.05 * F.col("high"), "flat").when(inner("low_at") & ~inner("high_at"), "dip").when(inner("high_at") & ~inner("low_at"), "peak").otherwise("slope")
    return s.select(*series, "low_at", "high_at", kind.alias("shape"))


def runs(df: DataFrame, series: Sequence[str], ordinal: str) -> DataFrame:
    """(*series, start, stop, length) of unbroken runs of ordinals: gaps and islands."""
    island = F.col(ordinal) - F.row_number().over(_w(series, ordinal))
    return df.withColumn("_i", island).groupBy(*series, "_i").agg(F.min(ordinal).alias("start"), F.max(ordinal).alias("stop"), F.count("*").alias("length")).drop("_i")


def direction(pct: Column) -> Column:
    return F.when(pct > T.direction_band_pct, "up").when(pct < -T.direction_band_pct, "down").when(pct.isNotNull(), "flat")


def open_as_of(records: DataFrame, spine: DataFrame, at: str, created: str, closed: str) -> DataFrame:
    """(at, n_open) for every point of a spine: records created by then and not closed by then.

    Counted from events, not from a join of all records with all points: one opens at
    its creation, one shuts at its close; the running sum at each point is the count.
    """
    events = records.select(F.col(created).alias("t"), F.lit(1).alias("v")).unionByName(records.filter(F.col(closed).isNotNull()).select(F.col(closed).alias("t"), F.lit(-1).alias("v")))
    events = events.dropna(subset=["t"]).groupBy("t").agg(F.sum("v").alias("v"))  # one row for each date
    w = Window.partitionBy(F.lit(0)).orderBy("t", "mark").rowsBetween(Window.unboundedPreceding, 0)
    both = events.select("t", "v", F.lit(0).alias("mark")).unionByName(spine.select(F.col(at).alias("t"), F.lit(0).cast("bigint").alias("v"), F.lit(1).alias("mark")))
    return both.withColumn("n_open", F.sum("v").over(w)).filter("mark = 1").select(F.col("t").alias(at), "n_open")
