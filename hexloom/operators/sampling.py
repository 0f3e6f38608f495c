"""Samples that every engine draws alike: rows are ordered by an arithmetic hash of their id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME, STEP = 1_000_003, 7_919


def draw(id_: Column, seed: int) -> Column:
    return F.pmod(id_ * STEP + seed, F.lit(PRIME))


def sql_draw(id_: str, seed: int) -> str:
    return f"(({id_} * {STEP} + {seed}) % {PRIME})"


def stratified(df: DataFrame, strata: Sequence[str], id_: str, floor: int, total: int, seed: int = 1) -> DataFrame:
    """`floor` rows of each stratum, topped up from the rest to `total` in all. Ties by id.

    The rank in a stratum is by window; a hot stratum's rows are first cut to `total`
    by their own draw, which can't change the outcome.
    """
    d = df.withColumn("_d", draw(F.col(id_), seed))
    lane = Window.partitionBy(*strata, F.pmod(F.col(id_), F.lit(64))).orderBy("_d", id_)
    d = d.withColumn("_l", F.row_number().over(lane)).filter(F.col("_l") <= total)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy("_d", id_)))
    base = d.filter(F.col("_k") <= floor)
    n = base.agg(F.count("*").alias("_n"))
    rest = d.filter(F.col("_k") > floor).orderBy("_d", id_).limit(total)
    rest = rest.withColumn("_o", F.row_number().over(Window.orderBy("_d", id_))).join(F.broadcast(n), F.lit(True)).filter(F.col("_o") + F.col("_n") <= total)
    return base.drop("_d", "_l", "_k").unionByName(rest.drop("_d", "_l", "_k", "_o", "_n"))


def proportional(df: DataFrame, region: str, id_: str, total: int, floor: int, seed: int = 1) -> DataFrame:
    """Each region's share of `total` by its size, at least `floor` rows (or all it has)."""
    sizes = df.groupBy(region).agg(F.count("*").alias("_n"))
    all_ = sizes.agg(F.sum("_n").alias("_a"))
    take = F.greatest(F.lit(floor), F.floor(F.col("_n") * F.lit(total) / F.col("_a")))
    sizes = sizes.join(F.broadcast(all_), F.lit(True)).select(F.col(region).alias("_r"), take.alias("_take"))
    rows = df.join(sizes, F.col(region).eqNullSafe(F.col("_r"))).withColumn("_d", draw(F.col(id_), seed))
    lane = Window.partitionBy(region, F.pmod(F.col(id_), F.lit(64))).orderBy("_d", id_)
    rows = rows.withColumn("_l", F.row_number().over(lane)).filter(F.col("_l") <= F.col("_take"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(region).orderBy("_d", id_))).filter(F.col("_k") <= F.col("_take")).drop("_r", "_take", "_d", "_l", "_k")


def banded(df: DataFrame, region: str, band: str, id_: str, total: int, floor: int, seed: int = 1) -> DataFrame:
    """Each region's share of `total` as in proportional() (but no more than it has), dealt to its bands by their size, one each at least; the bands come in order until the share is full.

    Shares are rounded, halves to the even number.
    """
    n = df.groupBy(region, band).agg(F.count("*").alias("_nb"))
    by = n.groupBy(region).agg(F.sum("_nb").alias("_n"))
    all_ = by.agg(F.sum("_n").alias("_a"))
    by = by.join(F.broadcast(all_), F.lit(True)).select(F.col(region).alias("_r"), "_n", F.least(F.col("_n"), F.greatest(F.lit(floor), F.bround(F.col("_n") * float(total) / F.col("_a")).cast("bigint"))).alias("_take"))
    n = n.join(by, F.col(region).eqNullSafe(F.col("_r"))).select("_r", F.col(band).alias("_b"), "_take", F.greatest(F.lit(1), F.bround(F.col("_take") * F.col("_nb") / F.col("_n")).cast("bigint")).alias("_k"))
    rows = df.join(n, F.col(region).eqNullSafe(F.col("_r")) & F.col(band).eqNullSafe(F.col("_b"))).withColumn("_d", draw(F.col(id_), seed))
    # Lanes first, so that no window sorts a hot band's rows.
    lane = Window.partitionBy("_r", "_b", F.pmod(F.col(id_), F.lit(64))).orderBy("_d", id_)
    rows = rows.withColumn("_l", F.row_number().over(lane)).filter(F.col("_l") <= F.col("_k"))
    rows = rows.withColumn("_l", F.row_number().over(Window.partitionBy("_r", "_b").orderBy("_d", id_))).filter(F.col("_l") <= F.col("_k"))
    rows = rows.withColumn("_l", F.row_number().over(Window.partitionBy("_r").orderBy("_b", "_d", id_))).filter(F.col("_l") <= F.col("_take"))
    return rows.drop("_r", "_b", "_take", "_k", "_d", "_l")


def binned(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the bin: [a, b) or, with right, (a, b]; outside all bins null."""
    out = F.when(F.lit(False), "")
    for a, b, name in zip(edges, edges[1:], labels):
        out = out.when((c > a) & (c <= b) if right else (c >= a) & (c < b), name)
    return out
