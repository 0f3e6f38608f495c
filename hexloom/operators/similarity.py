"""Set-similarity join within blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_pairs(sets: DataFrame, least: float, block: str = "block", id_: str = "id", grams: str = "grams", around: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: pairs of one block whose sets have a Jaccard similarity of at least `least`.

    around: (block, id) gives further blocks in which the sets of `sets` may be met
    from; without it a pair must share its own block.

    Exact, by prefix filtering: members are ordered from rare to common over all rows;
    of two sets as similar as asked some member is among the first few of either. Only
    sets that share such a member meet. Rows with a null block, id or an empty set
    pair with none; sets hold no repeated members.
    """
    rows = sets.select(F.col(block).alias("block"), F.col(id_).alias("id"), F.col(grams).alias("g0")).dropna().filter(F.size("g0") > 0)
    # Members as 64-bit numbers: half the shuffle, and sets of numbers intersect faster.
    held = rows.select("block", "id", F.explode("g0").alias("gram")).withColumn("gram", F.xxhash64("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    ordered = held.join(often, "gram").groupBy("block", "id").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).getField("gram").alias("g"))
    n = F.size("g")
    first = ordered.withColumn("gram", F.explode(F.slice("g", F.lit(1), n - F.ceil(F.lit(least) * n).cast("int") + 1)))
    left = first.select("block", "gram", F.col("id").alias("a"), F.col("g").alias("ga"))
    other = first if around is None else first.drop("block").join(around.select(F.col(block).alias("block"), F.col(id_).alias("id")).dropna(), "id")
    right = other.select("block", "gram", F.col("id").alias("b"), F.col("g").alias("gb"))
    near = (F.col("a") < F.col("b") if around is None else F.col("a") != F.col("b")) & (F.size("ga") >= F.lit(least) * F.size("gb")) & (F.size("gb") >= F.lit(least) * F.size("ga"))
    same = F.size(F.array_intersect("ga", "gb"))
    met = left.join(right, ["block", "gram"]).filter(near)
    return met.filter(same >= F.lit(least) * (F.size("ga") + F.size("gb") - same)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()
