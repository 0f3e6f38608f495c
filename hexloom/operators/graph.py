"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.runtime import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex on an edge; component is the least id in it.

    Contraction: in every round each vertex moves to one of itself and its neighbours,
    the one with the least hash of that round; edges move along, equal ones melt, until
    none joins two ids. The hash changes from round to round, so a long chain shrinks by
    a constant share each time, whatever its ids. Loops and repeated edges change
    nothing; edges with a null end are ignored; no edges, no rows. Every round's tables
    are written, and dropped when the next ones are.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    e = edges_ = cut(e.dropDuplicates())
    labels = e.select(F.explode(F.array("a", "b")).alias("id")).dropDuplicates().withColumn("label", F.col("id"))
    e = e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()
    k = 0
    while not e.isEmpty():  # the end with the least hash of a round draws its neighbours: some edge goes in every round
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        move = cut(both.groupBy("a").agg(F.min(rank("b")).alias("n")).select("a", F.least(rank("a"), F.col("n"))["id"].alias("m")))
        now = cut(labels.join(move, labels["label"] == move["a"], "left").select("id", F.coalesce("m", "label").alias("label")))
        moved = e.join(move.withColumnRenamed("m", "ma"), "a").join(move.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").filter("ma <> mb")
        moved = cut(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).dropDuplicates())
        for done in (labels, e, move, *([edges_] if k == 0 else [])):
            release(done)
        labels, e = now, moved
        k += 1
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
