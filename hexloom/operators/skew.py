"""Per-key results where a few keys hold most of the rows.

Exact offset chunking. The rows of each key are counted per input unit; prefix
sums of the counts give every (unit, key) its first position in one order of all
rows by key; the position of a row is that plus its rank in the unit. Positions
are cut into chunks of equal size, so a task has the same number of rows whether
they belong to one hot key or to a thousand small ones. A chunk folds its rows
into one state for each key; the states of a key, in order of their chunks, are
merged at the boundaries. No key is ever in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.runtime import cut

CHUNK_ROWS = 1 << 17
UNIT_ROWS = 1 << 18
#: Lanes of keys for each shuffle partition of the session.
_LANES = 4


def with_unit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns` with _unit (a block of rows of an input file) and _row (place in the file).

    Both follow from the file alone: a task that runs again after the loss of an
    executor numbers its rows as before, whatever the splits.
    """
    return df.select(
        *columns,
        F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / F.lit(UNIT_ROWS))).alias("_unit"),
        F.col("_metadata.row_index").alias("_row"),
    )


def offsets(counts: DataFrame, key: str) -> DataFrame:
    """(_unit, key, _from): first position of each unit's rows of a key. counts: (_unit, key, n).

    Two levels: keys are dealt to lanes, several for each shuffle partition, and lanes
    are summed first, so no window holds more keys than a partition would. The window of
    a key has one row for each unit.
    """
    lanes_ = _LANES * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.withColumn("_lane", F.pmod(F.xxhash64(key), F.lit(lanes_)))
    totals = counts.groupBy("_lane", key).agg(F.sum("n").alias("_t"))
    lanes = totals.groupBy("_lane").agg(F.sum("_t").alias("_lt"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each lane
    lanes = lanes.select("_lane", F.coalesce(F.sum("_lt").over(before(Window.partitionBy(F.lit(0)).orderBy("_lane"))), F.lit(0)).alias("_lf"))
    keys = totals.select("_lane", key, F.coalesce(F.sum("_t").over(before(Window.partitionBy("_lane").orderBy(key))), F.lit(0)).alias("_kf"))
    keys = keys.join(F.broadcast(lanes), "_lane").select(key, (F.col("_kf") + F.col("_lf")).alias("_kf"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy(key).orderBy("_unit"))), F.lit(0))
    return counts.select("_unit", key, own.alias("_own")).join(keys, key).select("_unit", key, (F.col("_own") + F.col("_kf")).alias("_from"))


def chunked(rows: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`rows` (with _unit and _row) with _pos, its place in the order by key, and _chunk."""
    counts = cut(rows.groupBy("_unit", key).agg(F.count("*").alias("n")))  # small, and used three times
    rank = F.row_number().over(Window.partitionBy("_unit", key).orderBy("_row")) - 1
    placed = rows.join(offsets(counts, key), ["_unit", key]).withColumn("_pos", F.col("_from") + rank)
    return placed.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk_rows))).drop("_from")


def per_key(rows: DataFrame, key: str, *, members: Sequence[str] = (), sums: dict[str, Column] | None = None, ordered: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, n_rows, n_members[, n_turns], *sums): one row for each non-null key, in whole.

    members: columns whose distinct tuples are counted; n_turns (with `ordered`):
    how often that column differs from the row before, in input order, a result
    that needs the order of rows across chunks. sums: named row-wise values to add.

    Rows with a null key are left out. Repeated rows count as rows, and as one
    member. A null in `members` is a value; in `sums` it adds nothing. An empty
    table gives no rows.
    """
    sums = sums or {}
    rows = rows.dropna(subset=[key])
    rows = rows.select(key, "_unit", "_row", *([F.col(ordered).alias("_o")] if ordered else []), *(c.alias(f"_x_{k}") for k, c in sums.items()), *([F.xxhash64(F.lit(1), *[F.coalesce(F.col(m).cast("string"), F.lit("\x00")) for m in members]).alias("_m")] if members else []))
    placed = chunked(rows, key, chunk_rows)
    # One state for each key of a chunk; the chunk number is half of the shuffle key, so a hot key's chunks spread.
    turn = []
    if ordered:
        w = Window.partitionBy("_chunk", key).orderBy("_pos")
        placed = placed.withColumn("_turn", F.coalesce(~F.col("_o").eqNullSafe(F.lag("_o").over(w)) & (F.row_number().over(w) > 1), F.lit(False)).cast("int"))
        turn = [F.sum("_turn").alias("_turns"), F.min_by("_o", "_pos").alias("_first"), F.max_by("_o", "_pos").alias("_last")]
    states = placed.groupBy("_chunk", key).agg(F.count("*").alias("_n"), *turn, *(F.sum(f"_x_{k}").alias(f"_x_{k}") for k in sums))
    merged = [F.sum("_n").alias("n_rows"), *(F.sum(f"_x_{k}").alias(k) for k in sums)]
    if ordered:
        edge = Window.partitionBy(key).orderBy("_chunk")  # one row for each chunk of the key
        joins = F.when(F.row_number().over(edge) > 1, (~F.col("_first").eqNullSafe(F.lag("_last").over(edge))).cast("int")).otherwise(0)
        states = states.withColumn("_turns", F.col("_turns") + joins)
        merged.append(F.sum("_turns").alias("n_turns"))
    out = states.groupBy(key).agg(*merged)
    if members:
        distinct = placed.groupBy("_chunk", key, "_m").agg(F.lit(1)).groupBy(key, "_m").agg(F.lit(1)).groupBy(key).agg(F.count("*").alias("n_members"))
        out = out.join(distinct, key)
    return out
