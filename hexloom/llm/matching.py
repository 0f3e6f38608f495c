"""Records of two sources that share no key but describe the same thing.

The q-grams of a record's folded name are encoded as a fixed vector of 128 bits.
Pairs within a Hamming distance of 5 are found exactly by multi-index hashing: the
vector is cut into two halves, of a close pair at least one half differs by two
bits or less (pigeonhole), and halves that close share a key once up to two set
bits are left out on either side. Locations join the key as cells, so that only
records near each other meet. Name (Dice of the bits), distance and category are
weighed as fields; the weights and the confidence come from the two-class mixture
that explains how often each pattern of field scores occurs. Of the pairs that are
more likely one thing than two, the words are compared in the end.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.llm.names import core_words, grams, soft_likeness
from hexloom.operators.near import EARTH_M
from hexloom.operators.snapshots import latest_valid
from hexloom.runtime import cut

BITS, HALVES, OFF = 128, 2, 2
RADIUS = HALVES * (OFF + 1) - 1
CELL_DEG = 0.02
MAX_M = 500.0
#: Rule on the words that follows the bits: beyond it a word differs by more than misspelling.
LEAST_LIKENESS = 0.84
#: Confidence from which the words of a pair are compared: few of the pairs below have words that agree.
LEAST_CONFIDENCE = 0.005
#: Edges of the levels of Dice and distance.
DICE_EDGES, METRE_EDGES = (0.7, 0.76, 0.82, 0.88, 0.94), (50.0, 100.0, 200.0, 350.0)
#: Rows that the cells of one vector are dealt to.
CELL_LANES = 32
#: Ids that lack a field in the latest snapshot are broadcast up to this many.
FILL_BOUND = 200_000
_EMPTY: tuple[str, ...] = ()
#: Tells the key classes of each half apart.
_CLASS = [[((k * 3 + c) * 0x9E3779B97F4A7C15) % 2**64 for c in range(1, 4)] for k in range(HALVES)]


@lru_cache(200_000)
def _word_bits(word: str) -> int:
    out = 0
    for g in grams((word,)):
        out |= 1 << (zlib.crc32(g.encode()) % BITS)
    return out


def signature(words: tuple[str, ...]) -> int:
    out = 0
    for w in words:
        out |= _word_bits(w)
    return out


def _halves(bits: int) -> list[int]:
    return [(bits >> (64 * k)) & (2**64 - 1) for k in range(HALVES)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def probe_keys(halves: list[int], right: bool) -> np.ndarray:
    """Keys of a vector: two vectors of which some half differs by up to OFF = 2 bits share one.

    Three classes of keys by the bits left out on either side: up to one on both,
    none here and two there, two here and none there. Each covers distances up to 2 only.
    """
    out = []
    for k, half in enumerate(halves):
        at = [1 << i for i in range(64) if half >> i & 1]
        few = [half, *(half ^ b for b in at)]
        two = [half ^ a ^ b for a, b in combinations(at, 2)]
        for c, values in zip(_CLASS[k], (few, two, [half]) if right else (few, [half], two)):
            out += [v ^ c for v in values]
    return np.unique(np.array(out, dtype=np.uint64)).view(np.int64)


def cells_near(lat: float, lon: float, reach_m: float) -> list[int]:
    """Cells that hold any point within reach_m; reach 0 gives the point's own cell first and only."""
    dlat = math.degrees(reach_m / EARTH_M) * 1.001
    out = []
    for band in range(math.floor((lat - dlat) / CELL_DEG), math.floor((lat + dlat) / CELL_DEG) + 1):
        width = CELL_DEG / max(0.02, math.cos(math.radians((band + 0.5) * CELL_DEG)))
        dlon = dlat / max(0.02, math.cos(math.radians(min(89.0, abs(lat) + dlat)))) if reach_m else 0.0
        out += [band * 2**32 + k for k in range(math.floor((lon - dlon) / width), math.floor((lon + dlon) / width) + 1)]
    return out


def encoded(records: DataFrame, right: bool) -> DataFrame:
    """records (id, name, category, lat, lon) with words, b0, b1 and cells; those without words or place are left out: nothing can match them."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, name, category, lat, lon in zip(b["id"], b["name"], b["category"], b["lat"], b["lon"]):
                words = core_words(name) if isinstance(name, str) else _EMPTY
                if not words or not (abs(lat) <= 90 and abs(lon) < 1e4):
                    continue
                rows.append((id_, " ".join(words), category, lat, lon, *map(_signed, _halves(signature(words))), cells_near(lat, lon, MAX_M if right else 0.0)))
            yield pd.DataFrame(rows, columns=["id", "words", "category", "lat", "lon", "b0", "b1", "cells"])

    return records.select("id", "name", "category", "lat", "lon").mapInPandas(encode, "id bigint, words string, category string, lat double, lon double, b0 bigint, b1 bigint, cells array<bigint>")


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))


def close_vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cell, l0, l1, r0, r1): each pair of vectors that share a key in a cell, those within RADIUS among them all.

    Records with one vector in one cell are one here, however many they are. The cells of
    a vector that is found all over are dealt to CELL_LANES rows before keys are made.
    """

    def keyed(df: DataFrame, p: str, is_right: bool) -> DataFrame:
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["keys"] = [probe_keys([int(x) % 2**64, int(y) % 2**64], is_right) for x, y in zip(b[f"{p}0"], b[f"{p}1"])]
                yield b

        # Keys are made once for each vector and lane, of however many cells.
        lane = F.pmod(F.xxhash64("cell"), F.lit(CELL_LANES)).alias("lane")
        vectors = df.select(F.explode("cells").alias("cell"), F.col("b0").alias(f"{p}0"), F.col("b1").alias(f"{p}1")).groupBy(f"{p}0", f"{p}1", lane).agg(F.collect_set("cell").alias("cells")).drop("lane")
        made = vectors.mapInPandas(keys, f"{p}0 bigint, {p}1 bigint, cells array<bigint>, keys array<bigint>")
        return made.withColumn("cell", F.explode("cells")).select(f"{p}0", f"{p}1", "cell", F.explode("keys").alias("k")).select(f"{p}0", f"{p}1", "cell", F.xxhash64("cell", "k").alias("key"))

    # Sizes are guessed before cells and keys multiply the rows: a guess must not send them all to the driver.
    met = keyed(left, "l", False).join(keyed(right, "r", True).hint("merge"), ["key", "cell"])
    most = F.lit(RADIUS + 2)  # what lies a little further comes along for free; the words decide
    return met.filter(hamming("l", "r") <= most).select("cell", "l0", "l1", "r0", "r1").dropDuplicates()


def scored_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, l_cat, r_cat, metres, dice) of all close pairs within MAX_M, once each: a record of the left has one cell and one vector."""
    vectors = close_vectors(left, right)
    side = lambda df, p: df.select(F.explode("cells").alias("cell"), F.col("b0").alias(f"{p}0"), F.col("b1").alias(f"{p}1"), F.col("id").alias(f"{p}_id"), F.col("category").alias(f"{p}_cat"), F.radians("lat").alias(f"{p}_y"), F.radians("lon").alias(f"{p}_x"))
    pairs = vectors.join(side(left, "l").hint("merge"), ["cell", "l0", "l1"]).join(side(right, "r").hint("merge"), ["cell", "r0", "r1"])
    a = F.pow(F.sin((F.col("r_y") - F.col("l_y")) / 2), 2) + F.cos("l_y") * F.cos("r_y") * F.pow(F.sin((F.col("r_x") - F.col("l_x")) / 2), 2)
    pairs = pairs.withColumn("metres", 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))).filter(F.col("metres") <= MAX_M)
    ones = lambda p: F.bit_count(F.col(f"{p}0")) + F.bit_count(F.col(f"{p}1"))
    both = F.bit_count(F.col("l0").bitwiseAND(F.col("r0"))) + F.bit_count(F.col("l1").bitwiseAND(F.col("r1")))
    dice = 2 * both / (ones("l") + ones("r"))
    return pairs.select("l_id", "r_id", "l_cat", "r_cat", "metres", dice.alias("dice"))


def _level(value: str, edges: tuple, down: bool = False) -> Column:
    """How many of the edges a value reaches; down: how many it stays within."""
    c = F.col(value)
    return sum(((c <= e if down else c >= e).cast("int") for e in edges), F.lit(0))


def mixture(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """P(same | pattern) from counts of patterns, fields independent within each class.

    Starts from the patterns whose name agrees best; probabilities are smoothed, so
    that an unseen level rules nothing out.
    """
    if not patterns:
        return {}
    fields = len(patterns[0][0])
    levels = [sorted({p[k] for p, _ in patterns}) for k in range(fields)]
    post = {p: (0.02, 0.02, 0.1, 0.5, 0.8, 0.95)[min(p[0], 5)] for p, _ in patterns}
    for _ in range(rounds):
        share = {}
        for side in (0, 1):
            mass = {p: n * (post[p] if side else 1 - post[p]) for p, n in patterns}
            total = sum(mass.values())
            share[side] = [{v: (sum(m for p, m in mass.items() if p[k] == v) + 0.5) / (total + 0.5 * len(levels[k])) for v in levels[k]} for k in range(fields)]
            share[side, "p"] = (total + 1) / (sum(n for _, n in patterns) + 2)
        new = {}
        for p, _ in patterns:
            one, zero = (share[s, "p"] * math.prod(share[s][k][p[k]] for k in range(fields)) for s in (1, 0))
            new[p] = one / (one + zero)
        post = new
    return post


def going_together(pairs: DataFrame) -> DataFrame:
    """(l_cat, r_cat) that stand together more than twice as often as chance has it, among pairs whose names agree."""
    n = pairs.filter(F.col("dice") >= DICE_EDGES[-1]).groupBy("l_cat", "r_cat").agg(F.count("*").alias("n")).dropna()
    of_l = n.groupBy("l_cat").agg(F.sum("n").alias("nl"))
    of_r = n.groupBy("r_cat").agg(F.sum("n").alias("nr"))
    total = n.agg(F.sum("n").alias("all"))  # one row
    n = n.join(of_l, "l_cat").join(of_r, "r_cat").join(F.broadcast(total))
    return n.filter((F.col("n") >= 2) & (F.col("n") * F.col("all") > 2.0 * F.col("nl") * F.col("nr"))).select("l_cat", "r_cat")


def matches(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, left words, right words): pairs (l_id, r_id, metres, dice, confidence), one row per close pair within MAX_M; words (id, words) of either side.

    left, right: id BIGINT, name, category, lat, lon, one row per record; of repeated
    ids one counts. Records with a null name, one without distinctive words, or no
    coordinates match nothing. A null category is a level of its own. Records with one
    name and place give all their pairs: each is a pair of different ids. Either side
    empty: no rows.
    """
    spark = left.sparkSession
    left, right = (cut(encoded(df, is_right).dropDuplicates(["id"])) for df, is_right in ((left, False), (right, True)))
    pairs = cut(scored_pairs(left, right))
    # Which categories go together: learnt from the pairs whose names agree, at every size in the same way.
    known = cut(going_together(pairs)).withColumn("c", F.lit(2))
    cat = F.when(F.col("l_cat").isNull() | F.col("r_cat").isNull(), 1).otherwise(F.coalesce("c", F.lit(0)))
    pairs = pairs.join(known, ["l_cat", "r_cat"], "left").withColumn("pattern", F.array(_level("dice", DICE_EDGES), _level("metres", METRE_EDGES, down=True), cat))
    counts = [(tuple(r.pattern), r.n) for r in pairs.groupBy("pattern").agg(F.count("*").alias("n")).collect()]  # levels times levels
    post = spark.createDataFrame([(list(p), float(c)) for p, c in mixture(counts).items()] or [([0, 0, 0], 0.0)], "pattern array<int>, confidence double")
    pairs = pairs.join(F.broadcast(post), "pattern").select("l_id", "r_id", "metres", "dice", "confidence")
    return pairs, left.select("id", "words"), right.select("id", "words")


def sure_matches(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Those of matches() with LEAST_CONFIDENCE whose words agree, with likeness: from LEAST_LIKENESS no word differs by more than misspelling."""

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([soft_likeness(tuple(x.split()), tuple(y.split())) for x, y in zip(a, b)], dtype=float)

    sure = pairs.filter(F.col("confidence") >= LEAST_CONFIDENCE)
    for p, words in (("l", left), ("r", right)):
        sure = sure.join(words.select(F.col("id").alias(f"{p}_id"), F.col("words").alias(f"{p}_words")).hint("merge"), f"{p}_id")
    return sure.withColumn("likeness", likeness("l_words", "r_words")).filter(F.col("likeness") >= LEAST_LIKENESS).drop("l_words", "r_words")


def latest_known(places: DataFrame, source: str) -> DataFrame:
    """Places in the latest snapshot of a source. A name, category or location that is null there is that of the last snapshot that has it."""
    own = places.filter(F.col("source") == source)
    fields = ["name", "category", "lat", "lon"]
    now = cut(latest_valid(own, group="source", key="place_id", snapshot="snapshot", version="delivered_at", values=fields))
    needy = now.filter(F.greatest(*[F.col(c).isNull() for c in fields])).select("place_id")
    some = F.broadcast(needy) if needy.count() <= FILL_BOUND else needy
    at = F.struct("snapshot", "delivered_at", F.xxhash64(*fields))
    keep = lambda v, known: F.max_by(v, F.when(known, at))
    earlier = own.join(some, "place_id", "left_semi").groupBy("place_id").agg(
        keep("name", F.col("name").isNotNull()).alias("n"), keep("category", F.col("category").isNotNull()).alias("c"),
        keep(F.struct("lat", "lon"), F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("p"),
    )
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    spot = lambda c: F.when(whole, F.col(c)).otherwise(F.col(f"p.{c}")).alias(c)
    return now.join(earlier, "place_id", "left").select(F.col("place_id").alias("id"), F.coalesce("name", "n").alias("name"), F.coalesce("category", "c").alias("category"), spot("lat"), spot("lon"))
