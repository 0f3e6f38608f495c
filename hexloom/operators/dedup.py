"""Records that may be one and the same: neighbours, likely duplicates, clusters, one-to-one matches.

Records at one coordinate (and of one name, where names count) are one representative
until the end, so that a crowded point costs one row. Blocks are bands of latitude as
high as the distance, cut into squares as wide as the distance there, in true metres
at every latitude; a record meets the squares within the distance by an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions.geo import haversine_m
from hexloom.functions.text import HELD, Held, bigrams, letters, likeness_beyond, may_be_alike_rows, skeleton, spellings
from hexloom.operators.graph import components
from hexloom.runtime import cut, release

#: Above the rounding of the plane that a band is.
SLACK = 1.001
#: Pairs compared at once.
BLOCK = 1 << 17
#: From as many pairs on, a square's are told by matrices.
FULL = 1 << 12
#: Parts that the names of an area are dealt to.
LANES = 8


def _reach(metres: float) -> float:
    """Degrees of latitude within a distance."""
    return math.degrees(metres / T.earth_m) * SLACK


def _width(band: Column, step: float) -> Column:
    """Degrees of longitude that a square of a band is wide; all of them next to a pole."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band), F.abs(band + 1)) * step)
    return F.least(F.lit(360.0), step / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)))


def _blocks(df: DataFrame, metres: float, around: bool, once: bool = False) -> DataFrame:
    """df (lat, lon) with its square (by, bx), or around: a row for every square that holds points within the distance.

    once: of two squares only one looks into the other; within a square both do.
    """
    step = _reach(metres)
    own = F.floor(F.col("lat") / F.lit(step)).cast("bigint")
    at = lambda lon, band: F.floor(lon / _width(band, step)).cast("bigint")
    if not around:
        return df.withColumn("by", own).withColumn("bx", at(F.col("lon"), F.col("by")))
    far = F.least(F.lit(90.0), F.abs("lat") + step)
    reach = F.least(F.lit(360.0), step / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)))
    df = df.withColumn("by", F.explode(F.sequence(own if once else own - 1, own + 1)))
    first = at(F.col("lon") - reach, F.col("by"))
    first = F.when(F.col("by") == own, at(F.col("lon"), F.col("by"))).otherwise(first) if once else first
    return df.withColumn("bx", F.explode(F.sequence(first, at(F.col("lon") + reach, F.col("by")))))


def near_pairs(left: DataFrame, right: DataFrame, metres: float, id_: str = "rep") -> DataFrame:
    """(l_<id>, r_<id>, metres) of rows within a distance. left, right: id, lat, lon."""
    name = lambda df, p: df.select("bx", "by", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("bx", "by", "x", "y")])
    a, b = name(_blocks(left, metres, False), "l"), name(_blocks(right, metres, True), "r")
    dist = haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return a.join(b, ["bx", "by"]).withColumn("metres", dist).filter(F.col("metres") <= metres).drop("bx", "by", "l_lat", "l_lon", "r_lat", "r_lon")


def spots(places: DataFrame, by: Sequence[str]) -> DataFrame:
    """Representatives: one row for each combination of `by` and coordinate, with n and rep."""
    keys = [*by, "lat", "lon"]
    return places.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("rep", F.xxhash64(*keys))


def neighbours(places: DataFrame, metres: float, across: bool) -> DataFrame:
    """(source, place_id, n_near): for every place how many others lie within a distance; across: of the other source only."""
    reps = spots(places, ["source"]).select("source", "rep", "n", "lat", "lon")
    pairs = near_pairs(reps, reps, metres)
    pairs = pairs.filter(F.col("l_source") != F.col("r_source")) if across else pairs
    near = pairs.groupBy(F.col("l_rep").alias("rep")).agg(F.sum("r_n").alias("near"))
    each = places.select("source", "place_id", F.xxhash64("source", "lat", "lon").alias("rep")).join(near, "rep", "left")
    return each.select("source", "place_id", (F.coalesce("near", F.lit(0)) - (0 if across else 1)).alias("n_near"))


def named(places: DataFrame) -> DataFrame:
    """Places with a name that leaves something, with norm: its spellings."""
    return places.withColumn("norm", spellings(F.col("name"))).filter(F.coalesce(F.length("norm"), F.lit(0)) > 0)


def _met(reps: DataFrame, metres: float, least: float, across: bool, within: str = "source", ends: bool = False) -> DataFrame:
    """Representatives near each other, by every two spellings that may make them alike; l: of the later source, else of the lower rep.

    across: of two sources; else of one value of `within`. ends: see _compared().
    """
    spelt = reps.withColumn("spelling", F.explode(F.split("norm", r"\|"))).withColumn("_h", letters("spelling"))
    spelt = spelt.select(F.col(within).alias("source"), F.col("source").alias("origin"), "rep", "norm", "spelling", "lat", "lon", *[F.coalesce(F.col("_h")[k], F.lit(0)).alias(k) for k in HELD])
    # Once for both sides.
    spelt = cut(spelt if within != "source" else spelt.drop("origin"))
    here = _blocks(spelt, metres, False)
    near = _blocks(spelt, metres, True, once=not across)
    if across:
        # A record looks for those of each later source.
        sources = F.array(*[F.lit(r[0]) for r in spelt.select("source").distinct().dropna().collect()] or [F.lit("")])  # a handful
        near = near.withColumn("source", F.explode(F.filter(sources, lambda s: s > F.col("source"))))
    else:
        # Where the square met is a record's own, both see each other.
        near = near.withColumn("own", F.col("by") == F.floor(F.col("lat") / F.lit(_reach(metres))).cast("bigint"))
    if across:
        near = near.withColumn("both", F.lit(False))
    else:
        near = near.withColumn("both", F.col("own") & (F.col("bx") == F.floor(F.col("lon") / _width(F.col("by"), _reach(metres))).cast("bigint")))
    columns = ["by", "bx", "right", "both", *spelt.columns]
    sides = here.withColumn("right", F.lit(False)).withColumn("both", F.lit(False)).select(columns).unionByName(near.withColumn("right", F.lit(True)).select(columns))
    met = _compare(sides.dropna(subset=["source", "by", "bx"]), metres, least, across, ends)
    return met.withColumn("metres", haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).filter(F.col("metres") <= metres)


def _compare(sides: DataFrame, metres: float, least: float, across: bool, ends: bool = False) -> DataFrame:
    """(l_rep, r_rep, l_lat, l_lon, r_lat, r_lon, likeness): see _compared()."""
    spark = sides.sparkSession
    # A number, so that tasks are not put together by their bytes: few rows make many pairs.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sides = sides.repartition(tasks, "source", "by", "bx").sortWithinPartitions("source", "by", "bx", "right")
    return sides.mapInPandas(_compared(metres, least, across, ends), "l_rep bigint, r_rep bigint, l_lat double, l_lon double, r_lat double, r_lon double, likeness double")


def _compared(metres: float, least: float, across: bool, ends: bool = False) -> Callable:
    """Compares, in rows sorted by square and side, each left one with each right one of its square; gives pairs alike by `least`, a little beyond the distance too.

    ends: a pair within the distance is left out where others of the square tell that both its ends have one.
    """
    # Of the ends of pairs left out each must have one that no rounding of the distance takes away.
    reach, about, inside = _reach(metres), metres * SLACK + 0.01, metres / SLACK - 0.01

    def pairs_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        square = np.flatnonzero(_starts(rows))
        right = rows["right"].to_numpy(bool)
        first = np.append(square, len(rows))
        lefts = np.add.reduceat(~right, square, dtype=np.int64)
        rights = np.diff(first) - lefts
        held, rep, both = Held(rows), rows["rep"].to_numpy(np.int64), rows["both"].to_numpy(bool)
        lat, lon, norm, spelling = rows["lat"].to_numpy(float), rows["lon"].to_numpy(float), rows["norm"].to_numpy(object), rows["spelling"].to_numpy(object)
        origin = rows["origin"].to_numpy(object) if "origin" in rows else None
        y, x = np.radians(lat), np.radians(lon)
        one = pd.factorize(rep)[0] if ends else None
        done = np.zeros(len(rows), bool)

        def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of rows that may be alike by their letters, and others of them."""
            full = lefts * rights >= FULL
            l = np.flatnonzero(~right & np.repeat(~full, np.diff(first)))  # noqa: E741
            of = np.searchsorted(first, l, side="right") - 1
            n = rights[of]
            part = np.cumsum(n) // BLOCK
            for at in np.split(np.arange(len(l)), np.flatnonzero(np.diff(part)) + 1):
                many = n[at]
                i = np.repeat(l[at], many)
                yield i, np.repeat((first[:-1] + lefts)[of[at]] - np.cumsum(many) + many, many) + np.arange(len(i))
            for k in np.flatnonzero(full):
                # From north to south, so that a part of the left ones meets a stretch of the right ones.
                l, r = (a + np.argsort(lat[a:b], kind="stable") for a, b in ((first[k], first[k] + lefts[k]), (first[k] + lefts[k], first[k + 1])))  # noqa: E741
                a, b = held.matrices(l, least), held.matrices(r, least)
                high = max(64, BLOCK // len(r))
                for top in range(0, len(l), high):
                    some = slice(top, top + high)
                    low, up = np.searchsorted(lat[r], lat[l[some]][[0, -1]] + [-1.001 * reach, 1.001 * reach])
                    for begin in range(low, up, 4 * BLOCK // high):
                        of = slice(begin, min(up, begin + 4 * BLOCK // high))
                        i, j = Held.meeting([m[some] for m in a], [m[of] for m in b])
                        yield l[some][i], r[of][j]

        for i, j in met():
            ok = np.abs(lat[i] - lat[j]) <= reach
            if not across:
                # Where the square met is a record's own, both see each other.
                ok &= (rep[i] < rep[j]) | (rep[i] != rep[j]) & ~both[j]
            if ends:
                ok &= ~(done[one[i]] & done[one[j]])
            i, j = i[ok], j[ok]
            a = np.sin((y[j] - y[i]) / 2) ** 2 + np.cos(y[i]) * np.cos(y[j]) * np.sin((x[j] - x[i]) / 2) ** 2
            far = 2 * T.earth_m * np.arcsin(np.minimum(1, np.sqrt(a)))
            ok = far <= about
            i, j, far = i[ok], j[ok], far[ok]
            ok = held.may_be_alike(i, j, least)
            i, j, far = i[ok], j[ok], far[ok]
            ok = may_be_alike_rows(spelling, i, j, least)
            i, j, far = i[ok], j[ok], far[ok]
            if not across:
                turn = rep[i] > rep[j] if origin is None else np.where(origin[i] == origin[j], rep[i] > rep[j], origin[i] < origin[j]).astype(bool)
                i, j = np.where(turn, j, i), np.where(turn, i, j)
            like = np.zeros(len(i))
            for k, (p, q) in enumerate(zip(i, j)):
                if ends and done[one[p]] and done[one[q]]:
                    continue
                like[k] = likeness_beyond(norm[p], norm[q], least)
                if ends and like[k] >= least and far[k] <= inside:
                    done[one[p]] = done[one[q]] = True
            ok = like >= least
            i, j = i[ok], j[ok]
            if len(i):
                yield pd.DataFrame({"l_rep": rep[i], "r_rep": rep[j], "l_lat": lat[i], "l_lon": lon[i], "r_lat": lat[j], "r_lon": lon[j], "likeness": like[ok]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            # Squares end where another begins; the last one may go on in the next batch.
            last = int(np.flatnonzero(_starts(b))[-1])
            if open_ and (last or not _one_square(open_[-1], b)):
                yield from pairs_of(pd.concat([*open_, b.iloc[:last]], ignore_index=True))
                open_ = []
            elif last:
                yield from pairs_of(b.iloc[:last].reset_index(drop=True))
            open_.append(b.iloc[last:])
        if open_:
            yield from pairs_of(pd.concat(open_, ignore_index=True))

    return compare


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Whether a row is the first of its square."""
    out = np.ones(len(rows), bool)
    out[1:] = np.any([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in ("source", "by", "bx")], axis=0)
    return out


def _one_square(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return all(a[c].iloc[-1] == b[c].iloc[0] for c in ("source", "by", "bx"))


def alike_pairs(places: DataFrame, metres: float, least: float, across: bool) -> DataFrame:
    """(l_rep, r_rep, metres, likeness) of representatives near each other whose names are alike; across: l of the later source.

    Every two names near each other are compared, `least` > 0. Two bounds that no pair
    of that likeness fails come before the costly comparison, for many pairs at once:
    letters in common, then the common subsequence.
    """
    return _best(_met(spots(named(places), ["source", "norm"]).drop("n"), metres, least, across))


def _best(met: DataFrame) -> DataFrame:
    """A row for each pair of _met(), by whichever spellings."""
    return met.groupBy("l_rep", "r_rep").agg(F.max("metres").alias("metres"), F.max("likeness").alias("likeness"))


def _rep_of(places: DataFrame) -> DataFrame:
    return named(places).select("source", "place_id", F.xxhash64("source", "norm", "lat", "lon").alias("rep"))


def flagged(places: DataFrame, metres: float, least: float, across: bool) -> DataFrame:
    """(source, place_id, n_alike): places with an alike neighbour and how many representatives are; flagged, never merged."""
    pairs = alike_pairs(places, metres, least, across)
    ends = pairs.select(F.explode(F.array("l_rep", "r_rep")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_alike"))
    return _rep_of(places).join(ends, "rep").select("source", "place_id", "n_alike")


def flagged_records(places: DataFrame, metres: float, least: float, across: bool) -> DataFrame:
    """(source, place_id, n_alike): as flagged(), in records: stacked ones count each, and within a source are alike to one another."""
    pairs = alike_pairs(places, metres, least, across)
    reps = spots(named(places), ["source", "norm"]).select("source", "rep", "n")
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(f"{p}_rep").alias("rep"), F.col(f"{q}_rep").alias("other")) for p, q in ("lr", "rl")])).alias("e")).select("e.*")
    alike = ends.join(reps.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("n_alike"))
    if not across:
        stacked = reps.filter((F.col("n") > 1) & F.col("source").isNotNull()).select("rep", (F.col("n") - 1).alias("n_alike"))
        alike = alike.unionByName(stacked).groupBy("rep").agg(F.sum("n_alike").alias("n_alike"))
    return _rep_of(places).join(alike, "rep").select("source", "place_id", "n_alike")


def duplicated(places: DataFrame, metres: float, least: float) -> DataFrame:
    """(source, rep, n): representatives whose n records flagged_records() gives within a source; what each is alike to is sought no further than one."""
    reps = cut(spots(named(places), ["source", "norm"]))
    met = _met(reps.drop("n"), metres, least, across=False, ends=True)
    alike = met.select(F.explode(F.array("l_rep", "r_rep")).alias("rep")).dropDuplicates().withColumn("alike", F.lit(True))
    stacked = (F.col("n") > 1) & F.col("source").isNotNull()
    return reps.join(alike, "rep", "left").filter(stacked | F.col("alike")).select("source", "rep", "n")


def region_pairs(places: DataFrame, region: str, metres: float, least: float) -> DataFrame:
    """(region, pair_type, place_id_1, place_id_2, n_1, n_2, metres, likeness): likely duplicates within a region, of one source or of two.

    A pair stands for the records at its two spots: n_1 of one name and place there, n_2
    here; place_id is the least of them. Records of one name and spot are a pair of
    themselves, with n_1 = n_2, where there are several. Names share two consonants in
    a row. Records without a region pair with none.
    """
    by = ["source", "norm", "_region"]
    own = named(places).withColumn("_region", F.col(region)).dropna(subset=["_region", "source"])
    reps = cut(own.groupBy(*by, "lat", "lon").agg(F.count("*").alias("n"), F.min("place_id").alias("id")).withColumn("rep", F.xxhash64(*by, "lat", "lon")).withColumnRenamed("_region", "region"))
    # Of one source and of two at once.
    pairs = _best(_met(reps.drop("n", "id"), metres, least, across=False, within="region"))
    grams = bigrams(skeleton(F.replace("norm", F.lit("|"), F.lit(" "))))
    of = reps.select("rep", "source", "region", "n", "id", grams.alias("grams"))
    for p in "lr":
        pairs = pairs.join(of.select(*[F.col(c).alias(f"{p}_{c}") for c in of.columns]), f"{p}_rep")
    pairs = pairs.filter(F.arrays_overlap("l_grams", "r_grams"))
    swap = F.col("l_id") > F.col("r_id")
    end = lambda c, a, b: F.when(swap, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}"))
    kind = F.when(F.col("l_source") == F.col("r_source"), "intra_source").otherwise("cross_source")
    far = pairs.select(F.col("l_region").alias(region), kind.alias("pair_type"), end("id", "l", "r").alias("place_id_1"), end("id", "r", "l").alias("place_id_2"), end("n", "l", "r").alias("n_1"), end("n", "r", "l").alias("n_2"), "metres", "likeness")
    stacked = reps.filter("n > 1").select(F.col("region").alias(region), F.lit("intra_source").alias("pair_type"), F.col("id").alias("place_id_1"), F.col("id").alias("place_id_2"), F.col("n").alias("n_1"), F.col("n").alias("n_2"), F.lit(0.0).alias("metres"), F.lit(1.0).alias("likeness"))
    return far.unionByName(stacked)


def matched_by_name(places: DataFrame, left: str, right: str, area: str, least: float, excluded: DataFrame | None = None) -> DataFrame:
    """(l_id, r_id, metres, likeness): records of two sources within an area one to one by name alone, the most alike first, then the nearest.

    Every two names of an area are compared, once. excluded (name_a, name_b): pairs that
    are known to be wrong, either way round. Records without a name, area or place are left out.
    """
    if least < 0.9:
        raise ValueError("names less alike than 0.9 need not share four letters in a row")
    own = named(places.filter(F.col("source").isin(left, right))).withColumn("_area", F.col(area)).dropna(subset=["_area", "lat", "lon"])
    reps = own.groupBy("source", "_area", "norm", "name", "lat", "lon").agg(F.count("*").alias("n")).withColumn("rep", F.xxhash64("source", "_area", "norm", "name", "lat", "lon"))
    # Names first: each two are compared once in an area, however many records bear them.
    names = reps.select("source", "_area", "norm").dropDuplicates().withColumn("rep", F.xxhash64("source", "_area", "norm"))
    spelt = names.withColumn("spelling", F.explode(F.split("norm", r"\|"))).withColumn("_h", letters("spelling"))
    lane = F.when(F.col("source") == left, F.array(F.pmod(F.xxhash64("norm"), F.lit(LANES)))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint")))
    zero = F.lit(0.0)
    sides = spelt.select(F.col("_area").cast("string").alias("source"), F.lit(0).alias("by"), F.explode(lane).alias("bx"), (F.col("source") == right).alias("right"), F.lit(False).alias("both"), "rep", "norm", "spelling", zero.alias("lat"), zero.alias("lon"), *[F.coalesce(F.col("_h")[k], F.lit(0)).alias(k) for k in HELD])
    met = _compare(sides, math.inf, least, across=True).filter(F.col("likeness") > least).groupBy("l_rep", "r_rep").agg(F.max("likeness").alias("likeness"))
    met = met.join(names.select(F.col("rep").alias("l_rep"), "_area", F.col("norm").alias("l_norm")), "l_rep").join(names.select(F.col("rep").alias("r_rep"), F.col("norm").alias("r_norm")), "r_rep")
    met = cut(met.select("_area", "l_norm", "r_norm", "likeness"))
    end = lambda s, p: reps.filter(F.col("source") == s).select("_area", *[F.col(c).alias(f"{p}_{c}") for c in ("norm", "name", "lat", "lon", "rep", "n")])
    pairs = met.join(end(left, "l"), ["_area", "l_norm"]).join(end(right, "r"), ["_area", "r_norm"])
    if excluded is not None:
        wrong = excluded.select(F.explode(F.array(F.struct(F.col("name_a").alias("l_name"), F.col("name_b").alias("r_name")), F.struct(F.col("name_b").alias("l_name"), F.col("name_a").alias("r_name")))).alias("x")).select("x.*").dropDuplicates()
        pairs = pairs.join(wrong, ["l_name", "r_name"], "left_anti")
    pairs = pairs.withColumn("metres", haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).select("l_rep", "r_rep", "l_n", "r_n", "metres", "likeness")
    got = greedy_deal(pairs, "l_rep", "r_rep", [F.desc("likeness"), "metres"], "l_n", "r_n")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("place_id")) - 1
    members = own.select(F.xxhash64("source", "_area", "norm", "name", "lat", "lon").alias("rep"), "place_id").select("rep", "place_id", rank.cast("bigint").alias("at"))
    return _dealt(got, members)


def _dealt(got: DataFrame, members: DataFrame) -> DataFrame:
    """(l_id, r_id, metres, likeness): the records that pairs of greedy_deal() stand for. members: rep, place_id, at."""
    got = got.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    for p in "lr":
        got = got.withColumn("at", F.col(f"{p}_from") + F.col("_k")).join(members.select(F.col("rep").alias(f"{p}_rep"), "at", F.col("place_id").alias(f"{p}_id")), [f"{p}_rep", "at"]).drop("at")
    return got.select("l_id", "r_id", "metres", "likeness")


def clusters(places: DataFrame, metres: float) -> DataFrame:
    """(place_id, cluster): places of one normalised name linked within a distance; alone ones are their own cluster.

    Links join representatives of a name at a coordinate; a name's records on one spot are one already.
    """
    own = named(places).select("place_id", "norm", "lat", "lon")
    reps = own.groupBy("norm", "lat", "lon").agg(F.min("place_id").alias("rep"))
    a = _blocks(reps, metres, False).select("norm", "bx", "by", F.col("rep").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = _blocks(reps, metres, True).select("norm", "bx", "by", F.col("rep").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    edges = a.join(b, ["norm", "bx", "by"]).filter("a < b").filter(haversine_m(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) <= metres).select("a", "b")
    comp = components(edges)
    rows = own.join(reps.select("norm", "lat", "lon", "rep"), ["norm", "lat", "lon"]).join(comp, F.col("rep") == F.col("id"), "left")
    return rows.select("place_id", F.coalesce("component", "rep").alias("cluster"))


def mutual_best(pairs: DataFrame, l: str, r: str, order: Sequence) -> DataFrame:  # noqa: E741
    """Pairs that are the best of both their ends; `order` must be total."""
    wl, wr = Window.partitionBy(l).orderBy(*order), Window.partitionBy(r).orderBy(*order)
    return pairs.withColumns({"_l": F.row_number().over(wl), "_r": F.row_number().over(wr)}).filter("_l = 1 and _r = 1").drop("_l", "_r")


def greedy_match(pairs: DataFrame, l: str, r: str, order: Sequence) -> DataFrame:  # noqa: E741
    """Best-first one-to-one matching: the mutual best of each round are taken and their ends leave.

    This is what taking pairs one by one from the best would give; pairs that tie in
    `order` come in the order of a hash, so that many of them are taken in a round.
    It ends when no pair is left: every round takes the best one at least.
    """
    one = pairs.withColumns({"_nl": F.lit(1).cast("bigint"), "_nr": F.lit(1).cast("bigint")})
    return greedy_deal(one, l, r, order, "_nl", "_nr").drop("_nl", "_nr", "n", "l_from", "r_from")


def greedy_deal(pairs: DataFrame, l: str, r: str, order: Sequence, nl: str, nr: str) -> DataFrame:  # noqa: E741
    """greedy_match where an end stands for nl or nr equal records: pairs taken, with n, l_from and r_from.

    A pair taken deals the n records that both ends still have, from the l_from-th and
    r_from-th on, counted from 0; what an end has over stays for later rounds.
    """
    order = [*order, F.xxhash64(l, r), F.col(l), F.col(r)]
    zero = F.lit(0).cast("bigint")
    pairs = cut(pairs.withColumns({"l_from": zero, "r_from": zero}))
    left, taken = pairs, None
    while not left.isEmpty():
        best = mutual_best(left, l, r, order)
        best = cut(best.withColumn("n", F.least(F.col(nl) - F.col("l_from"), F.col(nr) - F.col("r_from"))))
        taken = best if taken is None else taken.unionByName(best)
        was = left
        for end, had, at in ((l, nl, "l_from"), (r, nr, "r_from")):
            left = left.join(best.select(end, F.col("n").alias("_n")), end, "left").withColumn(at, F.col(at) + F.coalesce("_n", zero)).drop("_n").filter(F.col(at) < F.col(had))
        left = cut(left)
        release(was)
    return pairs.withColumn("n", zero).limit(0) if taken is None else taken


def matched(places: DataFrame, left: str, right: str, metres: float, least: float) -> DataFrame:
    """(l_id, r_id, metres, likeness): records of two sources one to one, the most alike first, then the nearest."""
    # alike_pairs() has the later source at its left.
    own = places.filter(F.col("source").isin(left, right)).withColumn("source", F.when(F.col("source") == left, "b").otherwise("a"))
    reps = spots(named(own), ["source", "norm"]).select("rep", "n")
    pairs = alike_pairs(own, metres, least, across=True)
    for p in "lr":
        pairs = pairs.join(reps.select(F.col("rep").alias(f"{p}_rep"), F.col("n").alias(f"{p}_n")), f"{p}_rep")
    got = greedy_deal(pairs, "l_rep", "r_rep", [F.desc("likeness"), "metres"], "l_n", "r_n")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("place_id")) - 1
    return _dealt(got, _rep_of(own).select("rep", "place_id", rank.cast("bigint").alias("at")))
