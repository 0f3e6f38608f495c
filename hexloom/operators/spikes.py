"""Implausible readings of numeric series.

Normal behaviour of a source is learnt by robust principal components. The
profile matrix of a source has one row for each profile (PROFILE consecutive
points of order) of each of its series and one column for each point; an entry is
the reading's distance from the level around it, in median steps of its series.
The matrix is split into a low-rank part, what the series of the source do
together, and sparse spikes. Its leading directions come from Gram matrices that
are summed over all tasks, round by round. Every row counts with the same length, so
that a few rows with huge spikes turn no direction, and from the second round on only
what the low-rank part leaves within bounds counts. A reading is a spike only where the sparse part is
large: what a source shows in most of its series at once is its normal behaviour.
An exact rule on the reading's neighbours follows. Constant runs and impossible
values are tested separately.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.runtime import bounded_collect, cut

RANK = 2
ROUNDS, FITS = 2, 3
#: Points of order in a profile.
PROFILE = 24
OFF_STEPS = 10.0
#: Least sparse part of a spike, in median steps. The level it is measured from lies between those before and after, so it may be less than OFF_STEPS.
SPARSE_STEPS = 5.0
#: A direction is normal behaviour of a source if it has this share of the weight of all: no few series bring that about.
LEAST_WEIGHT = 0.2
SIDE, LEAST_SIDE = 4, 3
STUCK_RUN = 5
#: Share of repeated readings outside a constant run up to which a series hardly repeats.
REPEATS = 0.34


def deviations(x: np.ndarray) -> np.ndarray:
    """Distance of each reading from the level around it, in median steps of its series; 0 for a series that never moves.

    x: (series, readings), finite. The level is the median of up to SIDE readings on
    either side and the reading itself.
    """
    out = np.zeros_like(x)
    step = np.abs(np.diff(x, axis=1))
    unit = np.array([np.median(s[s > 0]) if (s > 0).any() else np.inf for s in step])
    for i in range(x.shape[1]):
        out[:, i] = x[:, i] - np.median(x[:, max(0, i - SIDE) : i + SIDE + 1], axis=1)
    return out / unit[:, None]


def low_rank(d: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Low-rank part of profiles d (rows, PROFILE; NaN is a gap) in the space of `basis` (PROFILE, k).

    Readings off it by more than SPARSE_STEPS are sparse: they, and gaps, are filled by
    the low-rank part itself and the rest is fitted again.
    """
    fill = np.nan_to_num(d)
    low = np.zeros_like(d)
    for _ in range(FITS if basis.shape[1] else 0):
        low = (fill @ basis) @ basis.T
        fill = np.where(np.abs(d - low) <= SPARSE_STEPS, d, low)
    return low


def standing_out(gram: np.ndarray) -> np.ndarray:
    """(PROFILE, k): up to RANK leading directions of a Gram matrix that have LEAST_WEIGHT of its weight."""
    weight, vec = np.linalg.eigh(gram)
    keep = weight >= max(LEAST_WEIGHT * weight.sum(), 1e-12)
    return vec[:, keep][:, -RANK:]


def median_step(v: np.ndarray) -> float:
    """Median absolute non-zero step; 0 if the series never moves."""
    s = np.abs(np.diff(v))
    s = s[s > 0]
    return float(np.median(s)) if len(s) else 0.0


def spike_positions(v: np.ndarray, candidates: Sequence[int]) -> set[int]:
    """The exact rule for runs of one or two readings that hold a candidate.

    Each reading of the run lies off the medians of up to four readings before and
    after, on the same side, by more than ten median steps; at least three
    readings stand on either side, and the readings next to the run have returned.
    """
    unit, found = median_step(v), set()
    if not unit:
        return found
    limit, v = OFF_STEPS * unit, v.tolist()
    for i in candidates:
        for a, b in ((i, i), (i, i + 1), (i - 1, i)):
            before, after = v[max(0, a - SIDE) : max(0, a)], v[b + 1 : b + 1 + SIDE]
            if a < 0 or len(before) < LEAST_SIDE or len(after) < LEAST_SIDE:
                continue
            lo, hi = _median(before), _median(after)
            up = v[a] > lo
            off = (lambda x: x - lo > limit and x - hi > limit) if up else (lambda x: lo - x > limit and hi - x > limit)  # noqa: B023
            if off(v[a]) and off(v[b]) and not off(v[a - 1]) and not off(v[b + 1]):
                found.update(range(a, b + 1))
    return found


def _median(few: list[float]) -> float:
    few, n = sorted(few), len(few)
    return (few[(n - 1) // 2] + few[n // 2]) / 2


def stuck_positions(v: np.ndarray) -> set[int]:
    """Readings in constant runs of at least five, where the series hardly repeats outside that run."""
    if len(v) < STUCK_RUN:
        return set()
    same = np.diff(v) == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(int)))
    found = set()
    for a, b in zip(edges[::2], edges[1::2]):
        outside = len(same) - (b - a)
        if b - a + 1 >= STUCK_RUN and outside and (same.sum() - (b - a)) / outside <= REPEATS and outside >= STUCK_RUN:
            found.update(range(a, b + 1))
    return found


def _measured(batch: pd.DataFrame, impossible: Callable) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each series of a batch: deviations of its readings (NaN: gap, impossible, or too few readings), and which are impossible."""
    dev, bad = [], []
    by_length: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for k, (source, values) in enumerate(zip(batch["_source"], batch["_values"])):
        v = np.asarray(values, dtype=float)
        known = ~np.isnan(v)
        with np.errstate(invalid="ignore"):
            bad.append(known & impossible(source, v))
        keep = np.flatnonzero(np.isfinite(v) & ~bad[-1])
        dev.append(np.full(len(v), np.nan))
        if len(keep) >= 2 * LEAST_SIDE + 1:
            by_length.setdefault(len(keep), []).append((k, keep, v[keep]))
    for same in by_length.values():
        for (k, keep, _), own in zip(same, deviations(np.stack([v for _, _, v in same]))):
            dev[k][keep] = own
    return dev, bad


def _profiles(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(d, row, column, first): profile rows of a batch, and row and column of every reading, series after series; first: where each series' readings begin."""
    at = [np.asarray(a, dtype=np.int64) for a in batch["_ord"]]
    n = np.array([len(a) for a in at])
    series, place = np.repeat(np.arange(len(at)), n), np.concatenate(at) if at else np.zeros(0, np.int64)
    _, row = np.unique(np.stack([series, place // PROFILE]), axis=1, return_inverse=True)
    row = row.ravel()
    d = np.full((int(row.max()) + 1 if len(row) else 0, PROFILE), np.nan)
    d[row, place % PROFILE] = np.concatenate(list(batch["_dev"])) if at else 0
    return d, row, place % PROFILE, np.cumsum(n) - n


def _low_rank(batch: pd.DataFrame, d: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank part of the profile rows of a batch, each in its source's basis, and the source of each row by number."""
    sources, of_series = np.unique(batch["_source"].to_numpy().astype(str), return_inverse=True)
    n = np.diff([*first, len(row)])
    of_row = np.zeros(len(d), dtype=int)
    of_row[row] = np.repeat(of_series, n)
    low = np.zeros_like(d)
    for k in range(len(sources)):
        basis = np.asarray(batch["_basis"].iloc[int(np.flatnonzero(of_series == k)[0])], dtype=float).reshape(PROFILE, -1)
        low[of_row == k] = low_rank(d[of_row == k], basis)
    return low, of_row


def source_bases(lists: DataFrame) -> DataFrame:
    """(_source, _basis): the leading directions of each source's profile matrix. lists: _source, _ord, _dev.

    What leaves a task is one matrix of PROFILE by PROFILE sums for each source it saw.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            d, row, _, first = _profiles(b)
            low, of_row = _low_rank(b, d, row, first)
            rest = np.nan_to_num(d - low)
            held = low + (np.clip(rest, -SPARSE_STEPS, SPARSE_STEPS) if b["_basis"].str.len().any() else rest)
            held /= np.maximum(1, np.linalg.norm(held, axis=1, keepdims=True))
            for k, source in enumerate(np.unique(b["_source"].to_numpy().astype(str))):
                own = held[of_row == k]
                total[source] = total.get(source, 0) + own.T @ own
        yield pd.DataFrame([(s, i, float(v)) for s, m in total.items() for i, v in enumerate(m.ravel())], columns=["_source", "i", "v"])

    def directions(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(PROFILE * PROFILE)
        m[g["i"]] = g["v"]
        return pd.DataFrame({"_source": [g["_source"].iloc[0]], "_basis": [standing_out(m.reshape(PROFILE, PROFILE)).ravel()]})

    none = F.array().cast("array<double>")
    bases = None
    for _ in range(ROUNDS):
        rows = lists.select("_source", "_ord", "_dev")
        rows = rows.withColumn("_basis", none) if bases is None else rows.join(bases, "_source")
        grams = rows.mapInPandas(sums, "_source string, i int, v double").groupBy("_source", "i").agg(F.sum("v").alias("v"))
        bases = cut(grams.groupBy("_source").applyInPandas(directions, "_source string, _basis array<double>"))
    return bases


def _judge(batch: pd.DataFrame, stuck_for: Callable) -> list[list[str]]:
    """Positions of the readings to report, for each series of a batch, with the reason."""
    if not len(batch):
        return []
    d, row, column, first = _profiles(batch)
    low, _ = _low_rank(batch, d, row, first)
    off = np.abs(d - low)[row, column] > SPARSE_STEPS
    out = []
    for source, values, bad, lo in zip(batch["_source"], batch["_values"], batch["_bad"], first):
        v, bad = np.asarray(values, dtype=float), np.asarray(bad, dtype=bool)
        found = dict.fromkeys(np.flatnonzero(bad).tolist(), "impossible")
        keep = np.flatnonzero(np.isfinite(v) & ~bad)
        if stuck_for(source) and len(keep):
            found.update(dict.fromkeys(keep[sorted(stuck_positions(v[keep]))].tolist(), "stuck"))
        sparse = np.flatnonzero(off[lo : lo + len(v)][keep])
        if len(sparse):
            for i in spike_positions(v[keep], sparse.tolist()):
                found.setdefault(int(keep[i]), "spike")
        out.append([f"{i}:{why}" for i, why in sorted(found.items())])
    return out


def implausible_readings(
    df: DataFrame,
    *,
    series: Sequence[str],
    kind: str,
    order: str,
    value: str,
    impossible: Callable[[str, np.ndarray], np.ndarray],
    stuck_for: Callable[[str], bool],
    version: str | None = None,
) -> DataFrame:
    """(*series, order, reason) of the readings that cannot be right for their series.

    series: columns naming a source's series; kind: the one of them handed to
    `impossible` and `stuck_for`. Repeated rows count once; of several values for
    one point of order the latest `version` counts, then the largest value. Null
    and NaN values are gaps: never reported, left out of steps and levels.
    Rows with a null in series or order are ignored; an empty table gives no rows.
    A series is at most one value for each point of order, however many rows hold it.
    """
    rank = F.struct(F.col(version) if version else F.lit(0), F.col(value))
    points = df.dropna(subset=[*series, order]).groupBy(*series, order).agg(F.max(rank).getField(value).alias("_v"))
    lists = points.join(_numbered(df, order), order).groupBy(*series).agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(order).alias("o"), F.col("_v").alias("v")))).alias("_p"))
    lists = lists.select(*series, F.col(kind).cast("string").alias("_source"), F.col("_p.n").alias("_ord"), F.col("_p.o").alias("_at"), F.col("_p.v").cast("array<double>").alias("_values"))
    types = dict(lists.dtypes)
    typed = lambda names: ", ".join(f"`{c}` {types[c]}" for c in names)
    kept = [*series, "_source", "_ord", "_at", "_values"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["_dev"], b["_bad"] = _measured(b, impossible)
            yield b

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["_found"] = _judge(b, stuck_for)
            yield b[[*series, "_at", "_found"]][b["_found"].str.len() > 0]

    measured = cut(lists.mapInPandas(measure, typed(kept) + ", _dev array<double>, _bad array<boolean>"))
    hits = measured.join(source_bases(measured), "_source").select(*kept, "_bad", "_dev", "_basis").mapInPandas(judge, typed([*series, "_at"]) + ", _found array<string>")
    hits = hits.withColumn("_f", F.explode("_found"))
    at = F.substring_index("_f", ":", 1).cast("int") + 1
    return hits.select(*series, F.element_at("_at", at).alias(order), F.substring_index("_f", ":", -1).alias("reason"))


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """(order, _n): the points of order, numbered from 0."""
    points = df.select(order).dropna().distinct()
    rows = bounded_collect(points)
    if rows is None:  # a calendar beyond the bound is numbered in one task and joined
        return points.withColumn("_n", F.row_number().over(Window.orderBy(order)) - 1)
    numbered = [(r[0], k) for k, r in enumerate(sorted(rows))]
    return F.broadcast(df.sparkSession.createDataFrame(numbered, f"`{order}` {dict(points.dtypes)[order]}, _n int"))
