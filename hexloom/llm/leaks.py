"""Passages of held-out items inside long documents.

Containment search by MinHash. Items are partitioned by size; for each class the
shingles of a document are cut into overlapping blocks of twice that size, so that
what is compared is never a short item with a long document. Items and blocks are
sketched by the same SLOTS permutations. A block's least values are looked up among
those of the items, by key; the slots in which a document agrees with an item estimate
how much of the item it contains, and pairs above a threshold are candidates. They are
verified by the exact containment of the item's shingles, and in the end by all words:
in the item's order, in a few stretches.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.runtime import cut, spread

#: Shingles of three words: with one word in seven altered, five-word ones would be too few to meet.
SHINGLE = 3
SIZES = (16, 32, 64, 128, 256, 512, 1024)
#: Permutations of a sketch.
SLOTS = 128
#: Estimated and exact containment of shingles from which a pair goes on. Half an item with every seventh word altered holds 0.28 of its shingles.
LEAST_ESTIMATE, LEAST_CONTAINMENT = 0.1, 0.15
LEAST_SHARE = 0.5
ALTERED = 1 / 7
LEAST_STRETCH = 4
#: Bits of the table of keys that is sent to all tasks; its size does not depend on the items.
TABLE_BITS = 26
WORDS_AT_ONCE = 50_000

_TAG = regex.compile(r"<[/!]?[A-Za-z][^<>]*>|\[/?[A-Za-z_]+\](?=\W|$)|&(?:[A-Za-z]+|#\d+);")
_PLAIN = re.compile("[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}ـ]")


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without punctuation, markup and invisible characters; null and blank texts have none."""
    if not text:
        return []
    if "&" in text or "<" in text or "[" in text:
        text = _TAG.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else " ", text)
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower())


@lru_cache(500_000)
def _word_hash(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; of a shorter text one hash of all it has."""
    if not len(h):
        return h
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.zeros(SHINGLE - len(h), dtype=np.uint64)])
    out = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k])
    return out


_FACTORS = np.random.default_rng(1).integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint32(2**32 - 1)


def size_class(n: int) -> int:
    """Number of the least of SIZES that holds n shingles; the last one beyond."""
    return next((k for k, s in enumerate(SIZES) if n <= s), len(SIZES) - 1)


def least_values(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(SLOTS, parts): the least value of every part of `shingle` under each permutation."""
    out = np.empty((SLOTS, len(starts)), dtype=np.uint32)
    for k, a in enumerate(_FACTORS):
        out[k] = np.minimum.reduceat(((shingle * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def keys_of(values: np.ndarray, size: int) -> np.ndarray:
    """(SLOTS, n) keys of least values: class, slot and value in one number."""
    return (np.uint64(size) << np.uint64(40)) | (np.arange(SLOTS, dtype=np.uint64)[:, None] << np.uint64(32)) | values.astype(np.uint64)


def _bit(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def item_keys(h: np.ndarray) -> np.ndarray:
    """Keys of an item's sketch, one for each slot. h: hashes of its words."""
    s = np.unique(shingles(h))
    return keys_of(least_values(s, np.zeros(1, dtype=np.int64)), size_class(len(s)))[:, 0]


def block_keys(docs: list[np.ndarray], known: np.ndarray, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, key) of all blocks of documents, as far as the bit table `known` has the key.

    The parts of a class are half a block; they are joined from those of the class below.
    """
    sh = [shingles(h) for h in docs]
    length = np.array([len(s) for s in sh])
    if not len(classes) or not length.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = -(-length // SIZES[0])
    owner = np.repeat(np.arange(len(docs)), parts)
    offset = np.cumsum(length) - length
    place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    v = least_values(np.concatenate(sh), offset[owner] + place * SIZES[0])
    got_d, got_k = [], []
    for size in range(len(SIZES)):
        if size:  # two neighbours make a part of the next class
            first = np.flatnonzero(place % 2 == 0)
            pair = np.minimum(first + 1, len(owner) - 1)
            v = np.where((owner[pair] == owner[first]) & (pair > first), np.minimum(v[:, first], v[:, pair]), v[:, first])
            owner, place = owner[first], place[first] // 2
        if size not in classes:
            continue
        after = np.minimum(np.arange(len(owner)) + 1, len(owner) - 1)
        block = np.where(owner[after] == owner, np.minimum(v, v[:, after]), v)
        keys = keys_of(block, size)
        at = _bit(keys)
        slot, part = np.nonzero((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        got_d.append(owner[part]), got_k.append(keys[slot, part])
    pairs = np.unique(np.stack([np.concatenate(got_d).astype(np.uint64), np.concatenate(got_k)]), axis=1)
    return pairs[0].astype(np.int64), pairs[1]


def estimate(slots: int) -> float:
    """Containment of an item in blocks of twice its size that agree with it in so many slots."""
    return 3 * slots / (SLOTS + slots)


LEAST_SLOTS = next(m for m in range(1, SLOTS + 1) if estimate(m) >= LEAST_ESTIMATE)


def containment(item: np.ndarray, doc: np.ndarray) -> float:
    """Share of the item's shingles that the document has."""
    own = np.unique(shingles(item))
    return float(np.isin(own, shingles(doc)).sum() / len(own)) if len(own) else 0.0


def held_share(item: np.ndarray, doc: np.ndarray) -> float:
    """Share of the item's words that the document holds in the item's order, in a few stretches.

    A stretch is made of runs of two or more equal words; between runs up to two
    words may differ, and of all its words at most one in seven, or one if it is short.
    """
    n = len(item)
    at: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(item.tolist()):
        at[w].append(i)
    runs: list[tuple[int, int, int]] = []
    ends: dict[int, tuple[int, int]] = {}  # diagonal -> (start in item, next place in document)
    least = min(2, n)
    for j, w in enumerate(doc.tolist()):
        for i in at.get(w, ()):
            d = j - i
            if d in ends and ends[d][1] == j:
                ends[d] = (ends[d][0], j + 1)
            else:
                if d in ends and ends[d][1] - d - ends[d][0] >= least:
                    runs.append((ends[d][0], ends[d][0] + d, ends[d][1] - d - ends[d][0]))
                ends[d] = (i, j + 1)
    runs += [(i, i + d, e - d - i) for d, (i, e) in ends.items() if e - d - i >= least]
    # Stretches: chains of runs with small gaps. A run is found by where it ends.
    runs.sort(key=lambda r: (r[1], r[0]))
    best: list[tuple[float, int, int]] = []  # equal words, altered words, run the stretch began with
    ending: dict[tuple[int, int], int] = {}
    stretches: list[tuple[int, int, int, int, int]] = []
    for k, (i, j, m) in enumerate(runs):
        own = (float(m), 0, k)
        for gi in range(-1, 3):
            for gj in range(-1, 4):
                p = ending.get((i - gi, j - gj))
                lap = max(0, -min(gi, gj))
                if p is not None and m > lap and best[p][0] + m - lap > own[0]:
                    own = (best[p][0] + m - lap, best[p][1] + max(0, gi), best[p][2])
        best.append(own)
        if (i + m, j + m) not in ending or own[0] > best[ending[i + m, j + m]][0]:
            ending[i + m, j + m] = k
        equal, altered, start = own
        words = equal + altered
        if (equal >= min(LEAST_STRETCH, n) or m >= min(LEAST_STRETCH, n)) and altered <= max(1, ALTERED * words * 1.5):
            stretches.append((runs[start][0], i + m, runs[start][1], j + m, min(n, int(words))))
    # The best chain of stretches, in order in both texts.
    stretches.sort(key=lambda s: (s[3], s[1]))
    chain: list[int] = []
    for k, (i0, _, j0, _, words) in enumerate(stretches):
        chain.append(words + max((chain[p] for p in range(k) if stretches[p][1] <= i0 and stretches[p][3] <= j0), default=0))
    return max(chain, default=0) / n


def candidates(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, texts, held): pairs (_n, _i) whose sketches agree, texts (_n, _d, words) of documents, held (_i, words) of items.

    docs: _n, _d, _t; items: i, t. Keys of documents that no item has are dropped where
    they are made; the rest meet the items' keys by an equi-join. The table of bits
    that tells them apart is as large for a million items as for one.
    """

    def sketch_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, h) for i, t in zip(b["i"], b["t"]) if len(h := word_hashes(plain_words(t)))]
            yield pd.DataFrame({"_i": [i for i, _ in rows], "words": [h.view(np.int64) for _, h in rows], "keys": [item_keys(h).view(np.int64) for _, h in rows]})

    held = cut(items.mapInPandas(sketch_items, "_i bigint, words array<bigint>, keys array<bigint>"))
    keys = held.select("_i", F.explode("keys").alias("key"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
        for b in batches:
            at = _bit(b["key"].to_numpy().view(np.uint64))
            np.bitwise_or.at(got, at >> 3, (1 << (at & 7)).astype(np.uint8))
        full = np.flatnonzero(got)
        yield pd.DataFrame({"at": full, "v": got[full].astype(np.int64)})

    table = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    for r in keys.mapInPandas(bits, "at bigint, v bigint").groupBy("at").agg(F.bit_or("v").alias("v")).toLocalIterator():  # a fixed number of bytes at most
        table[r.at] = r.v
    classes = [r.c for r in keys.select(F.shiftright("key", 40).alias("c")).distinct().collect()]  # at most len(SIZES)
    known = docs.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, d, out = b["_n"].to_numpy(), b["_d"].to_numpy(), []
            part, words, first = [], 0, 0
            for k, t in enumerate(b["_t"]):
                part.append(word_hashes(plain_words(t)))
                words += len(part[-1])
                if words < WORDS_AT_ONCE and k < len(b) - 1:
                    continue
                owner, key = block_keys(part, known.value, classes)
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                # Fewer keys than one pair needs, whatever the item: no pair.
                out += [(n[first + j], d[first + j], h.view(np.int64), key[lo:hi].view(np.int64)) for j, (h, lo, hi) in enumerate(zip(part, edges, edges[1:])) if hi - lo >= LEAST_SLOTS]
                part, words, first = [], 0, k + 1
            yield pd.DataFrame(out, columns=["_n", "_d", "words", "keys"])

    seen = cut(docs.mapInPandas(look, "_n bigint, _d bigint, words array<bigint>, keys array<bigint>"))
    met = seen.select("_n", F.explode("keys").alias("key")).join(keys, "key").groupBy("_n", "_i").agg(F.count_distinct("key").alias("slots"))
    return met.filter(F.col("slots") >= LEAST_SLOTS).select("_n", "_i"), seen.select("_n", "_d", "words").dropDuplicates(["_n"]), held.select("_i", "words")


def leaked_items(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", share: float = LEAST_SHARE) -> DataFrame:
    """(doc, item, share): documents that hold at least `share` of an item's words in its order.

    Null, empty and blank texts hold nothing, as do null ids; repeated documents
    give their pair once, of repeated items the first text in order counts. Either
    table empty: no rows.
    """
    rows = docs.select(F.col(doc).cast("bigint").alias("_d"), F.col(text).alias("_t")).dropna().filter(F.length(F.trim("_t")) > 0)
    rows = spread(rows.select(F.xxhash64("_d", "_t").alias("_n"), "_d", "_t"))
    known = items.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).dropna().groupBy("i").agg(F.min("t").alias("t"))
    pairs, texts, held = candidates(rows, known)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for d, i, x, y in zip(b["_d"], b["_i"], b["words"], b["own"]):
                x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
                if containment(y, x) >= LEAST_CONTAINMENT and (s := held_share(y, x)) >= share:
                    got.append((d, i, s))
            yield pd.DataFrame(got, columns=["_d", "_i", "share"])

    found = pairs.join(texts, "_n").join(held.withColumnRenamed("words", "own"), "_i").mapInPandas(verify, "_d bigint, _i bigint, share double")
    return found.groupBy(F.col("_d").alias(doc), F.col("_i").alias(item)).agg(F.max("share").alias("share"))
