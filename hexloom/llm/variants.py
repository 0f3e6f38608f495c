"""Spellings of one person's or organisation's name linked within a block.

Candidates come from a prefix-filtered set-similarity join on the q-grams of the
folded words: grams are ordered from rare to common over all names, and two sets
as similar as asked share one of their first few. Persons, whose initials share no
grams with the names they stand for, meet by first letter of the given name and number
of words as well. Candidates are verified by a
soft weighted token similarity in which rare words count more; a given name that
differs, an initial that does not fit or a further distinctive word says no.
Links are closed to groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.names import core_words, distance, fold, grams, is_kind, soft_likeness, word_likeness, words_of
from hexloom.operators.graph import components
from hexloom.operators.similarity import prefix_pairs
from hexloom.runtime import bounded_collect, cut

LEAST_JACCARD = 0.3
LEAST_LIKENESS = 0.8
INITIAL_LIKENESS = 0.95


@dataclass(frozen=True)
class Aliases:
    """Folded given names, and short forms and other spellings of them."""

    given: frozenset[str]
    known: dict[str, str]

    @classmethod
    def of(cls, pairs: list[tuple[str, str]]) -> Aliases:
        given = {fold(g) for g, _ in pairs if g}
        return cls(frozenset(given), {fold(a): fold(g) for g, a in pairs if g and a} | {g: g for g in given})


def parsed(name: str | None, aliases: Aliases) -> tuple[str, list[str]]:
    """(given, words): given is a canonical given name or an initial of a person, '' for others.

    words of a person: middle and family name (either may be an initial), of others
    all distinctive words, in typed order.
    """
    raw = words_of(name)
    words = list(core_words(name))
    kind = any(len(w) > 1 and is_kind(fold(w)) for w in raw)
    for k in range(len(words) - 1):  # short forms of two words
        if words[k] + words[k + 1] in aliases.known and words[k] not in aliases.known:
            words[k : k + 2] = [words[k] + words[k + 1]]
            break
    if kind or not words:
        return "", words
    given = next((k for k, w in enumerate(words) if w in aliases.known), None)
    if given is None and len(words) == 2:  # typed together with the next word
        for k, w in enumerate(words):
            for cut_at in range(len(w) - 3, 3, -1):
                if w[:cut_at] in aliases.known:
                    words[k : k + 1] = [w[:cut_at], w[cut_at:]]
                    given = k
                    break
            if given is not None:
                break
    if given is None and len(words) == 3 and len(words[0]) == 1:
        given = 0
    if given is None and len(words) == 3:
        near = sorted((distance(w, g, 2), k, g) for k, w in enumerate(words) if len(w) >= 4 for g in aliases.known if len(g) >= 4 and abs(len(w) - len(g)) <= 2 and len({*w} ^ {*g}) <= 4)
        if near and near[0][0] <= (2 if len(near[0][2]) >= 6 else 1):
            given = near[0][1]
            words[given] = near[0][2]
    if given is None or len(words) < 3:
        return "", words
    name_ = aliases.known.get(words[given], words[given])
    rest = words[:given] + words[given + 1 :]
    if "," in (name or "") and given > 0:
        rest = rest[1:] + rest[:1]
    return name_, rest


def fits(a: str, b: str) -> float:
    """Likeness of two words of which either may be an initial."""
    if len(a) == 1 or len(b) == 1:
        return INITIAL_LIKENESS if a[:1] == b[:1] else 0.0
    return word_likeness(a, b)


def likeness(a: tuple[str, list[str]], b: tuple[str, list[str]], weight) -> float:
    """Soft weighted similarity of two parsed names; 0 where a rule says they differ."""
    (ga, wa), (gb, wb) = a, b
    if bool(ga) != bool(gb):
        return 0.0
    if not ga:
        return soft_likeness(tuple(wa), tuple(wb), weight)
    g = 1.0 if ga == gb else INITIAL_LIKENESS if 1 in (len(ga), len(gb)) and ga[0] == gb[0] else 0.0
    if not g or len(wa) != len(wb):
        return 0.0
    parts = [fits(x, y) for x, y in zip(wa, wb)]
    full = [min(len(x), len(y)) > 1 for x, y in zip(wa, wb)]
    if not all(parts) or not any(full):
        return 0.0
    load = [min(weight(x), weight(y)) if f else 0.5 for x, y, f in zip(wa, wb, full)]
    return (0.5 * g + sum(s * v for s, v in zip(parts, load))) / (0.5 + sum(load))


def person_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: persons of one block whose words may all fit, initials too; no pair that likeness() accepts is left out.

    Given names that agree share their first letter. Words that fit share it where one
    is an initial, and are two edits apart at most where none is: four in Levenshtein's
    count, in which a swap is two.
    """
    own = rows.filter("given <> ''").select("block", F.substring("given", 1, 1).alias("first"), F.size("words").alias("n"), "id", "words")
    side = lambda p: own.select("block", "first", "n", F.col("id").alias(p), F.col("words").alias(f"w{p}"))

    def may_fit(x, y):
        initial = (F.length(x) == 1) | (F.length(y) == 1)
        close = (F.abs(F.length(x) - F.length(y)) <= 2) & (F.levenshtein(x, y) <= 4)
        return F.when(initial, F.substring(x, 1, 1) == F.substring(y, 1, 1)).otherwise(close)

    met = side("a").join(side("b"), ["block", "first", "n"]).filter("a < b")
    return met.filter(F.forall(F.zip_with("wa", "wb", may_fit), lambda ok: ok)).select("a", "b")


def links(entries: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reps, edges): reps (block, name, id, entry) gives each entry's representative (the
    least entry with that name in the block), edges (a, b) links representatives.

    entries: block, entry BIGINT, name. Entries with a null block, id or name, or a
    name without a word, are linked to none. An entry that is repeated counts once.
    """
    pairs = bounded_collect(aliases.select("given_name", "alias"))
    if pairs is None:
        raise ValueError("the table of given names is beyond its documented bound")
    known = Aliases.of([tuple(r) for r in pairs])
    named = entries.dropna(subset=["block", "entry", "name"]).groupBy("block", "name", "entry").agg(F.lit(1)).select("block", "name", "entry")
    names = named.groupBy("block", "name").agg(F.min("entry").alias("id"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parsed(n, known) for n in b["name"]]
            out = b[["block", "id"]].copy()
            out["given"], out["words"] = [g for g, _ in got], [w for _, w in got]
            out["grams"] = [sorted(grams([w for w in [g, *ws] if len(w) > 1])) for g, ws in got]
            yield out[[len(g) > 0 for g in out["grams"]]]

    rows = cut(names.mapInPandas(parse, "block bigint, id bigint, given string, words array<string>, grams array<string>"))
    total = rows.count()
    # A person is never another thing, and persons that fit meet by their words.
    near = prefix_pairs(rows.filter("given = ''"), LEAST_JACCARD).unionByName(person_pairs(rows))
    # Rare words count more: inverse document frequency over all names, once for each name.
    words = rows.select("id", F.posexplode("words").alias("k", "w"))
    idf = words.select("id", "w").dropDuplicates().groupBy("w").agg(F.log1p(F.lit(float(total)) / F.count("*")).alias("v"))
    weights = words.join(idf, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).getField("v").alias("weights"))
    known_rows = cut(rows.join(weights, "id").select("id", F.struct("given", "words", "weights").alias("x")))
    pairs_ = near.join(known_rows.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(known_rows.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")

    @F.pandas_udf("double")
    def judge(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for ga, wa, va, gb, wb, vb in zip(a["given"], a["words"], a["weights"], b["given"], b["words"], b["weights"]):
            wa, wb = wa.tolist(), wb.tolist()
            weight = dict(zip(wa + wb, va.tolist() + vb.tolist()))
            top = max(weight.values(), default=1.0)
            out.append(likeness((ga, wa), (gb, wb), lambda w: weight.get(w, top)))  # noqa: B023
        return pd.Series(out, dtype=float)

    ok = pairs_.withColumn("likeness", judge("xa", "xb")).filter(F.col("likeness") >= LEAST_LIKENESS)
    given = lambda p: F.col(f"x{p}.given")
    ok = cut(ok.select("a", "b", "likeness", given("a").alias("ga"), given("b").alias("gb")))
    # An initial that fits several given names links to none of them: it would join different persons.
    side = lambda x, y: ok.filter((F.length(f"g{x}") == 1) & (F.length(f"g{y}") > 1)).select(F.col(x).alias("id"), F.col(f"g{y}").alias("full"))
    unsure = side("a", "b").unionByName(side("b", "a")).groupBy("id").agg(F.count_distinct("full").alias("n")).filter("n > 1").select("id")
    mixed = F.length("ga") != F.length("gb")
    one_initial = ((F.length("ga") == 1) | (F.length("gb") == 1)) & mixed
    who = F.when(F.length("ga") == 1, F.col("a")).otherwise(F.col("b"))
    bad = ok.filter(one_initial).withColumn("id", who).join(unsure, "id", "left_semi").select("a", "b")
    edges = ok.join(bad, ["a", "b"], "left_anti").select("a", "b", "likeness")
    return named.join(names, ["block", "name"]), edges


def groups(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(block, entry, group): every named entry with the least entry of those that mean the same one."""
    reps, edges = links(entries, aliases)
    comp = components(edges)
    return reps.join(comp, "id", "left").select("block", "entry", F.coalesce("component", "id").alias("group"))


def same_entries(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entry_1, entry_2), smaller first: all pairs within the groups, as the statement of the result asks."""
    g = cut(groups(entries, aliases))
    n = Window.partitionBy("block", "group")
    g = g.withColumn("n", F.count("*").over(n)).filter("n > 1").drop("n")
    a, b = g.withColumnRenamed("entry", "entry_1"), g.withColumnRenamed("entry", "entry_2")
    return a.join(b, ["block", "group"]).filter("entry_1 < entry_2").select("entry_1", "entry_2").dropDuplicates()


def typed_entries(sample: DataFrame) -> DataFrame:
    """(block, entry, name) of both sides of the pairs set side by side for review."""
    side = lambda p: F.struct(F.col(f"entry_{p}").alias("entry"), F.col(f"name_{p}").alias("name"))
    return sample.select(F.col("batch").alias("block"), F.explode(F.array(side("a"), side("b"))).alias("x")).select("block", "x.*")


