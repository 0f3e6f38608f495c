"""Queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm import leaks, matching, quality, tokens, variants
from hexloom.runtime import table


def _venues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    places = table(spark, d, "places")
    return matching.matches(matching.latest_known(places, "overture"), matching.latest_known(places, "fsq"))


def _ids(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.select(F.least("l_id", "r_id").alias("place_id_1"), F.greatest("l_id", "r_id").alias("place_id_2"), *columns)


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every close pair of an overture and an fsq place with its confidence."""
    return _ids(_venues(spark, d)[0], "metres", "dice", "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _ids(matching.sure_matches(*_venues(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    entries = variants.typed_entries(table(spark, d, "dup_triage_sample"))
    return variants.same_entries(entries, table(spark, d, "name_aliases"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every named entry with its group."""
    entries = variants.typed_entries(table(spark, d, "dup_triage_sample"))
    return variants.groups(entries, table(spark, d, "name_aliases")).select(F.col("block").alias("batch"), "entry", "group")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), key="doc_id", text="text")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they leak and the share of the item's words they hold."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.prose_outliers(table(spark, d, "documents")).filter(F.col("kind").isNotNull()).select("doc_id", "kind").dropDuplicates()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic of each document, its squared distance from prose and each statistic's part of it."""
    got = quality.prose_outliers(table(spark, d, "documents"))
    each = lambda c, p: [F.col(c)[i].alias(f"{p}{s}") for i, s in enumerate(quality.STATS)]
    return got.select("doc_id", "language", *each("x", ""), "d2", *each("parts", "part_"), "kind")


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p6_found, p6_groups, p8_ids, p9_found, p9_shares, p10_found, p10_statistics)}
ORACLE: dict[str, str] = {}
