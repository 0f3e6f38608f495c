"""Confidence of counts that several sources give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexloom.config import T

# Fixed values, from weak to strong.
LEVELS = ("unavailable", "single_source", "corroborated")


def rank(label: Column) -> Column:
    return F.when(label == "corroborated", 2).when(label == "single_source", 1).otherwise(0)


def label(rank_: Column) -> Column:
    return F.when(rank_ == 2, "corroborated").when(rank_ == 1, "single_source").otherwise("unavailable")


def agreement(a: Column, b: Column) -> Column:
    """Lesser over greater count, unrounded; 0 if one source is silent, null if both are."""
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double"))


def of_counts(a: Column, b: Column, least: float = T.min_agreement) -> Column:
    """corroborated needs both sources and agreement; one source alone, or two that disagree, is single_source."""
    return F.when((a > 0) & (b > 0) & (agreement(a, b) >= least), "corroborated").when((a > 0) | (b > 0), "single_source").otherwise("unavailable")


def weaker(a: Column, b: Column) -> Column:
    return label(F.least(rank(a), rank(b)))


def older(a: Column, b: Column) -> Column:
    """Earlier of two ISO dates as text; an empty or null one counts as missing."""
    return F.least(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def coarser(a: Column, b: Column) -> Column:
    """Lesser of two resolutions; 0 or null counts as missing."""
    return F.least(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0)))


def weakest(label_: Column) -> Column:
    """Aggregate: label of the weakest link; of no rows unavailable."""
    return label(F.coalesce(F.min(rank(label_)), F.lit(0)))


def sql_rank(c: str) -> str:
    return f"(CASE {c} WHEN 'corroborated' THEN 2 WHEN 'single_source' THEN 1 ELSE 0 END)"


def sql_label(c: str) -> str:
    return f"(CASE {c} WHEN 2 THEN 'corroborated' WHEN 1 THEN 'single_source' ELSE 'unavailable' END)"


def sql_of_counts(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 AND {b} > 0 AND least({a}, {b})::DOUBLE / greatest({a}, {b})::DOUBLE >= {T.min_agreement} THEN 'corroborated' WHEN {a} > 0 OR {b} > 0 THEN 'single_source' ELSE 'unavailable' END)"
