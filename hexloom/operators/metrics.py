"""Facts of cells: counts by group and source, density, apportioned populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions import confidence as conf


def business_counts(places: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(*cell, metric, overture, fsq, value, agreement_ratio, n_sources, confidence).

    A place counts once in each of its groups and once in total. One pass: both
    sources are counted side by side, no pivot. Places without a cell are left out.
    """
    each = places.dropna(subset=list(cell)).select(*cell, "source", F.explode(F.array_append("groups", F.lit("total"))).alias("metric"))
    n = each.groupBy(*cell, "metric").agg(F.count_if(F.col("source") == "overture").alias("overture"), F.count_if(F.col("source") == "fsq").alias("fsq"))
    a, b = F.col("overture"), F.col("fsq")
    return n.select(
        *cell, "metric", "overture", "fsq", F.greatest(a, b).cast("double").alias("value"), F.coalesce(conf.agreement(a, b), F.lit(0.0)).alias("agreement_ratio"),
        ((a > 0).cast("int") + (b > 0).cast("int")).alias("n_sources"), conf.of_counts(a, b).alias("confidence"),
    )


def sql_business_counts(cell: str, source: str) -> str:
    return f"""SELECT {cell}, metric, overture, fsq, greatest(overture, fsq)::DOUBLE AS value, coalesce(least(overture, fsq)::DOUBLE / nullif(greatest(overture, fsq), 0), 0) AS agreement_ratio,
  (overture > 0)::INT + (fsq > 0)::INT AS n_sources, {conf.sql_of_counts("overture", "fsq")} AS confidence
  FROM (SELECT {cell}, metric, count(*) FILTER (source = 'overture') overture, count(*) FILTER (source = 'fsq') fsq FROM (SELECT {cell}, source, unnest(list_append(groups, 'total')) metric FROM {source}) GROUP BY ALL)"""


def per_land_km2(value: Column, land_m2: Column, land_fraction: Column) -> Column:
    """Value for each km2 of land; null below the least share of land."""
    return F.when((land_m2 > 0) & (land_fraction >= T.land_fraction_floor), value / (land_m2 / 1e6))


def withheld(land_m2: Column, land_fraction: Column) -> Column:
    return F.when(~((land_m2 > 0) & (land_fraction >= T.land_fraction_floor)), "too little land")


def apportioned(children: DataFrame, parents: DataFrame, *, parent: str, weight: str, value: str) -> DataFrame:
    """children with `value` of their parent dealt by weight; a parent whose weights add to nothing is split evenly.

    Parents without a child here and null weights give and take nothing.
    """
    w = Window.partitionBy(parent)
    kids = children.withColumn("_w", F.coalesce(F.col(weight), F.lit(0.0)))
    kids = kids.withColumns({"_sum": F.sum("_w").over(w), "_n": F.count("*").over(w)})
    share = F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(1 / F.col("_n"))
    return kids.join(parents.select(parent, F.col(value).alias("_p")), parent).withColumn(value, F.col("_p") * share).drop("_w", "_sum", "_n", "_p")


def saturation(pct: Column) -> Column:
    return F.when(pct >= T.saturated_pct, "saturated").when(pct < T.greenfield_pct, "open").when(pct.isNotNull(), "developing")


SQL_SATURATION = f"CASE WHEN builtup_pct >= {T.saturated_pct} THEN 'saturated' WHEN builtup_pct < {T.greenfield_pct} THEN 'open' WHEN builtup_pct IS NOT NULL THEN 'developing' END"


def growth(base: Column, now: Column) -> Column:
    """Growth in percent; null for a base of nothing."""
    return F.when(base > 0, 100 * (now - base) / base)


def is_stale(growth_pct: Column, land_fraction: Column, base_is_zero: Column | None = None) -> Column:
    """Grown by half or more, or from nothing, on real land."""
    big = F.coalesce(growth_pct >= T.stale_growth_pct, F.lit(False))
    return (big | (base_is_zero if base_is_zero is not None else F.lit(False))) & (land_fraction >= T.land_fraction_floor)


def without_metric(facts: DataFrame, metric: str, rebuilt: DataFrame) -> DataFrame:
    """Facts with one metric's rows replaced."""
    return facts.filter(F.col("metric") != metric).unionByName(rebuilt, allowMissingColumns=True)
