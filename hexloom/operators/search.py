"""Search for cells by what is in them: gates with counted reasons, ranges, one stated order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.config import T
from hexloom.functions import confidence as conf
from hexloom.functions.categories import GROUPS
from hexloom.operators.metrics import saturation

SORTS = {"population": "asc", "count": "asc", "people_per_competitor": "desc", "builtup_pct": "asc", "growth_pct": "desc", "population_per_km2": "desc", "competitors_per_km2": "asc"}
NEED_CATEGORY = {"count", "people_per_competitor", "competitors_per_km2"}
RANGES = ("population", "count", "people_per_competitor", "builtup_pct", "growth_pct")


@dataclass(frozen=True)
class Search:
    category: str | None = None
    governorate: str | None = None
    saturation: str | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    min_confidence: str | None = None
    include_uninhabited: bool = False
    include_distorted: bool = False
    sort: str = "population"
    order: str | None = None
    limit: int = 100

    def __post_init__(self) -> None:
        if self.category is not None and self.category not in GROUPS:
            raise ValueError(f"unknown category {self.category}")
        if self.sort not in SORTS or (self.sort in NEED_CATEGORY and self.category is None):
            raise ValueError(f"unknown sort, or one that needs a category: {self.sort}")
        if self.order not in (None, "asc", "desc") or self.limit < 1:
            raise ValueError("order is asc or desc, limit at least 1")
        for name, (lo, hi) in self.ranges.items():
            if name not in RANGES or (lo is not None and hi is not None and lo > hi):
                raise ValueError(f"bad range for {name}")

    @property
    def descending(self) -> bool:
        """By default the order follows the direction in which the value is good."""
        return (self.order or SORTS[self.sort]) == "desc"

    @property
    def most(self) -> int:
        return min(self.limit, 500)


def admits(c: Column, lo: float | None, hi: float | None) -> Column:
    """An absent bound is none; a missing value is admitted only by no bounds."""
    out = F.lit(True)
    out = out if lo is None else out & (c >= lo)
    return out if hi is None else out & (c <= hi)


def inhabited(population: Column, builtup_pct: Column) -> Column:
    return (F.coalesce(population, F.lit(0.0)) >= T.inhabited_population) & F.coalesce(builtup_pct >= T.inhabited_builtup_pct, F.lit(False))


def gated(cells: DataFrame, facts: DataFrame, s: Search) -> DataFrame:
    """Every cell once with count, ratios, sort_value and gate: the first reason that rules it out, or null."""
    total = facts.filter(F.col("metric") == "total").select("q", "r", F.col("value").alias("total"), F.col("confidence").alias("_tc"))
    rows = cells.join(total, ["q", "r"], "left")
    if s.category:
        own = facts.filter(F.col("metric") == s.category).select("q", "r", F.col("value").alias("_own"), F.col("confidence").alias("_oc"))
        rows = rows.join(own, ["q", "r"], "left")
    else:
        rows = rows.withColumns({"_own": F.col("total"), "_oc": F.col("_tc")})
    count = F.when(F.col("total").isNotNull(), F.coalesce("_own", F.lit(0.0)))  # none of the category is a measured zero
    rows = rows.withColumns({"count": count, "confidence": F.coalesce("_oc", "_tc", F.lit("unavailable")), "saturation_class": saturation(F.col("builtup_pct"))})
    land = F.when((F.col("land_area_m2") > 0) & (F.col("land_fraction") >= T.land_fraction_floor), F.col("land_area_m2") / 1e6)
    rows = rows.withColumns({"people_per_competitor": F.try_divide("population", "count"), "population_per_km2": F.try_divide(F.col("population"), land), "competitors_per_km2": F.try_divide(F.col("count"), land)})
    rows = rows.withColumn("sort_value", F.col(s.sort))
    gate = F.when(F.lit(False), "")
    if s.governorate:
        gate = gate.when(~F.col("governorate").eqNullSafe(s.governorate), "region")
    if not s.include_distorted:
        gate = gate.when(F.coalesce("density_distorted", F.lit(False)), "distorted")
    if s.saturation:
        gate = gate.when(~F.col("saturation_class").eqNullSafe(s.saturation), "saturation")
    if not s.include_uninhabited:
        gate = gate.when(~inhabited(F.col("population"), F.col("builtup_pct")), "uninhabited")
    gate = gate.when(F.col("total").isNull(), "no_business_data").when(F.col("population").isNull(), "no_population_data")
    if s.sort == "people_per_competitor":
        gate = gate.when(F.col("people_per_competitor").isNull(), "undefined_ratio")
    gate = gate.when(F.col("sort_value").isNull(), "no_sort_value")
    return rows.withColumn("gate", gate).drop("_own", "_oc", "_tc")


def matched(gated_: DataFrame, s: Search) -> DataFrame:
    """Cells that pass the gates, the ranges and the least confidence."""
    keep = F.col("gate").isNull()
    for name, (lo, hi) in s.ranges.items():
        by_density = name == "population" and s.sort == "population_per_km2"
        keep = keep & admits(F.col("population_per_km2" if by_density else name), lo, hi)
    if s.min_confidence:
        keep = keep & (conf.rank(F.col("confidence")) >= conf.LEVELS.index(s.min_confidence))
    return gated_.filter(keep)


def top(matched_: DataFrame, s: Search) -> DataFrame:
    """The best `limit` by the stated order, ties by cell."""
    by = F.desc("sort_value") if s.descending else F.asc("sort_value")
    return matched_.orderBy(by, "q", "r").limit(s.most)


def plateau(matched_: DataFrame) -> DataFrame:
    """One row: how many matches stand within a hair of the greatest population, on all matches before any cap."""
    top_ = matched_.agg(F.max("population").alias("top"))
    return matched_.join(F.broadcast(top_), F.lit(True)).agg(F.max("top").alias("top"), F.count_if(F.col("population") >= T.plateau_share * F.col("top")).alias("cells"), (F.count_if(F.col("population") >= T.plateau_share * F.col("top")) >= T.plateau_cells).alias("is_plateau"))


def tiny_base(matched_: DataFrame) -> DataFrame:
    """One row: matches whose growth starts from less than one percent built up."""
    factor = 1 + F.col("growth_pct") / 100
    base = F.when(factor > 0, F.col("builtup_pct") / factor)
    return matched_.agg(F.count("*").alias("cells"), F.count_if(base < 1).alias("tiny_base"))
