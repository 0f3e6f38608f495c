"""Columns of the served tables, and the check that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame

CELLS = """q bigint, r bigint, pq bigint, pr bigint, land_fraction double, land_area_m2 double, governorate string, builtup_pct double, coverage_ratio double, growth_pct double, population double,
    density_distorted boolean, pop_as_of string, pop_confidence string, pop_snapshot string, pop_res bigint, saturation_class string, population_stale boolean"""
METRICS = """q bigint, r bigint, metric string, track string, value double, overture bigint, fsq bigint, agreement_ratio double, confidence string, n_sources int, as_of string, source_snapshots string,
    native_res bigint, land_area_m2 double, value_per_land_km2 double"""
HISTORY = "h3_index string, h3_res bigint, metric string, snapshot_id string, value double, as_of string, confidence string, status string, excluded_from_corrected boolean"
PLACES = """source string, place_id bigint, name string, category string, lat double, lon double, h3_res9 string, h3_res8 string, dup_suspected boolean, x bigint, y bigint, q bigint, r bigint, pq bigint, pr bigint,
    groups array<string>"""


def held_to(df: DataFrame, schema: str) -> DataFrame:
    """df, if it has these columns with these types; TypeError names what differs."""
    want = {name: kind for name, kind in (c.split() for c in " ".join(schema.split()).split(", "))}
    have = dict(df.dtypes)
    if wrong := sorted(f"{c}: {have.get(c, 'missing')}, not {want.get(c, 'wanted')}" for c in want.keys() | have.keys() if want.get(c) != have.get(c)):
        raise TypeError("; ".join(wrong))
    return df
