"""Thresholds, read strictly: a missing or misplaced value is an error at start, never a default."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

# Fixed values.
DEFAULTS = {
    "report_resolution": 9, "coverage_resolution": 8, "default_k": 1, "max_k": 12, "default_radius_m": 500.0,
    "land_fraction_floor": 0.05, "saturated_pct": 40.0, "greenfield_pct": 10.0, "growth_material_pct": 5.0,
    "min_agreement": 0.667, "percent_min_base": 10.0, "inhabited_population": 100.0, "inhabited_builtup_pct": 5.0,
    "duplicate_m": 40.0, "duplicate_similarity": 0.72, "min_corrected_points": 8, "stale_growth_pct": 50.0,
    "jump_pct": 40.0, "flat_pct": 15.0, "min_flat": 3, "min_base": 5.0, "min_abs_jump": 3.0,
    "collapse_group": 3, "collapse_decimals": 5, "intra_m": 150.0, "distortion_min": 20,
    "carrier_share": 0.99, "carrier_fail": 0.9, "carrier_warn": 0.6, "carrier_min_parents": 50,
    "direction_band_pct": 10.0, "divergence_points": 20.0, "plateau_share": 0.995, "plateau_cells": 10,
    "pixel_builtup_min": 500.0, "land_scale": 10_000.0, "land_nodata": 65_535, "superpixel": 20, "earth_m": 6_371_000.0,
}


@dataclass(frozen=True)
class Thresholds:
    report_resolution: int
    coverage_resolution: int
    default_k: int
    max_k: int
    default_radius_m: float
    land_fraction_floor: float
    saturated_pct: float
    greenfield_pct: float
    growth_material_pct: float
    min_agreement: float
    percent_min_base: float
    inhabited_population: float
    inhabited_builtup_pct: float
    duplicate_m: float
    duplicate_similarity: float
    min_corrected_points: int
    stale_growth_pct: float
    jump_pct: float
    flat_pct: float
    min_flat: int
    min_base: float
    min_abs_jump: float
    collapse_group: int
    collapse_decimals: int
    intra_m: float
    distortion_min: int
    carrier_share: float
    carrier_fail: float
    carrier_warn: float
    carrier_min_parents: int
    direction_band_pct: float
    divergence_points: float
    plateau_share: float
    plateau_cells: int
    pixel_builtup_min: float
    land_scale: float
    land_nodata: int
    superpixel: int
    earth_m: float


def load(source: str | dict) -> Thresholds:
    """Thresholds from a dict or the path of a JSON file; KeyError names all that are missing, TypeError what is no number."""
    if not isinstance(source, dict):
        with open(source, encoding="utf-8") as f:
            source = json.load(f)
    names = [f.name for f in fields(Thresholds)]
    if missing := [n for n in names if n not in source]:
        raise KeyError(f"missing thresholds: {', '.join(missing)}")
    if wrong := [n for n in names if isinstance(source[n], bool) or not isinstance(source[n], int | float)]:
        raise TypeError(f"thresholds that are no numbers: {', '.join(wrong)}")
    return Thresholds(**{n: source[n] for n in names})


T = load(DEFAULTS)
