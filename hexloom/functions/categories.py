"""Category groups over a flat and a hierarchical vocabulary."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPS = ("cafe", "restaurant", "pharmacy", "grocery", "gym")

# Flat categories of a group.
FLAT = {
    "cafe": ["cafe", "coffee_shop", "coffee_roastery"],
    "restaurant": [
        "restaurant", "american_restaurant", "armenian_restaurant", "asian_restaurant", "bar_and_grill_restaurant", "barbecue_restaurant", "brazilian_restaurant", "breakfast_and_brunch_restaurant", "buffet_restaurant",
        "burger_restaurant", "chicken_wings_restaurant", "chinese_restaurant", "comfort_food_restaurant", "diner", "doner_kebab", "doner_kebab_restaurant", "egyptian_restaurant", "european_restaurant", "falafel_restaurant",
        "fast_food_restaurant", "french_restaurant", "indian_restaurant", "indo_chinese_restaurant", "italian_restaurant", "japanese_restaurant", "latin_american_restaurant", "lebanese_restaurant", "mediterranean_restaurant",
        "middle_eastern_restaurant", "pizza_restaurant", "sandwich_shop", "seafood_restaurant", "soup_restaurant", "southern_restaurant", "southern_american_restaurant", "steakhouse", "sushi_restaurant", "syrian_restaurant",
        "thai_restaurant", "theme_restaurant", "turkish_restaurant", "vegetarian_restaurant",
    ],
    "pharmacy": ["pharmacy"],
    "grocery": ["grocery_store", "supermarket", "organic_grocery_store", "specialty_grocery_store"],
    "gym": ["gym", "gymnastics_center", "pilates_studio", "yoga_studio", "martial_arts_club"],
}
# Whole paths of a group.
PATHS = {
    "cafe": ["Dining and Drinking > Cafe, Coffee, and Tea House", "Dining and Drinking > Cafe, Coffee, and Tea House > Café", "Dining and Drinking > Cafe, Coffee, and Tea House > Coffee Shop", "Retail > Food and Beverage Retail > Coffee Roaster"],
    "pharmacy": ["Retail > Pharmacy"],
    "gym": [
        "Sports and Recreation > Gym and Studio", "Sports and Recreation > Gym and Studio > Gym", "Sports and Recreation > Gym and Studio > Pilates Studio", "Sports and Recreation > Gym and Studio > Yoga Studio",
        "Sports and Recreation > Gym and Studio > Cycle Studio", "Sports and Recreation > Gymnastics > Gymnastics Center",
    ],
    "grocery": ["Retail > Food and Beverage Retail > Grocery Store", "Retail > Food and Beverage Retail > Grocery Store > Organic Grocery", "Retail > Food and Beverage Retail > Supermarket"],
}
# Paths that hold a group with all below them; those but the first are of the tables at hand.
UNDER = {
    "restaurant": ["Dining and Drinking > Restaurant", "Food and Drink > Dining Room"],
    "cafe": ["Food and Drink > Coffee House"], "pharmacy": ["Health > Pharmacy Counter"], "grocery": ["Retail > Daily Goods"], "gym": ["Sport > Training Hall"],
}
# Categories of records that are no storefront; the last prefix and suffix are of the tables at hand.
NOT_STOREFRONT = {
    "set": [
        "freight_and_cargo_service", "public_and_government_association", "real_estate", "real_estate_agent", "real_estate_service", "real_estate_investment", "professional_services", "corporate_office",
        "shipping_center", "home_developer", "architectural_designer", "campus_building",
    ],
    "prefix": ["Business and Professional Services > Office", "Community and Government > Residential Building", "Community and Government > Housing Development", "Services > Property"],
    "suffix": [
        "College Classroom", "College Lab", "College Academic Building", "College Administrative Building", "College Auditorium", "College Science Building", "College Gym", "College Football Field", "College Stadium",
        "Student Center", "College Residence Hall", "College Bookstore", "College Quad", "College Theater", "College Library", "College Cafeteria", "Fraternity House", "Sorority House", "Property Office",
    ],
    "pattern": r"(?i)\bhq\b|head office|\boffice\b|holding|consultants?\b|شركة نقل|الصفحة الرسمية",
}


def rules(flat: dict = FLAT, paths: dict = PATHS, below: dict = UNDER) -> list[tuple[str, str, list[str], str]]:
    """(source, how a value is met, values, group) of a vocabulary. A prefix is met by itself or by a longer path."""
    return [("overture", "exact", v, g) for g, v in flat.items()] + [("fsq", "exact", v, g) for g, v in paths.items()] + [("fsq", "prefix", v, g) for g, v in below.items()]


def load_rules(path: str) -> list[tuple[str, str, list[str], str]]:
    """rules() of a JSON file with objects flat, paths and below; KeyError without one, ValueError for a group that is none."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    got = rules(given["flat"], given["paths"], given["below"])
    if unknown := sorted({g for *_, g in got} - set(GROUPS)):
        raise ValueError(f"no such groups: {', '.join(unknown)}")
    return got


RULES = rules()


def under(path: Column, prefix: str) -> Column:
    """The path is the prefix or goes on below it."""
    return (path == prefix) | path.startswith(prefix + " > ")


def met(source: Column, category: Column, group: str, by: list = RULES) -> Column:
    out = F.lit(False)
    for s, how, values, g in by:
        if g == group:
            hit = F.greatest(F.lit(False), *[under(category, v) for v in values]) if how == "prefix" else category.isin(values)
            out = out | ((source == s) & hit)
    return F.coalesce(out, F.lit(False))


def groups_of(source: Column, category: Column, by: list = RULES) -> Column:
    """All groups of a record in the fixed order, by a vocabulary of rules(); an empty array for none or a null category."""
    return F.array_compact(F.array(*[F.when(met(source, category, g, by), F.lit(g)) for g in GROUPS]))


def delimited(groups: Column) -> Column:
    """|a|b| at the boundary; an empty text for none."""
    return F.when(F.size(groups) > 0, F.concat(F.lit("|"), F.array_join(groups, "|"), F.lit("|"))).otherwise("")


def has_group(text: Column, group: str) -> Column:
    return F.array_contains(F.split(text, r"\|"), group)


def leaf(category: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(category, " > "), -1)


def short(category: Column) -> Column:
    """Leaf with blanks for underscores, as a sentence."""
    c = F.replace(leaf(category), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def not_storefront(source: Column, category: Column, name: Column) -> Column:
    """Prefix, set, suffix or pattern, whichever holds; null fields hold nothing."""
    parts = [category.isin(NOT_STOREFRONT["set"]), name.rlike(NOT_STOREFRONT["pattern"])]
    parts += [(source == "fsq") & category.startswith(p) for p in NOT_STOREFRONT["prefix"]]
    parts += [category.endswith("> " + s) | (category == s) for s in NOT_STOREFRONT["suffix"]]
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def not_storefront_plain(category: Column, name: Column) -> Column:
    """The flat source's variant with fewer clauses, for long series; null names read as text."""
    return F.coalesce(category.isin(NOT_STOREFRONT["set"]), F.lit(False)) | F.coalesce(name, F.lit("None")).rlike(NOT_STOREFRONT["pattern"])


_texts = lambda values: ", ".join("'" + v + "'" for v in values)


def _sql_met(how: str, values: list[str]) -> str:
    if how == "exact":
        return f"category IN ({_texts(values)})"
    return "(" + " OR ".join(f"category = '{v}' OR starts_with(category, '{v} > ')" for v in values) + ")"


_SQL_RULE = {g: " OR ".join(f"(source = '{s}' AND {_sql_met(how, v)})" for s, how, v, gg in RULES if gg == g) for g in GROUPS}
SQL_GROUPS = "list_filter([" + ", ".join(f"CASE WHEN {_SQL_RULE[g]} THEN '{g}' END" for g in GROUPS) + "], lambda g: g IS NOT NULL)"
_SQL_SET = f"coalesce(category IN ({_texts(NOT_STOREFRONT['set'])}), false)"
_SQL_PREFIX = " OR ".join(f"starts_with(category, '{p}')" for p in NOT_STOREFRONT["prefix"])
_SQL_SUFFIX = " OR ".join(f"ends_with(category, '> {s}') OR category = '{s}'" for s in NOT_STOREFRONT["suffix"])
SQL_NOT_STOREFRONT = f"({_SQL_SET} OR coalesce(regexp_matches(name, '{NOT_STOREFRONT['pattern']}'), false) OR coalesce(source = 'fsq' AND ({_SQL_PREFIX}), false) OR coalesce({_SQL_SUFFIX}, false))"
SQL_NOT_STOREFRONT_PLAIN = f"({_SQL_SET} OR regexp_matches(coalesce(name, 'None'), '{NOT_STOREFRONT['pattern']}'))"
