"""Own functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hexloom.functions.text import name_likeness


def register_functions(spark: SparkSession) -> list[str]:
    """Registers the Arrow UDFs and SQL macros of this library; returns their names."""
    spark.udf.register("name_likeness", name_likeness)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION agreement_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(least(a, b), greatest(a, b))")
    return ["name_likeness", "haversine_m", "agreement_ratio"]
