"""Writers: immutable snapshots, partitioned facts, GeoJSON, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.files import exists, read_json, write_json


def archive_snapshot(df: DataFrame, base: str, source: str, snapshot: str, least_rows: int = 0) -> dict:
    """Writes snapshot=<id> once. With a manifest there it does nothing and returns it.

    The manifest comes last: a folder without one is an unfinished write and is
    replaced. Fewer rows than `least_rows` leave no manifest and raise.
    """
    spark, at = df.sparkSession, f"{base}/snapshot={snapshot}"
    if exists(spark, f"{at}/_manifest.json"):
        return read_json(spark, f"{at}/_manifest.json")
    df.withColumns({"_source": F.lit(source), "_snapshot_id": F.lit(snapshot)}).write.mode("overwrite").parquet(at)
    rows = spark.read.parquet(at).count()
    if rows < least_rows:
        raise ValueError(f"{snapshot}: {rows} rows, at least {least_rows} expected")
    manifest = {"source": source, "snapshot": snapshot, "rows": rows, "columns": df.columns}
    write_json(spark, f"{at}/_manifest.json", manifest)
    return manifest


def write_facts(df: DataFrame, path: str, by: tuple[str, ...] = ("res", "metric"), sort: str | None = None) -> None:
    """key=value folders; only the partitions that df has are replaced. Sorted rows let later scans skip."""
    out = df.repartition(*by)
    out = out.sortWithinPartitions(*by, sort) if sort else out
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_sorted(df: DataFrame, path: str, key: list[str], files: int) -> None:
    """Range-partitioned and sorted by key, so that min/max statistics find a key's row groups."""
    df.repartitionByRange(files, *key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def write_geojson_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line; a collection of any size needs no single writer."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_feature_collection(features: DataFrame, path: str, key: list[str], column: str = "feature") -> None:
    """One FeatureCollection over many files: in the order of their names they are one document.

    Features stand in the order of `key` (unique); all but the first begin with a comma.
    """
    first = features.agg(F.min(F.struct(*key)).alias("_first"))  # one row
    rows = features.join(F.broadcast(first)).select(F.lit(1).alias("_part"), *key, F.concat(F.when(F.struct(*key) == F.col("_first"), "").otherwise(","), column).alias("value"))
    frame = features.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "_part int, value string")
    whole = rows.unionByName(frame, allowMissingColumns=True)
    parts = max(1, features.sparkSession.sparkContext.defaultParallelism)
    whole.repartitionByRange(parts, "_part", *key).sortWithinPartitions("_part", *key).select("value").write.mode("overwrite").text(path)


def missing(listing: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Entries of a listing that are not there yet."""
    return listing.join(have.select(key).dropDuplicates(), key, "left_anti")
