"""Session helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom import files

# Most driver-side rows of a dimension that is small by nature (snapshots of a
# feed, schema paths, fixed query areas). Beyond it `bounded_collect` returns
# None and callers take their distributed way.
DIMENSION_BOUND = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(app: str = "hexloom", cpus: str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the folder that all executors share.

    Unlike a checkpoint it is computed once (a checkpoint runs the last stage for its
    count and again for its files), is compressed, and later steps read only the columns they need.
    """
    path = files.shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def release(df: DataFrame) -> None:
    """Drop the table of a cut that nothing will read again, as rounds of a loop leave behind."""
    if path := getattr(df, "_cut_at", None):
        files.delete(df.sparkSession, path)


def bounded_collect(df: DataFrame, bound: int = DIMENSION_BOUND) -> list | None:
    """Rows of a small dimension, or None if it has more than `bound`."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition only if the input has fewer partitions than the cluster can use."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def finite(c) -> "F.Column":
    """The value where it is a finite number, else null (null, NaN, infinities)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | F.abs(c).isin(float("inf")), None).otherwise(c)
