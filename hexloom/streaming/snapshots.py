"""Snapshots that arrive over time, as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hexloom import files

MANIFEST = "_manifest.json"


def arrivals(spark: SparkSession, path: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """New parquet files under a folder, in order of arrival; each is read once (checkpoint)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, key: str = "snapshot", least_rows: int = 0) -> StreamingQuery:
    """Appends all that has arrived to `out` by snapshot and ends.

    A batch is written to a folder named by its number and is there for readers once
    its manifest is: a batch that runs again after a failure replaces what it wrote.
    Rows are counted while they are written; a batch with fewer than `least_rows` fails
    and gets no manifest.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = f"{out}/batch={number}"
        if files.exists(spark, f"{at}/{MANIFEST}"):
            return
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(key).parquet(at)
        rows = seen.get["rows"]
        if rows < least_rows:
            files.delete(spark, at)
            raise ValueError(f"batch {number}: {rows} rows, at least {least_rows} expected")
        files.write_json(spark, f"{at}/{MANIFEST}", {"batch": number, "rows": rows})

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """What all published batches hold."""
    done = [f"{out}/{n}" for n in files.folders(spark, out) if n.startswith("batch=") and files.exists(spark, f"{out}/{n}/{MANIFEST}")]
    if not done:
        raise FileNotFoundError(f"no published batch in {out}")
    return spark.read.option("basePath", out).parquet(*done)


def with_gaps(series: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """A series with the declared gaps' notes beside it; nothing is interpolated. gaps: key, missing_snapshot, reason."""
    note = F.concat_ws(" ", F.array_sort(F.collect_list(F.format_string("%s is missing: %s.", "missing_snapshot", "reason"))))
    notes = gaps.groupBy(key).agg(note.alias("gap_note"))
    return series.join(notes, key, "left")


def recomputed(rows: DataFrame, late: DataFrame, series: list[str], build) -> DataFrame:
    """Series that late rows touch, built again from all their rows; the others are not read beyond their key.

    late: keys of series for which a row came after its successors; build makes the
    result of the rows of whole series. What stood for these series is to be replaced by it.
    """
    touched = late.select(*series).dropna().dropDuplicates()
    return build(rows.join(touched, series, "left_semi"))
