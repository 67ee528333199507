"""Versioned delta tables for ``foreachBatch`` streams.

A table holds rows per key under ``batch_id=<b>/bucket=<k>``. A batch writes only the rows of the
keys it touched, as a new version; the current row of a key is the one of the latest live batch
(merge on read). The manifest of batch b lists the live batches. When those after the first hold as
many rows as the first (:func:`outgrown`), or after ``COMPACT_AFTER`` live batches, the next one
writes every current row and is the only live batch. So a read never merges more than
``COMPACT_AFTER + 1`` versions, and batches that touch most keys leave two of them, not that many;
the rows that a compacting batch writes again are paid for by as many written before.

A batch reads what the manifest *before* it lists and overwrites only its own partition, so a
replayed batch id gives the same result. Retention deletes batches that neither the manifest
of this batch nor the one before lists: a replay of this batch still finds its inputs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPACT_AFTER = 16


def _manifest(path: str) -> str:
    return f"{path}/_live"


def live_batches(spark: SparkSession, path: str, batch_id: int) -> list[int]:
    """The live batches before ``batch_id`` (at most COMPACT_AFTER + 1)."""
    ids = lambda df: sorted(int(r["live"]) for r in df.filter("live is not null").collect())
    try:
        return ids(spark.read.parquet(f"{_manifest(path)}/batch_id={int(batch_id) - 1}").select("live"))
    except AnalysisException:
        pass
    try:  # a gap in the batch ids, or the first batch
        m = spark.read.parquet(_manifest(path)).filter(F.col("batch_id") < int(batch_id))
    except AnalysisException:
        return []
    last = m.agg(F.max("batch_id")).first()[0]
    return [] if last is None else ids(m.filter(F.col("batch_id") == last).select("live"))


def commit(spark: SparkSession, path: str, batch_id: int, live: list[int]) -> None:
    """List the live batches after ``batch_id`` (the last step of a batch)."""
    rows = [(int(b),) for b in live] or [(None,)]
    spark.createDataFrame(rows, "live long").coalesce(1).write.mode("overwrite").parquet(f"{_manifest(path)}/batch_id={int(batch_id)}")


def read_live(spark: SparkSession, path: str, live: list[int], buckets: list[int] | None = None) -> DataFrame | None:
    """All versions of the live batches (only of ``buckets``), with batch_id and bucket."""
    if not live:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={b}" for b in live])
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def outgrown(spark: SparkSession, path: str, live: list[int]) -> bool:
    """Do the live batches after the first, the last that held every current row, hold as many rows as it?"""
    if len(live) < 2:
        return False
    rows = {int(b): n for b, n in read_live(spark, path, live).groupBy("batch_id").count().collect()}  # at most COMPACT_AFTER + 1
    first = rows.pop(min(live), 0)
    return sum(rows.values()) >= first


def current(versions: DataFrame, key: str) -> DataFrame:
    """The latest version of every key, without batch_id and bucket."""
    newest = Window.partitionBy(key).orderBy(F.col("batch_id").desc())
    return versions.withColumn("_v", F.row_number().over(newest)).filter("_v = 1").drop("_v", "batch_id", "bucket")


def retire(spark: SparkSession, path: str, keep: set[int]) -> list[int]:
    """Delete the partitions of batches that are not in ``keep``; returns their ids."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) not in keep:
            fs.delete(status.getPath(), True)
            gone.append(int(name.split("=")[1]))
    return sorted(gone)
