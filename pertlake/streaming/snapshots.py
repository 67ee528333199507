"""Per-bucket state snapshots for ``foreachBatch`` streams.

A stream keeps a small state table keyed by entity (perturbation, conversation)
and hashed into ``n_buckets`` buckets. Batch ``b`` writes the new state of the
buckets it touched under ``data/batch_id=b/bucket=k`` and then commits a manifest
``_manifest/batch_id=b``: the full map bucket -> batch id of its current snapshot
(at most ``n_buckets`` rows). Batch ``b`` reads only the map of batch ``b - 1``, so
the bookkeeping per batch does not grow with the number of batches. A batch reads
only snapshots of *earlier* batch ids and overwrites only its own partitions, so
replaying a batch id after a failure gives the same result; old snapshots are
never modified (a retention job may delete those no map points to any more).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_of(key: str, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets)).cast("int")


def overwrite(df: DataFrame, path: str, *partition_cols: str, rebalance: bool = True) -> None:
    """Replace the written partitions only (dynamic partition overwrite).

    ``rebalance`` on the partition columns gives about one file per partition; AQE
    splits a hot partition into several files and merges small ones, so no task
    writes one file per bucket.
    """
    out = df.hint("rebalance", *partition_cols) if rebalance else df
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols)
        .parquet(path)
    )


def touched_buckets(rows: DataFrame, col: str = "bucket") -> list[int]:
    """Distinct bucket ids of a batch (at most ``n_buckets`` values reach the driver)."""
    return sorted(int(r[0]) for r in rows.select(col).distinct().collect())


def _map_rows(df: DataFrame) -> dict[int, int]:
    return {int(r["bucket"]): int(r["v"]) for r in df.select("bucket", "v").collect()}  # at most n_buckets rows


def previous_map(spark: SparkSession, state_path: str, batch_id: int) -> dict[int, int]:
    """Bucket -> batch id of its latest snapshot, as committed by the batch before
    ``batch_id`` (at most ``n_buckets`` entries).

    Every batch commits the full map, so normally only batch ``batch_id - 1``'s
    manifest is read (constant work per batch). The first batch of a query, or a
    gap in batch ids, falls back to the latest manifest before ``batch_id``."""
    manifest = f"{state_path}/_manifest"
    try:
        return _map_rows(spark.read.parquet(f"{manifest}/batch_id={int(batch_id) - 1}"))
    except AnalysisException:
        pass
    try:
        m = spark.read.parquet(manifest)
    except AnalysisException:  # no manifest yet: first batch
        return {}
    last = m.filter(F.col("batch_id") < F.lit(int(batch_id))).agg(F.max("batch_id")).first()[0]
    return {} if last is None else _map_rows(m.filter(F.col("batch_id") == F.lit(int(last))))


def read_previous(spark: SparkSession, state_path: str, prev: dict[int, int], touched: list[int]) -> DataFrame | None:
    """The latest earlier snapshot of each touched bucket, or None."""
    pairs = [(b, prev[b]) for b in touched if b in prev]
    return read_snapshot(spark, state_path, pairs) if pairs else None


def read_snapshot(spark: SparkSession, state_path: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows of the given (bucket, batch_id) snapshots, without the partition columns."""
    data = f"{state_path}/data"
    paths = [f"{data}/batch_id={v}/bucket={b}" for b, v in pairs]
    return spark.read.option("basePath", data).parquet(*paths).drop("batch_id", "bucket")


def by_bucket(df: DataFrame, key: str, n_buckets: int) -> DataFrame:
    """Hash-partition state rows on their bucket into ``n_buckets`` partitions.

    The explicit count keeps AQE from coalescing the exchange into one task at
    small sizes: buckets are written in parallel, one file each. A state row is
    one entity (bounded width), so buckets hold about the same number of rows."""
    if "bucket" not in df.columns:
        df = df.withColumn("bucket", bucket_of(key, n_buckets))
    return df.repartition(n_buckets, "bucket")


def write_snapshot(state: DataFrame, state_path: str, batch_id: int, key: str, n_buckets: int,
                   partitioned: bool = False) -> None:
    """Write ``state`` as this batch's snapshot of the buckets its keys fall in.

    ``partitioned=True`` when ``state`` already comes from :func:`by_bucket`;
    otherwise a ``rebalance`` on the bucket lets AQE size the files (large buckets
    are split, small ones merged), so the write scales with the state."""
    if "bucket" not in state.columns:
        state = state.withColumn("bucket", bucket_of(key, n_buckets))
    snap = state.withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
    overwrite(snap, f"{state_path}/data", "batch_id", "bucket", rebalance=not partitioned)


def commit(spark: SparkSession, state_path: str, batch_id: int, prev: dict[int, int], touched: list[int]) -> None:
    """Write this batch's full bucket -> snapshot map (last step of a batch; also for
    a batch that touched nothing, so the next batch finds the map at ``batch_id``)."""
    current = dict(prev)
    current.update({b: int(batch_id) for b in touched})
    marks = spark.createDataFrame(sorted(current.items()), "bucket int, v long").withColumn(
        "batch_id", F.lit(int(batch_id)).cast("long")
    )
    overwrite(marks, f"{state_path}/_manifest", "batch_id", rebalance=False)
