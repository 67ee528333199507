"""Incremental document refresh with Structured Streaming, by delta state.

New effect rows arrive as files. Each micro-batch (``foreachBatch``):

1. writes its rows to the effects log under its batch id and reads them back from there
   (a replayed batch replaces its own rows);
2. summarises them into the mergeable document state: one row per perturbation of the batch,
   a distributed aggregate with partial aggregation and partial top-N, so a perturbation that
   holds a third of the batch costs a partial row per map task
   (:func:`pertlake.operators.summaries.document_state`);
3. merges those rows with the current state of the same perturbations, read from the live
   versions in the touched buckets, and writes one new state row per touched perturbation;
4. renders the documents of those rows, one new document per touched perturbation;
5. commits the list of live batches and deletes versions that no reader needs any more.

State and documents are versioned delta tables (:mod:`pertlake.streaming.deltas`): a batch that
touches one perturbation writes one state row and one document, whatever the number of
perturbations seen before; the current rows are merged on read, and a compacting batch writes all of
them once the later versions are as many as the perturbations, or after ``COMPACT_AFTER`` batches. After any sequence of batches
:func:`read_documents` equals a batch rebuild over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertlake.functions.columns import DEFAULT_THRESHOLD, DEFAULT_TOP_N
from pertlake.operators.summaries import document_state, documents_from_state, merge_document_state
from pertlake.streaming import deltas
from pertlake.streaming import snapshots as snap

DEFAULT_BUCKETS = 16
KEY = "perturbation"


def _write(rows: DataFrame, path: str, batch_id: int, n_buckets: int) -> DataFrame:
    """Write this batch's version of ``rows`` and read it back."""
    out = rows.withColumn("bucket", snap.bucket_of(KEY, n_buckets)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    snap.overwrite(out, path, "batch_id", "bucket")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch_id={batch_id}")


def refresh_batch(
    batch: DataFrame,
    batch_id: int,
    effects_path: str,
    documents_path: str,
    n_buckets: int = DEFAULT_BUCKETS,
    top_n: int = DEFAULT_TOP_N,
    threshold: float = DEFAULT_THRESHOLD,
    tiebreak: tuple[str, ...] = (),
    state_path: str | None = None,
    compact_after: int = deltas.COMPACT_AFTER,
) -> None:
    spark = batch.sparkSession
    state_path = (state_path or documents_path.rstrip("/") + "_state").rstrip("/")
    bid = int(batch_id)

    snap.overwrite(batch.withColumn("batch_id", F.lit(bid).cast("long")), effects_path, "batch_id", rebalance=False)
    live = deltas.live_batches(spark, state_path, bid)
    try:
        rows = spark.read.schema(batch.schema).parquet(f"{effects_path}/batch_id={bid}")
        new = document_state(rows, top_n, threshold, (KEY,), tiebreak)
        keys = rows.select(KEY).filter(f"{KEY} is not null").distinct()
        touched = snap.touched_buckets(rows.filter(f"{KEY} is not null").select(snap.bucket_of(KEY, n_buckets).alias("bucket")))
    except snap.AnalysisException:  # an empty batch wrote no partition
        touched = []
    if not touched:
        deltas.commit(spark, state_path, bid, live)
        return
    compact = len(live) >= compact_after or deltas.outgrown(spark, state_path, live)
    old = deltas.read_live(spark, state_path, live, None if compact else touched)
    parts = new.filter(f"{KEY} is not null")
    if old is not None:
        before = deltas.current(old, KEY)
        if not compact:
            before = before.join(keys, KEY, "left_semi")
        parts = before.unionByName(parts)
    state = _write(merge_document_state(parts, top_n), state_path, bid, n_buckets)
    _write(documents_from_state(state, top_n, threshold), documents_path, bid, n_buckets)
    now = [bid] if compact else [*(b for b in live if b != bid), bid]
    deltas.commit(spark, state_path, bid, now)
    for path in (state_path, documents_path):
        deltas.retire(spark, path, {*live, *now})


def read_documents(spark: SparkSession, documents_path: str, state_path: str | None = None) -> DataFrame:
    """The current document of every perturbation (merge on read over the live batches)."""
    state_path = (state_path or documents_path.rstrip("/") + "_state").rstrip("/")
    live = deltas.live_batches(spark, state_path, 1 << 62)
    if not live:
        raise FileNotFoundError(f"no batch is committed under {state_path}")
    return deltas.current(deltas.read_live(spark, documents_path, live), KEY)


def incremental_refresh(
    spark: SparkSession,
    source_dir: str,
    schema,
    effects_path: str,
    documents_path: str,
    checkpoint_path: str,
    n_buckets: int = DEFAULT_BUCKETS,
    max_files_per_trigger: int = 4,
    tiebreak: Sequence[str] = (),
    state_path: str | None = None,
) -> DataFrame:
    """Run the refresh stream over all files available now; return the current documents."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    q = (
        stream.writeStream.foreachBatch(
            lambda df, bid: refresh_batch(
                df, bid, effects_path, documents_path, n_buckets, tiebreak=tuple(tiebreak), state_path=state_path
            )
        )
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return read_documents(spark, documents_path, state_path)
