"""Per-conversation bounded chat history with Structured Streaming.

Messages arrive as files. Each micro-batch (``foreachBatch``) writes its messages to a log, then
runs the batch operator :func:`pertlake.operators.dialogue.chat_history` over its own messages
plus a *carry* table: for every conversation seen before, the last ``n`` non-system messages of
its current segment (at most ``n`` rows) and one mark with the last turn seen. History rows are
emitted for the batch's messages, and the carry of the batch's conversations is replaced.

Late turns. A message whose turn lies at or before its conversation's mark changes the history
of later rows that were emitted already. Such messages are listed in a late table, and their
conversations (only those) are read back from the log, from which the rows from the first late
turn on are emitted again under this batch id, as a new version. :func:`read_history` returns
the latest version of every row, which equals the batch operator over all messages whatever
the order of arrival.

``chat_history`` splits a long conversation into turn ranges, so a conversation holding a third
of a batch is spread over many tasks; the carry is taken with a partial-limited window (at most
``n`` rows per conversation and map task cross the shuffle). State lives in per-bucket
snapshots (see :mod:`pertlake.streaming.snapshots`), log and output partitions are keyed by
batch id, so a replayed batch gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pertlake.operators.dialogue import HISTORY_MESSAGES, chat_history, chat_segments
from pertlake.streaming import snapshots as snap

DEFAULT_BUCKETS = 64
MESSAGE_COLUMNS = ("conv_id", "turn", "role", "text")


def history_rows(hist: DataFrame) -> DataFrame:
    """Flat view of the history arrays (count, roles, texts)."""
    return hist.select(
        "conv_id",
        "turn",
        "role",
        F.size("history").cast("long").alias("n_history"),
        F.array_join(F.transform("history", lambda x: x["role"]), ",").alias("history_roles"),
        F.array_join(F.transform("history", lambda x: x["content"]), "\n").alias("history_text"),
    )


def history_batch(
    batch: DataFrame,
    batch_id: int,
    output_path: str,
    state_path: str,
    n: int = HISTORY_MESSAGES,
    n_buckets: int = DEFAULT_BUCKETS,
) -> None:
    spark = batch.sparkSession
    bid = int(batch_id)
    reset = F.coalesce(F.col("reset_flag"), F.lit(0)) if "reset_flag" in batch.columns else F.lit(0)
    log = f"{state_path}/log"
    snap.overwrite(
        batch.select(*MESSAGE_COLUMNS, reset.cast("int").alias("reset_flag"))
        .withColumn("batch_id", F.lit(bid).cast("long")).withColumn("bucket", snap.bucket_of("conv_id", n_buckets)),
        log, "batch_id", "bucket",
    )
    prev = snap.previous_map(spark, state_path, bid)
    try:
        logged = spark.read.option("basePath", log).parquet(f"{log}/batch_id={bid}")
        touched = snap.touched_buckets(logged)
    except snap.AnalysisException:  # an empty batch wrote no partition
        touched = []
    if not touched:
        snap.commit(spark, state_path, bid, prev, [])
        return
    own = logged.select(*MESSAGE_COLUMNS, "reset_flag").withColumn("_carried", F.lit(False))
    convs = own.select("conv_id").distinct()
    old = snap.read_previous(spark, state_path, prev, touched)
    msgs = own
    if old is not None:
        marks = old.filter("is_mark").select("conv_id", F.col("turn").alias("_seen"))
        late = own.join(marks, "conv_id").filter(F.col("turn") <= F.col("_seen")).groupBy("conv_id").agg(F.min("turn").alias("first_late"), F.count(F.lit(1)).alias("n_late"))
        late = _late_table(late, f"{state_path}/late", bid)
        carried = old.filter("not is_mark").join(convs, "conv_id", "left_semi")
        if late is not None:
            carried = carried.join(late.select("conv_id"), "conv_id", "left_anti")
            # the whole conversation from the log; rows from the first late turn on are emitted again
            before = spark.read.option("basePath", log).parquet(log).filter((F.col("batch_id") < bid) & F.col("bucket").isin(touched))
            again = before.join(late, "conv_id").select(*MESSAGE_COLUMNS, "reset_flag", (F.col("turn") < F.col("first_late")).alias("_carried"))
            msgs = msgs.unionByName(again)
        # The carried messages all belong to the current segment: no reset among them.
        msgs = carried.select(*MESSAGE_COLUMNS, F.lit(0).alias("reset_flag"), F.lit(True).alias("_carried")).unionByName(msgs)

    out = history_rows(chat_history(msgs, n).filter(~F.col("_carried"))).withColumn("batch_id", F.lit(bid).cast("long"))
    snap.overwrite(out, output_path, "batch_id", rebalance=False)

    # New carry: the last n messages of each batch conversation's last segment (a system message
    # may reset too, so segments are taken over all messages), and the last turn seen as a mark.
    segments = chat_segments(msgs)
    last = segments.groupBy("conv_id").agg(F.max("segment_id").alias("_last"), F.max("turn").alias("_seen"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    turns = segments.filter(~F.col("role").eqNullSafe(F.lit("system"))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    tail = turns.join(last, "conv_id").filter(F.col("segment_id") == F.col("_last")).select(*MESSAGE_COLUMNS, F.lit(False).alias("is_mark"))
    if old is not None:  # conversations without new messages keep theirs, and no mark goes back
        tail = tail.unionByName(old.join(convs, "conv_id", "left_anti").select(*MESSAGE_COLUMNS, "is_mark"))
        last = last.select("conv_id", "_seen").unionByName(marks.join(convs, "conv_id", "left_semi")).groupBy("conv_id").agg(F.max("_seen").alias("_seen"))
    empty = F.lit(None).cast("string")
    mark = last.select("conv_id", F.col("_seen").alias("turn"), empty.alias("role"), empty.alias("text"), F.lit(True).alias("is_mark"))
    snap.write_snapshot(tail.unionByName(mark), state_path, bid, "conv_id", n_buckets)
    snap.commit(spark, state_path, bid, prev, touched)


def _late_table(late: DataFrame, path: str, batch_id: int) -> DataFrame | None:
    """``late`` (conv_id, first_late, n_late) written under the batch id; None if no message is late."""
    late.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    rows = late.sparkSession.read.schema(late.schema).parquet(f"{path}/batch_id={batch_id}")
    return None if rows.isEmpty() else rows


def read_history(spark: SparkSession, output_path: str) -> DataFrame:
    """The latest version of every history row: a row is emitted again when a late turn changes it.

    Rows that share a conversation and turn are kept apart by nothing but their batch, so all of
    the latest batch's stay.
    """
    rows = spark.read.parquet(output_path)
    newest = Window.partitionBy("conv_id", "turn")
    return rows.withColumn("_v", F.max("batch_id").over(newest)).filter(F.col("_v") == F.col("batch_id")).drop("_v", "batch_id")


def stream_history(
    spark: SparkSession,
    source_dir: str,
    schema,
    output_path: str,
    checkpoint_path: str,
    n: int = HISTORY_MESSAGES,
    max_files_per_trigger: int = 4,
    n_buckets: int = DEFAULT_BUCKETS,
    state_path: str | None = None,
) -> DataFrame:
    """Run the history stream over all files available now; return its output table."""
    state = (state_path or output_path.rstrip("/") + "_state").rstrip("/")
    msgs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    q = (
        msgs.writeStream.foreachBatch(lambda df, bid: history_batch(df, bid, output_path, state, n, n_buckets))
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return read_history(spark, output_path)
