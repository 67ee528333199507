"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pertlake.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# a side is broadcast only when it was counted and has at most this many narrow rows
BROADCAST_ROWS = 2_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged (``lower`` on pure ASCII is the same, and faster)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(side: DataFrame, n_rows: int) -> DataFrame:
    """``side`` with a broadcast hint if its counted rows are few; unchanged (shuffle join) otherwise."""
    return F.broadcast(side) if n_rows <= BROADCAST_ROWS else side


# a key with more than 1 / HOT_PARTS of the rows of a join is hot; there are fewer than HOT_PARTS of them
HOT_PARTS = 4_096


def skew_safe_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row per ``key``; any share of ``rows`` may have one key.

    A counted small ``side`` is broadcast. Else the rows of hot keys, whose number is bounded by
    ``HOT_PARTS``, meet a broadcast of those keys' rows only, and the others are shuffled.
    """
    side = materialize(side, "side")
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    counts = materialize(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = materialize(counts.filter(F.col("__n") * HOT_PARTS > total).select(key), "hot")
    led = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key, "left")
    rest = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(side, key, "left")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema if f.name != key]
    without = rows.filter(F.col(key).isNull()).select("*", *missing)
    return led.unionByName(rest).unionByName(without)


def tokenizer_path(spark: SparkSession, file: str) -> str:
    """A public vocabulary file; the folder is the parameter ``pertlake.tokenizers`` or the installed package."""
    folder = spark.conf.get("pertlake.tokenizers", None)
    if folder:
        return os.path.join(folder, file)
    import public_tokenizers

    return public_tokenizers.path(file)
