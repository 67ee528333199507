"""A bounded, documented sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(labels: DataFrame, target: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` documents of either label, those whose id hashes lowest.

    Repeated label rows of a document count once (the larger label); null ids and labels are left out.
    """
    one = (
        labels.filter(learn & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(target).cast("int").alias("label"))
        .withColumn("__order", F.xxhash64("doc_id"))
    )
    parts = [one.filter(F.col("label") == v).orderBy("__order", "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "label")
