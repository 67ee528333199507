"""Operator 10, exact dedup by skew-safe combining.

Three combining stages, each of which groups on the full normalised text (the digest
only narrows the search):

1. local: the partial aggregate of every input partition keeps one row per distinct
   text of that partition, before anything is shuffled;
2. salted: local winners meet by (digest, salt, text), where the salt follows from the
   input partition, so a text that fills a third of the corpus is spread over the salts;
3. global: at most ``salts`` winners per text are combined into the group's result.

Defined results: a null text counts as empty; empty texts are equal to each other;
texts are compared after lower-casing A-Z only; the largest doc_id of a group stays;
of repeated rows with that same doc_id exactly one stays; rows with a null doc_id stay
only if their whole group has none (then one of them); very long texts are compared whole;
extra columns are kept by ``deduplicate`` and not read otherwise, so their names may clash;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import ascii_lower, checked_broadcast, materialize

SALTS = 16


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _normalised(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body"),
    )
    return rows.withColumn("digest", digest(F.col("body")))


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """One row per distinct content: digest, body, keep_id, group_size."""
    rows = _normalised(docs, id_col, text_col, digest)
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("digest", "salt", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return (
        salted.repartition("digest")
        .groupBy("digest", "body")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def annotate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    per_digest = materialize(
        content_groups(docs, id_col, text_col, salts, digest)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("contents"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "op10-groups",
    )
    rows = _normalised(docs, id_col, text_col, digest)
    members = rows.select("doc_id", "digest").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    single = per_digest.filter("contents = 1").drop("contents")
    out = members.join(single, "digest")
    shared = per_digest.filter("contents > 1").select("digest")
    if not shared.isEmpty():
        # different texts under one digest: those few rows are matched on the full text
        texts = content_groups(docs, id_col, text_col, salts, digest).join(F.broadcast(shared), "digest", "left_semi") \
            if shared.count() <= 1000 else content_groups(docs, id_col, text_col, salts, digest).join(shared, "digest", "left_semi")
        clash = (
            rows.join(shared, "digest", "left_semi")
            .groupBy("doc_id", "digest", "body").agg(F.count(F.lit(1)).alias("copies"))
            .join(texts, ["digest", "body"])
            .drop("body")
        )
        out = out.unionByName(clash)
    # repeated rows of one doc_id: as many result rows, the first of them kept
    return (
        out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", "digest", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        )
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that tie on content and largest doc_id are repeated rows; of those the one
    whose columns hash lowest stays.
    """
    marks = materialize(annotate(docs, id_col, text_col, salts), "op10-marks")
    dropped = marks.filter("not kept").select(
        F.col("doc_id").alias("__drop_id"), F.col("digest").alias("__drop_digest"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__tied"),
    ).distinct()
    n = dropped.count()
    names = docs.columns
    keyed = docs.withColumn("__digest", _sha256(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))

    def matches(side: DataFrame) -> Column:
        return keyed[id_col].cast("long").eqNullSafe(side["__drop_id"]) & (keyed["__digest"] == side["__drop_digest"])

    side = checked_broadcast(dropped, n)
    kept = keyed.join(side, matches(side), "left_anti").select(*names)
    tied = dropped.filter("__tied")
    if tied.isEmpty():
        return kept
    again = keyed.join(tied, matches(tied), "left_semi").withColumn("__row", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names]))
    first = F.row_number().over(_by_digest())
    return kept.unionByName(again.withColumn("__nth", first).filter("__nth = 1").select(*names))


def _by_digest():
    from pyspark.sql import Window

    return Window.partitionBy("__digest").orderBy("__row")
