"""Adapters: present the given tables as the inputs the operators expect.

* ``effects``        — perturbation x effect gene rows (lineitem joined to supplier and part)
* ``effects_sparse`` — many small perturbations (one per order), some with no significant row
* ``index``          — every document that has a vector: label (its first entity mention, else D<doc_id>), text, metadata, vector
* ``questions``      — free-text questions (documents)
* ``requests``       — structured requests (every label as written and in lower case, and an unknown one, x all types and an unknown one)
* ``messages``       — chat messages with a reset flag (conversations)
* ``metrics``        — loss series per run (events)

The joins are plain equi-joins: the optimiser/AQE picks broadcast only when the
statistics prove a side small; at scale supplier and part are large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertlake.functions.columns import entity_words, is_entity
from pertlake.functions.ranking import global_row_number
from pertlake.operators.retrieval import QUESTION_TEMPLATES
from pertlake.sources.tables import read_table

# Row-key columns that make the effect order total within a perturbation.
EFFECT_TIEBREAK = ("l_orderkey", "l_linenumber", "l_partkey")
SPARSE_TIEBREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem")


def _padj(li: DataFrame):
    return F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(F.col("l_discount"))


def _score():
    return (F.col("l_quantity") - F.lit(25.0)) * (F.lit(1) + F.col("l_linenumber")) / F.lit(4.0)


def effects(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (), below: float | None = None) -> DataFrame:
    """``extra`` lineitem columns are carried through unchanged (e.g. the ship date
    used as arrival time by the refresh stream). ``below`` keeps only rows with
    padj < ``below``: the test is on the stored columns, so it reaches the scan."""
    li = _li(spark, sf_dir)
    if below is not None:
        li = li.filter((F.col("l_linenumber") != 7) & (F.col("l_discount") < below))
    li = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", *extra
    )
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = li.join(sup, li.l_suppkey == sup.s_suppkey).join(part, li.l_partkey == part.p_partkey)
    return joined.select(
        F.col("s_name").alias("perturbation"),
        F.concat(F.col("p_brand"), F.lit(":"), F.col("p_type")).alias("effect_gene"),
        ((F.col("l_quantity") - F.lit(25.0)) / F.lit(4.0)).alias("log2fc"),
        _padj(li).alias("padj"),
        _score().alias("score"),
        F.when(F.col("l_linenumber") == 6, F.lit(None).cast("string"))
        .otherwise(F.col("l_returnflag"))
        .alias("cell_type"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        *extra,
    )


def effects_sparse(spark: SparkSession, sf_dir: str, below: float | None = None) -> DataFrame:
    li = _li(spark, sf_dir)
    if below is not None:
        li = li.filter((F.col("l_linenumber") != 7) & (F.col("l_discount") < below))
    return li.select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("perturbation"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("effect_gene"),
        ((F.col("l_quantity") - F.lit(25.0)) / F.lit(4.0)).alias("log2fc"),
        _padj(li).alias("padj"),
        _score().alias("score"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding, text, metadata of every aligned vector."""
    docs = read_table(spark, sf_dir, "documents")
    first = F.get(F.filter(entity_words(F.col("text")), is_entity), F.lit(0))
    labelled = docs.select(
        F.col("doc_id").alias("vec_id"),
        F.coalesce(first, F.concat(F.lit("D"), F.col("doc_id").cast("string"))).alias("label"),
        "text",
        F.struct("lang", "source", "n_chars").alias("metadata"),
    )
    return labelled.join(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("question")
    )


REQUEST_TYPES = (*QUESTION_TEMPLATES, "other")


def _numbered_requests(names: DataFrame) -> DataFrame:
    req = names.withColumn("t", F.explode(F.array(*[F.lit(t) for t in REQUEST_TYPES])))
    numbered = global_row_number(req, [F.col("p").asc_nulls_first(), F.col("t").asc_nulls_first()], "request_id")
    return numbered.select("request_id", F.col("p").alias("perturbation"), F.col("t").alias("question_type"))


def requests(spark: SparkSession, index: DataFrame) -> DataFrame:
    names = (
        index.select(F.explode(F.array(F.col("label"), F.lower("label"))).alias("p"))
        .unionByName(spark.range(1).select(F.lit("ZZ").alias("p")))
        .distinct()
    )
    return _numbered_requests(names)


def effect_requests(documents: DataFrame) -> DataFrame:
    """Every perturbation with a document, and an unknown one, x all types and an unknown one."""
    unknown = documents.sparkSession.range(1).select(F.lit("ZZ").alias("p"))
    return _numbered_requests(documents.select(F.col("perturbation").alias("p")).unionByName(unknown))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(F.col("role").isin("user", "system") & (F.length("text") % 7 == 0), F.lit(1)).otherwise(F.lit(0)).alias("reset_flag"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), F.col("value").alias("val_loss"))
