"""The index of effect documents: documents by perturbation, vectors by profile.

Two key spaces meet. Every perturbation has a document (O38/O39); a profile vector exists only
where a significant effect does. The index is what both have, numbered in name order. A vector
is its sparse unit profile, the linear embedding at full width (an orthonormal projection keeps
every dot product), so nothing grows with the number of genes but the non-zero entries.

Questions are answered from this index like from any other: by name, or by the entries nearest
to the centroid of all vectors; the metadata of an answer is the document's (O39).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertlake.functions.columns import NORM_EPS
from pertlake.functions.ranking import global_row_number
from pertlake.operators.retrieval import DEFAULT_K, structured_requests
from pertlake.session import written

SCORE_DIGITS = 9  # scores are compared after rounding, so that the order of a sum decides nothing


def effect_index(documents: DataFrame, unit: DataFrame) -> DataFrame:
    """vec_id, label, text, metadata of every perturbation that has a document and a profile."""
    profiled = unit.select("perturbation").distinct()
    names = documents.select("perturbation").join(profiled, "perturbation", "left_semi")
    # only names are sorted; a document is moved once, to its number
    numbered = global_row_number(names, [F.col("perturbation").asc()], "vec_id")
    return numbered.join(documents, "perturbation").select("vec_id", F.col("perturbation").alias("label"), "text", "metadata")


def without_vector(documents: DataFrame, unit: DataFrame) -> DataFrame:
    """Perturbations on one side only (O28): ``side`` is no_document or no_embedding."""
    profiled = unit.select("perturbation").distinct()
    return documents.join(profiled, "perturbation", "left_anti").select("perturbation", F.lit("no_embedding").alias("side")).unionByName(
        profiled.join(documents, "perturbation", "left_anti").select("perturbation", F.lit("no_document").alias("side"))
    )


def nearest_to_centroid(unit: DataFrame, index: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """rank, label, vec_id, score: the k entries with the largest cosine with the mean of all vectors.

    All on the long form: the centroid is a sum per gene, a score a sum per perturbation, the
    top k a partial limit per task. Ties (after rounding) go to the smaller vec_id.
    """
    names = index.select("vec_id", F.col("label").alias("perturbation"))
    entries = unit.join(names, "perturbation")
    n = names.agg(F.count(F.lit(1)).cast("double")).scalar()
    centroid = entries.groupBy("effect_gene").agg(F.sum("value").alias("_total")).select("effect_gene", (F.col("_total") / n).alias("mean"))
    length = centroid.agg(F.sqrt(F.sum(F.col("mean") * F.col("mean")))).scalar()
    scores = entries.join(centroid, "effect_gene").groupBy("vec_id", F.col("perturbation").alias("label")).agg(
        F.sum(F.col("value") * F.col("mean")).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("own")
    )
    # the guards of the index (a vector shorter than 1e-8 stays as it is) and of a query
    by = F.when(F.col("own") < NORM_EPS, F.lit(1.0)).otherwise(F.col("own")) * F.when(length > NORM_EPS, length).otherwise(F.lit(1.0))
    top = scores.select("vec_id", "label", F.round(F.col("dot") / by, SCORE_DIGITS).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "label")))
    return top.agg(ordered.alias("hits")).select(F.posexplode("hits").alias("rank", "hit")).select(
        (F.col("rank") + 1).cast("long").alias("rank"), F.col("hit.label").alias("label"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )


def answer_requests(requests: DataFrame, documents: DataFrame, unit: DataFrame, k: int = DEFAULT_K, completions: DataFrame | None = None) -> DataFrame:
    """Structured answers about perturbations, from effects to prompt and metadata (see ``structured_requests``).

    ``requests`` (request_id, perturbation, question_type), ``documents`` (perturbation, text,
    metadata) and ``unit`` (perturbation, effect_gene, value) are written tables; the index and
    its k fallback hits are written once.
    """
    index = written(effect_index(documents, unit), "effect-index")
    near = written(nearest_to_centroid(unit, index, k), "effect-fallback")
    return structured_requests(requests, index, k, completions, fallback=near)
