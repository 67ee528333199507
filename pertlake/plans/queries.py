"""Registered queries: one per operator of the inventory, each over whole tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and types match the DuckDB SQL in :mod:`pertlake.plans.oracle`.
Floating results that depend on summation order are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertlake.functions.columns import DEFAULT_THRESHOLD
from pertlake.functions.ranking import global_row_number
from pertlake.operators import dialogue as dlg
from pertlake.operators import effect_index as eidx
from pertlake.operators import effects as eff
from pertlake.operators import embedding as emb
from pertlake.operators import index as idx
from pertlake.operators import profiles as prof
from pertlake.operators import retrieval as ret
from pertlake.operators import summaries as summ
from pertlake.plans import adapters as ad
from pertlake.session import scratch_path, written
from pertlake.sources import store
from pertlake.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _effects(spark, sf):
    return eff.clean_effects(ad.effects(spark, sf))


def _significant(spark, sf):
    """The significant rows only, for operators that use no others: tested at the scan."""
    return eff.clean_effects(ad.effects(spark, sf, below=DEFAULT_THRESHOLD))


T = ad.EFFECT_TIEBREAK

# ---------------------------------------------------------------- filters


@register("clean_missing")
def q_clean_missing(spark, sf):
    # Key columns rendered as text with one in seven replaced by a missing token.
    raw = ad.effects(spark, sf).select(
        F.when(F.col("l_linenumber") == 3, F.lit("NA")).otherwise(F.col("perturbation")).alias("perturbation"),
        F.when(F.col("l_linenumber") == 4, F.lit("null")).otherwise(F.col("effect_gene")).alias("effect_gene"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    return eff.clean_missing(raw, drop_null_keys=("perturbation",))


@register("coerce_numeric")
def q_coerce_numeric(spark, sf):
    raw = ad.effects(spark, sf).select(
        "perturbation",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("log2fc").cast("string").alias("log2fc"),
        F.when(F.col("l_linenumber") == 5, F.lit("5d")).otherwise(F.col("padj").cast("string")).alias("padj"),
        F.when(F.col("l_linenumber") == 2, F.lit("abc")).otherwise(F.col("score").cast("string")).alias("score"),
    )
    return eff.coerce_numeric(raw)


@register("significant_effects")
def q_significant(spark, sf):
    return eff.significant_effects(_significant(spark, sf)).select(
        "perturbation", "effect_gene", "log2fc", "padj", "score", *T
    )


@register("direction_split")
def q_direction(spark, sf):
    d = eff.direction_split(eff.significant_effects(_significant(spark, sf)))
    return d.groupBy("perturbation", "direction").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("log2fc").alias("sum_log2fc")
    )


# ---------------------------------------------------------------- summaries


@register("perturbation_summary")
def q_summary(spark, sf):
    return summ.perturbation_summary(_effects(spark, sf), tiebreak=T)


@register("summary_sparse")
def q_summary_sparse(spark, sf):
    e = eff.clean_effects(ad.effects_sparse(spark, sf))
    return summ.perturbation_summary(e, tiebreak=ad.SPARSE_TIEBREAK)


@register("strongest_effect")
def q_strongest(spark, sf):
    return summ.strongest_effect(_effects(spark, sf), tiebreak=T)


@register("top_effects")
def q_top_effects(spark, sf):
    return summ.top_effects(_significant(spark, sf), tiebreak=T).select(
        "perturbation", "direction", "rank", "effect_gene", "log2fc", "padj", "score"
    )


@register("gene_lines")
def q_gene_lines(spark, sf):
    top = summ.top_effects(_significant(spark, sf), tiebreak=T)
    return summ.gene_lines(top).select("perturbation", "direction", "rank", "line")


@register("top_gene_lists")
def q_top_gene_lists(spark, sf):
    lists = summ.top_gene_lists(summ.top_effects(_significant(spark, sf), tiebreak=T))
    return lists.select(
        "perturbation",
        F.array_join("top_up_genes", "|").alias("top_up_genes"),
        F.array_join("top_down_genes", "|").alias("top_down_genes"),
    )


@register("cell_type_phrase")
def q_cell_type_phrase(spark, sf):
    return summ.cell_type_phrase(_significant(spark, sf), tiebreak=T).select("perturbation", "cell_type_phrase")


@register("documents_text")
def q_documents_text(spark, sf):
    return summ.documents(_effects(spark, sf), tiebreak=T).select("perturbation", "text")


@register("document_metadata")
def q_document_metadata(spark, sf):
    return summ.flatten_metadata(summ.documents(_effects(spark, sf), tiebreak=T))


@register("documents_sparse")
def q_documents_sparse(spark, sf):
    e = eff.clean_effects(ad.effects_sparse(spark, sf))
    return summ.documents(e, tiebreak=ad.SPARSE_TIEBREAK).select("perturbation", "text")


# ---------------------------------------------------------------- profiles

GENES_KEPT = 32  # top-K genes for the selection queries (the default cap, 2048, keeps all)


def _unit(spark, sf):
    return prof.profile_unit(prof.profile_long(_significant(spark, sf)))


def _written_unit(spark, sf):
    # read several times by its users: written once instead of scanning the effects for each
    return written(_unit(spark, sf), "unit")


def _kept(unit):
    return prof.top_genes(prof.gene_importance(unit), GENES_KEPT)


@register("profile_long")
def q_profile_long(spark, sf):
    p = prof.profile_long(_significant(spark, sf))
    return p.select("perturbation", "effect_gene", F.round("value", 6).alias("value"))


@register("profile_unit")
def q_profile_unit(spark, sf):
    return _unit(spark, sf).select("perturbation", "effect_gene", F.round("value", 6).alias("value"))


@register("gene_importance")
def q_gene_importance(spark, sf):
    imp = prof.gene_importance(_written_unit(spark, sf))
    return imp.select("effect_gene", F.round("importance", 6).alias("importance"))


@register("top_genes")
def q_top_genes(spark, sf):
    return _kept(_written_unit(spark, sf)).select("effect_gene", "gene_index", F.round("importance", 6).alias("importance"))


@register("catalog_genes")
def q_catalog_genes(spark, sf):
    unit = _written_unit(spark, sf)
    return prof.catalog_genes(unit, _kept(unit))


@register("catalog_counts")
def q_catalog_counts(spark, sf):
    # The catalogue is written as tables with its configuration, and all of them are read back
    profile = written(prof.profile_long(_significant(spark, sf)), "profile")
    path = scratch_path(spark, "catalog")
    counts = prof.catalog_counts(profile)
    n_genes = counts.first()["n_genes"]
    store.save_catalog(
        profile.select("effect_gene").distinct(), profile.select("perturbation").distinct(), counts, path,
        config={"max_genes": prof.DEFAULT_MAX_GENES, "embed_dim": emb.DEFAULT_EMBED_DIM, "genes_kept": min(n_genes, prof.DEFAULT_MAX_GENES)},
    )
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    genes = read("genes").agg(F.count(F.lit(1)).alias("gene_rows"), F.min("effect_gene").alias("first_gene"), F.max("effect_gene").alias("last_gene"))
    perts = read("perturbations").agg(F.count(F.lit(1)).alias("perturbation_rows"), F.min("perturbation").alias("first_perturbation"))
    # one row each
    return read("counts").join(F.broadcast(genes)).join(F.broadcast(perts)).join(F.broadcast(read("config")))


@register("embedding_object")
def q_embedding_object(spark, sf):
    # O04/O05 in the source's form: one JSON object, written and read back by byte ranges
    path = scratch_path(spark, "embedding_object")
    store.write_embedding_object(_emb(spark, sf), path, label="vec_id")
    back = store.read_embedding_object(spark, path, split_bytes=1 << 16)
    return back.select(F.col("label").cast("long").alias("vec_id"), F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@register("read_effects")
def q_read_effects(spark, sf):
    # Effects written as CSV with the source's header names, read back as text, cleaned
    path = scratch_path(spark, "effects_csv")
    store.write_effects_csv(ad.effects(spark, sf), path)
    back = eff.clean_effects(store.read_effects_csv(spark, path))
    return back.select(
        "perturbation", "effect_gene", "log2fc", "padj", "score", "cell_type",
        *[F.col(c).cast("long").alias(c) for c in T],
    )


@register("documents_json")
def q_documents_json(spark, sf):
    # Documents written as JSON lines and read back with the nested schema
    path = scratch_path(spark, "documents_json")
    store.write_documents_json(summ.documents(_effects(spark, sf), tiebreak=T), path)
    d = store.read_documents_json(spark, path)
    m = "metadata."
    return d.select(
        "perturbation", "text",
        *[F.col(m + c).alias(c) for c in ("n_significant", "n_upregulated", "n_downregulated", "n_up_shown", "n_down_shown")],
        *[F.array_join(m + c, "|").alias(c) for c in ("top_up_genes", "top_down_genes", "cell_types")],
        *[F.col(m + c).alias(c) for c in ("max_log2fc", "min_log2fc", "strongest_gene", "strongest_log2fc")],
    )


@register("profile_wide")
def q_profile_wide(spark, sf):
    wide = prof.profile_wide(_written_unit(spark, sf), block=64)
    entries = wide.select("perturbation", "n_genes", "block", F.explode(F.arrays_zip("places", "values")).alias("e"))
    return entries.filter("e.values != 0").select(
        "perturbation", "n_genes", (F.col("block") * 64 + F.col("e.places")).alias("place"), F.round("e.values", 6).alias("value")
    )


@register("holdout_split")
def q_holdout_split(spark, sf):
    return prof.holdout_split(prof.profile_long(_significant(spark, sf)))


# ---------------------------------------------------------------- index


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings")


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _aligned(spark, sf):
    return idx.align_index(_emb(spark, sf), _docs(spark, sf).select("doc_id", "lang", "n_chars"))


def _indexed(spark, sf):
    # the index that is written and read back: vector, label, document text and metadata
    docs = _docs(spark, sf).select("doc_id", "text", F.struct("lang", "source", "n_chars").alias("metadata"))
    return idx.align_index(_emb(spark, sf), docs)


def _vec_summary(df, id_col="vec_id", vec="embedding"):
    from pertlake.functions.columns import array_l2_norm

    return df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(vec).cast("long").alias("n_dims"),
        F.round(array_l2_norm(F.col(vec)), 6).alias("norm"),
    )


@register("embedding_centroid")
def q_centroid(spark, sf):
    c = idx.embedding_centroid(_emb(spark, sf))
    return c.select("dim", F.round("value", 6).alias("value"))


@register("embedding_unit")
def q_embedding_unit(spark, sf):
    u = idx.embedding_unit(_emb(spark, sf))
    return u.select("vec_id", F.posexplode("unit_embedding").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


@register("align_index")
def q_align_index(spark, sf):
    return _aligned(spark, sf).select("vec_id", "label", "lang", "n_chars")


@register("align_missing")
def q_align_missing(spark, sf):
    return idx.align_missing(_emb(spark, sf), _docs(spark, sf))


@register("index_quality")
def q_index_quality(spark, sf):
    return idx.index_quality(_emb(spark, sf), _docs(spark, sf))


@register("knn_cosine")
def q_knn(spark, sf):
    hits = idx.knn_cosine(_emb(spark, sf), _aligned(spark, sf), 3, query_id="vec_id")
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("search_documents")
def q_search_documents(spark, sf):
    # the hits of the index's own vectors, with the label and document of each
    index = _index(spark, sf)
    hits = idx.search_documents(idx.knn_cosine(index, index, 3, query_id="vec_id"), index)
    return hits.select("query_id", "rank", "label", F.round("score", 6).alias("score"), "text", F.col("metadata.lang").alias("lang"))


@register("self_retrieval")
def q_self_retrieval(spark, sf):
    return idx.self_retrieval(_aligned(spark, sf))


@register("catalog_labels")
def q_catalog_labels(spark, sf):
    a = _aligned(spark, sf)
    n = a.agg(F.count(F.lit(1)).cast("long")).scalar()
    return a.select("vec_id", n.alias("n_documents"))


@register("embedding_rows")
def q_embedding_rows(spark, sf):
    path = scratch_path(spark, "embedding_map")
    store.write_embedding_map(_emb(spark, sf), path, label="vec_id")
    back = store.read_embedding_map(spark, path)
    return _vec_summary(back, id_col="label")


@register("embedding_roundtrip")
def q_embedding_roundtrip(spark, sf):
    path = scratch_path(spark, "embeddings")
    store.write_embeddings(_emb(spark, sf), path)
    return _vec_summary(spark.read.parquet(path))


@register("index_manifest")
def q_index_manifest(spark, sf):
    path = scratch_path(spark, "index")
    store.save_index(_indexed(spark, sf), path)
    return store.load_index(spark, path)[1]


@register("index_roundtrip")
def q_index_roundtrip(spark, sf):
    from pertlake.functions.columns import array_l2_norm

    path = scratch_path(spark, "index")
    store.save_index(_indexed(spark, sf), path)
    index, _ = store.load_index(spark, path)
    return index.select("vec_id", "label", F.round(array_l2_norm(F.col("unit_embedding")), 6).alias("unit_norm"))


# ---------------------------------------------------------------- retrieval


def _index(spark, sf):
    # every text is tokenised for its label once; the users read it several times
    return written(ad.index(spark, sf), "index")


def _hits(spark, sf):
    return ret.retrieve_context(ad.questions(spark, sf), _index(spark, sf))


def _index_and_near(spark, sf):
    """The written index and its fallback hits, for contexts built from both."""
    index = _index(spark, sf)
    return {"index": index, "fallback": written(ret.fallback_hits(index), "fallback")}


@register("entity_mentions")
def q_entity_mentions(spark, sf):
    return ret.entity_mentions(ad.questions(spark, sf))


@register("known_entities")
def q_known_entities(spark, sf):
    return ret.known_entities(ret.entity_mentions(ad.questions(spark, sf)), ad.index(spark, sf))


@register("lookup_by_name")
def q_lookup_by_name(spark, sf):
    index = _index(spark, sf)
    names = ad.requests(spark, index).select("request_id", F.col("perturbation").alias("name"))
    cat = index.select("label", "vec_id")
    return ret.lookup_by_name(names, cat).select("request_id", "name", "label", "vec_id")


@register("retrieve_context")
def q_retrieve_context(spark, sf):
    h = _hits(spark, sf)
    return h.select("query_id", "rank", "label", "vec_id", F.round("score", 6).alias("score"), "source_kind")


@register("context_block")
def q_context_block(spark, sf):
    at = _index_and_near(spark, sf)
    return ret.context_block(ret.retrieve_context(ad.questions(spark, sf), **at), **at)


@register("augmented_prompt")
def q_augmented_prompt(spark, sf):
    at = _index_and_near(spark, sf)
    p = ret.augmented_prompt(ad.questions(spark, sf), ret.retrieve_context(ad.questions(spark, sf), **at), **at)
    return p.select("query_id", "prompt", "sources")


@register("system_text")
def q_system_text(spark, sf):
    return ret.system_text(written(ad.index(spark, sf).select("label").distinct(), "labels"))


@register("question_templates")
def q_question_templates(spark, sf):
    r = ad.requests(spark, ad.index(spark, sf))
    return r.select("request_id", ret.question_from_template(r).alias("question"))


def _completions(spark, sf):
    """Answers of a model: the assistant turns, numbered in (conv_id, turn) order."""
    turns = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    numbered = global_row_number(turns, [F.col("conv_id").asc(), F.col("turn").asc()], "request_id")
    return numbered.select("request_id", F.col("text").alias("answer"))


def _structured(spark, sf):
    # requests and index are written once: both feed several branches of the plan
    index = _index(spark, sf)
    return ret.structured_requests(written(ad.requests(spark, index), "requests"), index, completions=_completions(spark, sf))


@register("structured_requests")
def q_structured_requests(spark, sf):
    s = _structured(spark, sf)
    return s.select(
        "request_id", "perturbation", "question_type", "question", "prompt", "sources", "matched_label",
        F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
        F.element_at("messages", -1)["content"].alias("user_content"), "answer",
    )


@register("structured_metadata")
def q_structured_metadata(spark, sf):
    index = _index(spark, sf)
    requests = ad.requests(spark, index).select("request_id", F.col("perturbation").alias("name"))
    s = ret.lookup_by_name(requests, index.select("label", "metadata", "vec_id"))
    m = F.col("metadata")
    return s.select(
        "request_id", F.col("label").alias("matched_label"), m["lang"].alias("lang"), m["source"].alias("source"), m["n_chars"].alias("n_chars")
    )


@register("effects_structured")
def q_effects_structured(spark, sf):
    # the whole chain: effects -> documents and profiles -> index -> retrieval -> prompt, with the documents' metadata
    e = eff.clean_effects(ad.effects_sparse(spark, sf))
    documents = written(summ.documents(e, tiebreak=ad.SPARSE_TIEBREAK), "effect-documents")
    significant = eff.clean_effects(ad.effects_sparse(spark, sf, below=DEFAULT_THRESHOLD))
    unit = written(prof.profile_unit(prof.profile_long(significant)), "effect-profiles")
    requests = written(ad.effect_requests(documents), "effect-requests")
    s = eidx.answer_requests(requests, documents, unit)
    m = F.col("metadata")
    return s.select(
        "request_id", "perturbation", "question_type", "question", "prompt", "sources", "matched_label",
        *[m[c].alias(c) for c in ("n_significant", "n_upregulated", "n_downregulated", "n_up_shown", "n_down_shown")],
        *[F.array_join(m[c], "|").alias(c) for c in ("top_up_genes", "top_down_genes")],
        *[m[c].alias(c) for c in ("max_log2fc", "min_log2fc", "strongest_gene", "strongest_log2fc")],
    )


# ---------------------------------------------------------------- dialogue


@register("chat_segments")
def q_chat_segments(spark, sf):
    return dlg.chat_segments(ad.messages(spark, sf)).select("conv_id", "turn", "segment_id")


@register("chat_history")
def q_chat_history(spark, sf):
    h = dlg.chat_history(ad.messages(spark, sf))
    return h.select(
        "conv_id", "turn",
        F.size("history").cast("long").alias("n_history"),
        F.array_join(F.transform("history", lambda x: x["role"]), ",").alias("history_roles"),
        F.array_join(F.transform("history", lambda x: x["content"]), "\n").alias("history_text"),
    )


@register("turn_pairs")
def q_turn_pairs(spark, sf):
    return dlg.turn_pairs(ad.messages(spark, sf))


@register("role_split")
def q_role_split(spark, sf):
    return dlg.role_split(ad.messages(spark, sf))


@register("message_list")
def q_message_list(spark, sf):
    msgs = ad.messages(spark, sf)
    users = msgs.filter(F.col("role") == "user").select(
        F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("question")
    )
    at = _index_and_near(spark, sf)
    prompts = ret.augmented_prompt(users, ret.retrieve_context(users, **at), **at).select(
        F.col("query_id.conv_id").alias("conv_id"), F.col("query_id.turn").alias("turn"), "prompt"
    )
    ml = dlg.message_list(dlg.chat_history(msgs), prompts)
    return ml.select(
        "conv_id", "turn",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
        F.array_join(F.transform("messages", lambda x: x["content"]), "\n").alias("contents"),
    )


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    return dlg.best_checkpoint(ad.metrics(spark, sf)).select("run_id", "epoch", "val_loss", "is_best")


@register("best_epoch")
def q_best_epoch(spark, sf):
    return dlg.best_epoch(ad.metrics(spark, sf))


# ---------------------------------------------------------------- embedding (O52-O54): compared by what no rotation changes

SWEPT = (1, 2, 4, emb.DEFAULT_EMBED_DIM)


def _vector_digest(vectors):
    """Width, norm and the dot product with the vector of the first perturbation."""
    first = vectors.orderBy("perturbation").limit(1).select("embedding").scalar()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = vectors.withColumn("_first", first)
    return both.select(
        "perturbation", F.size("embedding").cast("long").alias("n_dims"),
        F.round(F.sqrt(dot("embedding", "embedding")), 6).alias("norm"), F.round(dot("embedding", "_first"), 6).alias("dot_first"),
    )


@register("profile_embedding")
def q_profile_embedding(spark, sf):
    return _vector_digest(written(emb.profile_embedding(_written_unit(spark, sf)), "embedding"))


@register("embedding_export")
def q_embedding_export(spark, sf):
    return _vector_digest(written(emb.export_embeddings(_written_unit(spark, sf)), "export"))


@register("reconstruction_mse")
def q_reconstruction_mse(spark, sf):
    mse = emb.reconstruction_mse(_written_unit(spark, sf), dims=SWEPT[:3])
    return mse.select("split", "k", F.round("mse", 9).alias("mse"))


@register("embedding_sweep")
def q_embedding_sweep(spark, sf):
    s = emb.reconstruction_sweep(_written_unit(spark, sf), dims=SWEPT)
    return s.select("k", F.round("train_mse", 9).alias("train_mse"), F.round("val_mse", 9).alias("val_mse"), "is_best")


# ---------------------------------------------------------------- extensions (X1-X3) and streams


@register("guide_to_gene")
def q_guide_to_gene(spark, sf):
    g = summ.guide_to_gene(_effects(spark, sf))
    return g.select(
        "perturbation", "effect_gene", F.round("log2fc", 6).alias("log2fc"), "padj",
        F.round("score", 6).alias("score"), "n_guides",
    )


@register("summary_by_variant")
def q_summary_by_variant(spark, sf):
    return summ.perturbation_summary(_effects(spark, sf), group_cols=("perturbation", "cell_type"), tiebreak=T)


@register("multi_dataset_summary")
def q_multi_dataset_summary(spark, sf):
    both = summ.union_datasets(
        {"suppliers": _effects(spark, sf), "orders": eff.clean_effects(ad.effects_sparse(spark, sf))}
    )
    return summ.perturbation_summary(both, group_cols=("dataset", "perturbation"), tiebreak=ad.SPARSE_TIEBREAK)


@register("incremental_refresh")
def q_incremental_refresh(spark, sf):
    from pertlake.streaming import refresh

    base = scratch_path(spark, "refresh")
    src = f"{base}/source"
    # rows arrive by ship date in three waves that together hold every row
    e = written(eff.clean_effects(ad.effects(spark, sf, extra=("l_shipdate",))), "refresh-rows")
    year = F.year("l_shipdate")
    waves = [year < 1995, (year >= 1995) & (year < 1997), (year >= 1997) | year.isNull()]
    for wave in waves:
        e.filter(wave).write.mode("append").parquet(src)
    docs = refresh.incremental_refresh(
        spark, src, e.schema, f"{base}/effects", f"{base}/documents", f"{base}/_checkpoint", tiebreak=T
    )
    return docs.select("perturbation", "text")


@register("stream_history")
def q_stream_history(spark, sf):
    from pertlake.streaming import history

    m = ad.messages(spark, sf)
    base = scratch_path(spark, "history")
    src = f"{base}/source"
    waves = [F.col("turn") < 2, (F.col("turn") >= 2) & (F.col("turn") < 4), F.col("turn") >= 4]
    for cond in waves:  # later turns arrive in later waves
        m.filter(cond).write.mode("append").parquet(src)
    out = history.stream_history(spark, src, m.schema, f"{base}/out", f"{base}/_checkpoint")
    return out.select("conv_id", "turn", "n_history", "history_roles", "history_text")
