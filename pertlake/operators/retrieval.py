"""Entity extraction, name lookup, retrieval and prompt tables.

Single-question code paths of the source become table operators: a table of
questions goes through mention extraction, a join with the catalogue, a
similarity fallback for questions without a known name, and prompt assembly. No
per-question driver work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertlake.functions.columns import entity_words, is_entity
from pertlake.functions.ranking import global_row_number
from pertlake.operators.index import centroid_vector, knn_single
from pertlake.session import written

DEFAULT_K = 3

# The five request types of the API. The wording asks for what an index
# document holds (ranked genes, counts, extremes).
QUESTION_TEMPLATES = {
    "comparison": "Set {p} beside the other labels of the index: which genes respond in both, and in the same direction?",
    "downregulated": "List the genes with negative log2FC for {p}, lowest first, each with its padj.",
    "mechanism": "Which shared process do the responding genes of {p} suggest, and which rows support it?",
    "top_effects": "List the rows of {p} with the largest absolute score.",
    "upregulated": "List the genes with positive log2FC for {p}, highest first, each with its padj.",
}
DEFAULT_TEMPLATE = "Summarise the index document of {p}."
NO_SOURCES = "(none)"
LABELS_PER_PART = 1000


def entity_mentions(questions: DataFrame, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """Candidate entity names per question, in text order, duplicates kept.

    Words are maximal runs of Unicode letters/digits/'_' (the same boundaries as a
    Unicode-aware ``\\b``); a word is a candidate when it fully matches
    ``[A-Z][A-Z0-9]{1,9}``. ``pos`` is the word index in the text.
    """
    words = questions.select(F.col(id_col).alias("query_id"), F.posexplode(entity_words(F.col(text_col))).alias("pos", "mention"))
    return words.filter(is_entity(F.col("mention"))).select(
        "query_id", F.col("pos").cast("long").alias("pos"), "mention"
    )


def catalog_by_name(catalog: DataFrame, label: str = "label", order: str = "vec_id") -> DataFrame:
    """One catalogue row per upper-cased name: the first in catalogue order wins."""
    w = Window.partitionBy("name_key").orderBy(F.col(order).asc())
    keyed = catalog.withColumn("name_key", F.upper(label))
    first = keyed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return first.select("name_key", *catalog.columns)


def known_entities(mentions: DataFrame, catalog: DataFrame, label: str = "label") -> DataFrame:
    """Mentions whose name is in the catalogue (left-semi join on the upper-cased name)."""
    keys = catalog.select(F.upper(label).alias("mention")).distinct()
    return mentions.join(keys, "mention", "left_semi")


def lookup_by_name(names: DataFrame, catalog: DataFrame, name_col: str = "name", label: str = "label") -> DataFrame:
    """Case-insensitive exact lookup; first catalogue match wins; no match -> NULLs."""
    cat = catalog_by_name(catalog, label)
    return names.join(cat, F.upper(names[name_col]) == cat["name_key"], "left").drop("name_key")


def fallback_hits(index: DataFrame, k: int = DEFAULT_K, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """The k index entries nearest to the centroid of all raw index vectors.

    One query (the centroid); the result has at most k rows.
    """
    centroid = centroid_vector(index, vec).select("centroid").scalar()
    hits = knn_single(centroid, index, k, index_id=id_col, index_vec=vec)
    labels = index.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"))
    return hits.join(labels, "id").select("rank", F.col("id").alias("vec_id"), "label", "score")


def retrieve_context(
    questions: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_K,
    id_col: str = "query_id",
    text_col: str = "question",
    with_text: bool = False,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """Retrieval slots per question.

    Name hits first, one slot per known mention in text order (a repeated mention
    takes two slots). Questions without a name hit get the k nearest neighbours of
    the index centroid. Columns: query_id, rank, label, vec_id, score (NULL for
    name hits), source_kind ('name' | 'similarity'). ``index`` needs label, vec_id
    and embedding; without embeddings pass ``fallback`` (rank, label, vec_id, score;
    at most k rows). It is read several times, so pass a written table.

    The questions are read once: a question's candidate names are exploded (one empty row
    where there is none), joined with the catalogue and collected per question.

    ``with_text`` adds the document text of the first k slots (``index.text``): name
    hits join it on ``vec_id``; the k fallback texts ride along in the scalar, so the
    many questions without a name hit do not meet on k hot keys.
    """
    names = F.filter(entity_words(F.col(text_col)), is_entity)
    asked = questions.select(F.col(id_col).alias("query_id"), F.posexplode_outer(names).alias("pos", "mention"))
    cat = catalog_by_name(index.select("label", F.col("vec_id").cast("long").alias("vec_id"))).withColumnRenamed("name_key", "mention")
    found = asked.join(cat, "mention", "left")
    slots = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("pos", "label", "vec_id"))))
    per_question = found.groupBy("query_id").agg(slots.alias("slots"))

    fb = fallback_hits(index, k) if fallback is None else fallback.filter(F.col("rank") <= k)
    extra = []
    if with_text:
        texts = index.select(F.col("vec_id").cast("long").alias("vec_id"), "text")
        fb = fb.join(texts, "vec_id")
        extra = [F.lit(None).cast("string").alias("text")]
    # The fallback has at most k rows: it rides along as one scalar array.
    fields = F.struct(
        F.col("rank").cast("long").alias("rank"), "label", F.col("vec_id").cast("long").alias("vec_id"), F.col("score").cast("double").alias("score"),
        F.lit("similarity").alias("source_kind"), *(["text"] if with_text else []),
    )
    near = fb.agg(F.array_sort(F.collect_list(fields)).alias("a")).scalar()
    named = F.transform("slots", lambda x, i: F.struct(
        (i + 1).cast("long").alias("rank"), x["label"].alias("label"), x["vec_id"].alias("vec_id"), F.lit(None).cast("double").alias("score"),
        F.lit("name").alias("source_kind"), *extra,
    ))
    hits = per_question.select("query_id", F.explode(F.when(F.size("slots") > 0, named).otherwise(near)).alias("h")).select("query_id", "h.*")
    if not with_text:
        return hits
    by_name = (F.col("source_kind") == "name") & (F.col("rank") <= k)
    key = F.when(by_name, F.col("vec_id"))
    joined = hits.join(texts.select(F.col("vec_id").alias("_v"), F.col("text").alias("_t")), key == F.col("_v"), "left")
    return joined.withColumn("text", F.coalesce("text", "_t")).drop("_v", "_t")


def _part(label: str = "label", text: str = "text") -> Column:
    return F.concat(F.lit("["), F.col(label), F.lit("]\n"), F.col(text))


def question_slots(hits: DataFrame) -> DataFrame:
    """query_id, _slots (label, vec_id of its name hits in slot order; empty if all its hits are similar ones), written."""
    named = F.when(F.col("source_kind") == "name", F.struct("rank", "label", "vec_id"))
    slots = F.transform(F.array_sort(F.collect_list(named)), lambda x: F.struct(x["label"].alias("label"), x["vec_id"].alias("vec_id")))
    return written(hits.groupBy("query_id").agg(slots.alias("_slots")), "question-slots")


def _shown(text: str, place: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(place, _part("label", text).alias("p")))))


def _joined(parts: str) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n"))


def named_contexts(named: DataFrame, slots: DataFrame, index: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """``named`` (rows with ``_slots``, not empty) with n_shown, context, sources.

    A context is built once per distinct list of first k slots, so a document's text is moved
    once per such list and not once per question that asks for it.
    """
    texts = index.select(F.col("vec_id").cast("long").alias("vec_id"), "text")
    lists = slots.filter(F.size("_slots") > 0).select(F.slice("_slots", 1, k).alias("_list")).distinct()
    placed = lists.select("_list", F.posexplode("_list").alias("_place", "_slot")).select("_list", "_place", "_slot.label", "_slot.vec_id")
    built = placed.join(texts, "vec_id", "left").groupBy("_list").agg(_shown("text", "_place").alias("_ctx"), F.array_sort(F.collect_list("_place")).alias("_places"))
    contexts = built.select("_list", F.size("_ctx").alias("n_shown"), _joined("_ctx").alias("context"), "_places")
    # a slot is listed once per row of the index with its id, as its text is shown
    first = F.transform("_places", lambda i: F.get("_slots", i)["label"])
    rest = F.transform(F.filter("_slots", lambda x, i: i >= k), lambda x: x["label"])
    out = named.withColumn("_list", F.slice("_slots", 1, k)).join(contexts, "_list")
    return out.withColumn("sources", F.array_join(F.concat(first, rest), ", ")).drop("_list", "_places")


def near_context(index: DataFrame, fallback: DataFrame, k: int = DEFAULT_K) -> Column:
    """n_shown, context, sources of every question without a name hit: one scalar struct."""
    texts = index.select(F.col("vec_id").cast("long").alias("vec_id"), "text")
    near = fallback.filter(F.col("rank") <= k).withColumn("vec_id", F.col("vec_id").cast("long")).join(texts, "vec_id")
    one = near.agg(_shown("text", "rank").alias("_ctx"), F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("_src"))
    sources = F.array_join(F.transform("_src", lambda x: x["label"]), ", ")
    return one.select(F.struct(F.size("_ctx").alias("n_shown"), _joined("_ctx").alias("context"), sources.alias("sources"))).scalar()


def context_block(hits: DataFrame, k: int = DEFAULT_K, index: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """The first k retrieved documents per question, each under its label.

    ``hits`` with text; or without, with the written ``index`` and ``fallback`` that they come
    from: no text is then moved per question (see :func:`named_contexts`).
    """
    if index is not None:
        slots = question_slots(hits.filter(F.col("rank") <= k))
        named = named_contexts(slots.filter(F.size("_slots") > 0), slots, index, k).select("query_id", "context")
        rest = slots.filter(F.size("_slots") == 0).select("query_id", near_context(index, fallback, k)["context"].alias("context"))
        return named.unionByName(rest).filter(F.col("context").isNotNull())
    top = hits.filter((F.col("rank") <= k) & F.col("text").isNotNull())
    return top.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", _part().alias("p")))), lambda x: x["p"]), "\n\n").alias("context")
    )


def _context_and_sources(hits: DataFrame, k: int) -> DataFrame:
    """O41 + O42 (all labels in slot order, not cut to k) in one aggregation over the hits."""
    shown = (F.col("rank") <= k) & F.col("text").isNotNull()
    g = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("rank", _part().alias("p"))))).alias("_ctx"),
        F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("_src"),
    )
    return g.select(
        "query_id",
        F.size("_ctx").alias("n_shown"),
        F.when(F.size("_ctx") > 0, F.array_join(F.transform("_ctx", lambda x: x["p"]), "\n\n")).alias("context"),
        F.array_join(F.transform("_src", lambda x: x["label"]), ", ").alias("sources"),
    )


def _questions_in_context(questions: DataFrame, hits: DataFrame, index: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """``questions`` (with query_id, and any other columns) with n_shown, context, sources."""
    slots = question_slots(hits)
    found = slots.filter(F.size("_slots") > 0)
    named = named_contexts(questions.join(found, "query_id"), slots, index, k).drop("_slots")
    # null ids match nothing; without fallback rows there is no context either
    rest = questions.join(found.select("query_id"), "query_id", "left_anti").withColumn("_near", near_context(index, fallback, k))
    known = lambda c: F.when(F.col("query_id").isNotNull(), F.col("_near")[c]).alias(c)
    return named.unionByName(rest.select(*questions.columns, *[known(c) for c in ("n_shown", "context", "sources")]))


def augmented_prompt(questions: DataFrame, hits: DataFrame, k: int = DEFAULT_K,
                     id_col: str = "query_id", text_col: str = "question",
                     index: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """The user message: the question, then the retrieved documents and their labels.

    ``hits`` with text; or without, with the written ``index`` and ``fallback`` that they come
    from."""
    q = questions.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("question"))
    if index is not None:
        j = _questions_in_context(q, hits, index, fallback, k)
    else:
        j = q.join(_context_and_sources(hits, k), "query_id", "left")
    return _with_prompt(j).select("query_id", "question", "prompt", "sources")


def _with_prompt(rows: DataFrame) -> DataFrame:
    """``rows`` (question, n_shown, context, sources, ...) with prompt; without labels, sources say so."""
    sources = F.when(F.coalesce(F.length("sources"), F.lit(0)) > 0, F.col("sources")).otherwise(F.lit(NO_SOURCES))
    prompt = F.concat(
        F.lit("QUESTION\n"), F.col("question"),
        F.lit("\n\nINDEX DOCUMENTS ("), F.coalesce(F.col("n_shown"), F.lit(0)).cast("string"), F.lit(")\n"), F.coalesce(F.col("context"), F.lit("")),
        F.lit("\n\nLABELS\n"), sources,
    )
    return rows.withColumns({"prompt": prompt, "sources": sources})


def system_text(catalog: DataFrame, label: str = "label", per_part: int = LABELS_PER_PART) -> DataFrame:
    """The system message as numbered parts: part 0 states the size of the index, the
    others list its distinct labels in order, ``per_part`` to a part.

    Every label is listed, but no row holds more than ``per_part`` of them, so the message
    is a table that requests refer to instead of one value that grows with the index.
    """
    labels = catalog.select(F.col(label).alias("label")).distinct()
    numbered = global_row_number(labels, [F.col("label").asc_nulls_first()], "_rn")
    listed = numbered.groupBy((F.floor((F.col("_rn") - 1) / per_part) + 1).cast("long").alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("system_text")
    )
    head = labels.agg(F.count(F.lit(1)).cast("string").alias("n")).select(
        F.lit(0).cast("long").alias("part"),
        F.concat(
            F.lit("You answer from an index of "), F.col("n"),
            F.lit(" labelled documents about gene perturbations. Name the label behind each statement; if no document covers the question, say that."),
        ).alias("system_text"),
    )
    return head.unionByName(listed)


def question_from_template(requests: DataFrame, name_col: str = "perturbation", type_col: str = "question_type") -> Column:
    """Question text for a request type; unknown types use the default wording."""
    tmpl = F.create_map(*[x for kv in QUESTION_TEMPLATES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    chosen = F.coalesce(F.element_at(tmpl, F.col(type_col)), F.lit(DEFAULT_TEMPLATE))
    return F.replace(chosen, F.lit("{p}"), F.col(name_col))


def _catalog_texts(index: DataFrame) -> DataFrame:
    """name_key, matched_label, metadata, _copies, _texts: per name its first row, with the texts of all rows of its vec_id."""
    cat = catalog_by_name(index.select("label", "vec_id", "metadata", "text")).withColumnRenamed("label", "matched_label")
    shown = F.when(F.col("vec_id").isNotNull() & F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))
    cat = cat.withColumn("_copies", F.lit(1).cast("long")).withColumn("_texts", shown).drop("text")
    repeated = written(index.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and vec_id is not null"), "repeated-ids")
    if not repeated.isEmpty():
        texts = index.select("vec_id", "text").join(repeated, "vec_id").groupBy("vec_id").agg(
            F.first("_n").alias("_n"), F.array_sort(F.collect_list("text")).alias("_all")
        )
        cat = cat.join(texts, "vec_id", "left").withColumns(
            {"_copies": F.coalesce("_n", "_copies"), "_texts": F.coalesce("_all", "_texts")}
        )
    return cat.select("name_key", "matched_label", "metadata", "_copies", "_texts")


def structured_requests(
    requests: DataFrame, index: DataFrame, k: int = DEFAULT_K, completions: DataFrame | None = None, fallback: DataFrame | None = None,
) -> DataFrame:
    """O48 (+O30, O45): template -> retrieval -> prompt -> message list -> metadata.

    ``index`` needs label, vec_id, embedding (or ``fallback``), text and metadata. The system message is
    referred to (its content is the table of :func:`system_text`), not copied into every
    row. ``completions`` (request_id, answer) is optional; the answer is NULL without it.
    Metadata comes from a case-insensitive lookup of the requested name; no match
    gives an empty metadata struct (all fields NULL). A request_id stands for one request.

    A question that names nothing but its own perturbation is answered by the row of that
    lookup, or by the fallback: one join of the requests with the catalogue gives context and
    metadata, and prompts are built behind it, so a text is moved once and not once per request.
    Questions that hold other names go through :func:`retrieve_context`.
    """
    near = written(fallback_hits(index, k), "fallback") if fallback is None else fallback
    req = requests.withColumn("question", question_from_template(requests))
    names = F.coalesce(F.filter(entity_words(F.col("question")), is_entity), F.array().cast("array<string>"))
    name = F.upper("perturbation")
    others = F.exists(names, lambda m: m != name)
    if completions is None:
        asked = req.withColumn("answer", F.lit(None).cast("string"))
    else:
        asked = req.join(completions.select("request_id", "answer"), "request_id", "left")
    cat = _catalog_texts(index)

    # one slot per mention; the texts of the first k are shown, each with all rows of its vec_id
    plain = asked.filter(~others).withColumn("_n", F.size(names)).drop("question")
    found = plain.join(cat, name == cat["name_key"], "left").withColumn("question", question_from_template(plain))
    found = found.withColumn("_near", near_context(index, near, k)).withColumn("_shown", F.least("_n", F.lit(k)))
    hit = (F.col("_n") > 0) & F.col("matched_label").isNotNull()
    parts = F.transform("_texts", lambda t: F.concat(F.lit("["), F.col("matched_label"), F.lit("]\n"), t))
    n_shown = F.size("_texts") * F.col("_shown")
    listed = (F.col("_copies") * F.col("_shown") + F.col("_n") - F.col("_shown")).cast("int")
    own = {
        "n_shown": n_shown,
        "context": F.when(n_shown > 0, F.array_join(F.flatten(F.array_repeat(parts, F.col("_shown"))), "\n\n")),
        "sources": F.array_join(F.array_repeat("matched_label", listed), ", "),
    }
    out = _with_prompt(found.withColumns({c: F.when(hit, own[c]).otherwise(F.col("_near")[c]) for c in own}))
    fields = [*asked.columns, "prompt", "sources", "matched_label", "metadata"]
    out = out.select(*fields)
    rest = req.filter(others)
    if not rest.isEmpty():
        qs = rest.select(F.col("request_id").alias("query_id"), "question")
        prompts = augmented_prompt(qs, retrieve_context(qs, index, k, fallback=near), k, index=index, fallback=near)
        prompts = prompts.select(F.col("query_id").alias("request_id"), "prompt", "sources")
        more = asked.filter(others).join(prompts, "request_id", "left").join(cat, name == cat["name_key"], "left")
        out = out.unionByName(more.select(*fields))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    return out.withColumn("messages", msgs)
