"""Per-perturbation summaries, rankings and documents.

Shuffle plan: the counts are one hash aggregate on the group key over fixed-width
buffers (partial aggregation before the shuffle, so a hot perturbation costs one
partial row per map task, and no sort). Rankings are windows with
``row_number() <= N`` over the significant rows only, which Spark plans as a
partial ``WindowGroupLimit`` before the shuffle, so at most N rows per group,
direction and map task cross the network; the strongest effect is taken from the
rank-1 rows. Cell types pre-aggregate on (group, cell type). The document joins
per-group tables that are all hash-partitioned on the group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertlake.functions.columns import (
    DEFAULT_THRESHOLD,
    DEFAULT_TOP_N,
    METADATA_NAMES,
    PROSE_NAMES,
    direction,
    effect_order,
    effect_order_struct,
    gene_line,
    thousands,
)
from pertlake.operators.effects import significant_effects

GROUP = ("perturbation",)
# Group keys that cleaning guarantees to be non-NULL.
NON_NULL_KEYS = ("perturbation", "dataset")


def _sig(threshold: float) -> Column:
    return F.col("padj") < F.lit(float(threshold))


def _ranked(
    effects: DataFrame,
    top_n: int,
    threshold: float,
    group_cols: Sequence[str],
    tiebreak: tuple[str, ...],
) -> DataFrame:
    """Significant rows ranked by |score| within (group, direction), first ``top_n`` kept.

    Direction is 'up', 'down' or 'zero' (log2fc = 0, significant but in neither
    list). ``row_number() <= top_n`` is planned with a partial WindowGroupLimit
    before the shuffle; only significant rows are sorted.
    """
    sig = significant_effects(effects, threshold).withColumn(
        "direction", F.coalesce(direction(F.col("log2fc")), F.lit("zero"))
    )
    w = Window.partitionBy(*group_cols, "direction").orderBy(*effect_order(tiebreak))
    ranked = sig.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def _strongest(ranked: DataFrame, group_cols: Sequence[str], tiebreak: tuple[str, ...]) -> DataFrame:
    """O17 from the rank-1 rows of each direction (at most three rows per group)."""
    return (
        ranked.filter(F.col("rank") == 1)
        .groupBy(*group_cols)
        .agg(
            F.min_by(
                F.struct(F.col("effect_gene").alias("gene"), F.col("log2fc").alias("log2fc")),
                effect_order_struct(tiebreak),
            ).alias("_s")
        )
        .select(*group_cols, F.col("_s.gene").alias("strongest_gene"), F.col("_s.log2fc").alias("strongest_log2fc"))
    )


def _counts(effects: DataFrame, threshold: float, top_n: int, group_cols: Sequence[str]) -> DataFrame:
    """Fixed-width conditional aggregates: a hash aggregate with partial aggregation."""
    sig = _sig(threshold)
    agg = effects.groupBy(*group_cols).agg(
        F.count_if(sig).cast("long").alias("n_significant"),
        F.count_if(sig & (F.col("log2fc") > 0)).cast("long").alias("n_upregulated"),
        F.count_if(sig & (F.col("log2fc") < 0)).cast("long").alias("n_downregulated"),
        F.coalesce(F.max(F.when(sig, F.col("log2fc"))), F.lit(0.0)).alias("max_log2fc"),
        F.coalesce(F.min(F.when(sig, F.col("log2fc"))), F.lit(0.0)).alias("min_log2fc"),
    )
    return agg.select(
        *group_cols,
        "n_significant",
        "n_upregulated",
        "n_downregulated",
        F.least(F.col("n_upregulated"), F.lit(top_n).cast("long")).alias("n_up_shown"),
        F.least(F.col("n_downregulated"), F.lit(top_n).cast("long")).alias("n_down_shown"),
        "max_log2fc",
        "min_log2fc",
    )


def _join_keys(left: DataFrame, right: DataFrame, group_cols: Sequence[str], how: str = "left") -> DataFrame:
    """Join on the group keys; NULL keys (e.g. a missing cell type) match each other.

    Keys that are never NULL (``perturbation`` after cleaning, ``dataset``) use plain
    equality, so the join reuses the hash partitioning of the aggregates.
    """
    r = right
    for c in group_cols:
        r = r.withColumnRenamed(c, f"_rk_{c}")
    cond = [
        (F.col(c) == F.col(f"_rk_{c}")) if c in NON_NULL_KEYS else F.col(c).eqNullSafe(F.col(f"_rk_{c}"))
        for c in group_cols
    ]
    return left.join(r, cond, how).drop(*[f"_rk_{c}" for c in group_cols])


def perturbation_summary(
    effects: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    top_n: int = DEFAULT_TOP_N,
    group_cols: Sequence[str] = GROUP,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """O13 + O17: one row per group, **including groups without a significant row**.

    Conditional aggregates (never filter-then-group): n_significant, n_upregulated,
    n_downregulated, the shown counts (capped at ``top_n``), max/min log2fc over
    significant rows (0.0 when none), plus the strongest effect by |score|.
    """
    counts = _counts(effects, threshold, top_n, group_cols)
    best = _strongest(_ranked(effects, 1, threshold, group_cols, tiebreak), group_cols, tiebreak)
    return _join_keys(counts, best, group_cols)


def strongest_effect(
    effects: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    group_cols: Sequence[str] = GROUP,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """The rank-1 significant row per group by |score| (groups with hits only)."""
    sig = significant_effects(effects, threshold)
    w = Window.partitionBy(*group_cols).orderBy(*effect_order(tiebreak))
    best = sig.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return best.select(*group_cols, "effect_gene", "log2fc", "padj", "score")


def top_effects(
    effects: DataFrame,
    top_n: int = DEFAULT_TOP_N,
    threshold: float = DEFAULT_THRESHOLD,
    group_cols: Sequence[str] = GROUP,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Top-N up and top-N down significant effects per group by |score|."""
    return _ranked(effects, top_n, threshold, group_cols, tiebreak).filter(F.col("direction") != "zero")


def gene_lines(top: DataFrame) -> DataFrame:
    """Formatted line per ranked effect."""
    return top.withColumn("line", gene_line(F.col("effect_gene"), F.col("log2fc"), F.col("padj"), F.col("score")))


def top_gene_lists(top: DataFrame, group_cols: Sequence[str] = GROUP) -> DataFrame:
    """Ordered per-group lists of the ranked effects (at most 2 x top_n entries per group)."""
    entry = F.struct("rank", "effect_gene", "log2fc", "padj", "score")
    lists = top.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.when(F.col("direction") == "up", entry))).alias("up"),
        F.array_sort(F.collect_list(F.when(F.col("direction") == "down", entry))).alias("down"),
    )
    return lists.select(
        *group_cols,
        "up",
        "down",
        F.slice(F.transform("up", lambda x: x["effect_gene"]), 1, METADATA_NAMES).alias("top_up_genes"),
        F.slice(F.transform("down", lambda x: x["effect_gene"]), 1, METADATA_NAMES).alias("top_down_genes"),
    )


def cell_type_phrase(
    effects: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    group_cols: Sequence[str] = GROUP,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct non-null cell types of the significant rows, in order of first
    appearance in the |score| order, joined with ', '."""
    sig = significant_effects(effects, threshold).filter(F.col("cell_type").isNotNull())
    first = sig.groupBy(*group_cols, "cell_type").agg(F.min(effect_order_struct(tiebreak)).alias("_first"))
    return first.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct("_first", "cell_type"))).alias("_c")
    ).select(
        *group_cols,
        F.transform("_c", lambda x: x["cell_type"]).alias("cell_types"),
        F.array_join(F.transform("_c", lambda x: x["cell_type"]), ", ").alias("cell_type_phrase"),
    )


def _lines_block(arr: str) -> Column:
    lines = F.transform(
        F.col(arr),
        lambda x: F.concat(F.lit("  "), gene_line(x["effect_gene"], x["log2fc"], x["padj"], x["score"])),
    )
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit("  (none)"))


def _names(arr: str, n: int) -> Column:
    return F.array_join(F.slice(F.transform(F.col(arr), lambda x: x["effect_gene"]), 1, n), ", ")


def documents(
    effects: DataFrame,
    top_n: int = DEFAULT_TOP_N,
    threshold: float = DEFAULT_THRESHOLD,
    group_cols: Sequence[str] = GROUP,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """O38 + O39: one document per group: ``text`` and a nested ``metadata`` struct.

    Every group gets a document, also one with no significant row (its lists read
    "(none)" and its strongest effect is "none").
    """
    return documents_from_state(document_state(effects, top_n, threshold, group_cols, tiebreak), top_n, threshold, group_cols)


def render_documents(d: DataFrame, threshold: float = DEFAULT_THRESHOLD, group_cols: Sequence[str] = GROUP) -> DataFrame:
    """Text and metadata of O38/O39 from the per-group inputs.

    ``d`` holds the counts (n_significant, n_upregulated, n_downregulated,
    n_up_shown, n_down_shown, max_log2fc, min_log2fc), the strongest effect
    (strongest_gene, strongest_log2fc), the ranked lists ``up``/``down`` (arrays
    of structs with effect_gene, log2fc, padj, score, strongest first), the name
    lists top_up_genes/top_down_genes and cell_types/cell_type_phrase.
    """
    label = F.concat_ws(" / ", *[F.col(c).cast("string") for c in group_cols])
    has_up = F.coalesce(F.size("up"), F.lit(0)) > 0
    has_down = F.coalesce(F.size("down"), F.lit(0)) > 0
    cells_txt = F.when(
        F.coalesce(F.length("cell_type_phrase"), F.lit(0)) > 0,
        F.concat(F.lit(" (cell types: "), F.col("cell_type_phrase"), F.lit(")")),
    ).otherwise(F.lit(""))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Knockout of "), label, cells_txt),
        F.concat(
            F.lit(f"Significant genes (padj < {threshold}): "), thousands(F.col("n_significant")),
            F.lit("; up-regulated: "), thousands(F.col("n_upregulated")),
            F.lit(" ("), F.col("n_up_shown").cast("string"), F.lit(" listed)"),
            F.lit("; down-regulated: "), thousands(F.col("n_downregulated")),
            F.lit(" ("), F.col("n_down_shown").cast("string"), F.lit(" listed)"),
        ),
        F.lit("Up-regulated, strongest |score| first:"),
        _lines_block("up"),
        F.lit("Down-regulated, strongest |score| first:"),
        _lines_block("down"),
        F.concat(
            F.lit("Reading: the knockout "),
            F.when(has_up, F.concat(F.lit("raises "), _names("up", PROSE_NAMES))).otherwise(
                F.lit("raises no gene significantly")
            ),
            F.lit(" and "),
            F.when(has_down, F.concat(F.lit("lowers "), _names("down", PROSE_NAMES))).otherwise(
                F.lit("lowers no gene significantly")
            ),
            F.lit("."),
        ),
        F.when(
            F.col("strongest_gene").isNotNull() | (F.col("n_significant") > 0),
            F.concat(
                F.lit("Largest effect: "), F.coalesce(F.col("strongest_gene"), F.lit("(unnamed)")),
                F.lit(" (log2FC "), F.format_string("%.2f", F.col("strongest_log2fc")), F.lit(")."),
            ),
        ).otherwise(F.lit("Largest effect: none.")),
    )
    empty = F.array().cast("array<string>")
    metadata = F.struct(
        F.col("n_significant"),
        F.col("n_upregulated"),
        F.col("n_downregulated"),
        F.col("n_up_shown"),
        F.col("n_down_shown"),
        F.coalesce(F.col("top_up_genes"), empty).alias("top_up_genes"),
        F.coalesce(F.col("top_down_genes"), empty).alias("top_down_genes"),
        F.col("max_log2fc"),
        F.col("min_log2fc"),
        F.col("strongest_gene"),
        F.col("strongest_log2fc"),
        F.coalesce(F.col("cell_types"), empty).alias("cell_types"),
    )
    return d.select(*group_cols, text.alias("text"), metadata.alias("metadata"))


# ---------------------------------------------------------------------------
# Mergeable document state (used by the refresh stream, S1)
#
# Every input of a document is a mergeable aggregate: counts add up, max/min
# combine, the top-N of a union is the top-N of the parts' top-N lists (the order
# is total), and a cell type's first appearance is the minimum of the parts'. So a
# document can be refreshed from its old state and the state of the new rows
# alone, without re-reading the rows it was built from. The state has one row per
# group of bounded width (at most 2 x top_n + 1 effects plus the distinct cell types).
# ---------------------------------------------------------------------------

_ENTRY_FIELDS = ("effect_gene", "log2fc", "padj", "score")


def _entry(tiebreak: tuple[str, ...]) -> Column:
    return F.struct(effect_order_struct(tiebreak).alias("o"), *[F.col(c) for c in _ENTRY_FIELDS])


def document_state(
    effects: DataFrame,
    top_n: int = DEFAULT_TOP_N,
    threshold: float = DEFAULT_THRESHOLD,
    group_cols: Sequence[str] = GROUP,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Mergeable per-group state of the documents of ``effects``.

    Columns: group keys, n_significant, n_upregulated, n_downregulated (BIGINT),
    max_sig/min_sig (NULL without significant rows), ``up``/``down``/``zero``
    (arrays of struct(o, effect_gene, log2fc, padj, score), ascending ``o`` =
strongest first, at most top_n / top_n / 1 entries) and ``cells`` (array of
    struct(o, cell_type): first appearance of each cell type). Two scans of ``effects``:
    a hash aggregate over all rows, and one partial-limited window over the significant ones.
    """
    if "cell_type" not in effects.columns:
        effects = effects.withColumn("cell_type", F.lit(None).cast("string"))
    sig = _sig(threshold)
    counts = effects.groupBy(*group_cols).agg(
        F.count_if(sig).cast("long").alias("n_significant"),
        F.count_if(sig & (F.col("log2fc") > 0)).cast("long").alias("n_upregulated"),
        F.count_if(sig & (F.col("log2fc") < 0)).cast("long").alias("n_downregulated"),
        F.max(F.when(sig, F.col("log2fc"))).alias("max_sig"),
        F.min(F.when(sig, F.col("log2fc"))).alias("min_sig"),
    )
    # the rows that any part of the state needs: the first top_n per group, direction and cell
    # type hold the first top_n per direction and the first row of every cell type
    ranked = _ranked(effects, top_n, threshold, [*group_cols, "cell_type"], tiebreak)
    entry = _entry(tiebreak)
    named = F.when((F.col("rank") == 1) & F.col("cell_type").isNotNull(), F.struct(entry["o"].alias("o"), "cell_type"))
    lists = ranked.groupBy(*group_cols).agg(
        *[
            F.slice(F.sort_array(F.collect_list(F.when(F.col("direction") == d, entry))), 1, n).alias(d)
            for d, n in (("up", top_n), ("down", top_n), ("zero", 1))
        ],
        F.sort_array(F.collect_list(named)).alias("cells"),
    )
    st = _join_keys(counts, lists.withColumn("cells", _first_per_cell(F.col("cells"))), group_cols)
    empty = F.array()
    return st.select(
        *group_cols, "n_significant", "n_upregulated", "n_downregulated", "max_sig", "min_sig",
        *[F.coalesce(F.col(c), empty.cast(st.schema[c].dataType)).alias(c) for c in ("up", "down", "zero", "cells")],
    )


def _first_per_cell(arr: Column) -> Column:
    """Keep the first entry of each cell type in an array sorted by ``o``."""
    return F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, 1, i), lambda y: y["cell_type"] == x["cell_type"]))


def merge_document_state(states: DataFrame, top_n: int = DEFAULT_TOP_N, group_cols: Sequence[str] = GROUP) -> DataFrame:
    """Combine several state rows per group into one (exact: the merge of top-N lists
    under a total order is the top-N of the union). A group has one row per part
    (old state, new rows), so the groups are small whatever the data size."""
    g = states.groupBy(*group_cols).agg(
        F.sum("n_significant").cast("long").alias("n_significant"),
        F.sum("n_upregulated").cast("long").alias("n_upregulated"),
        F.sum("n_downregulated").cast("long").alias("n_downregulated"),
        F.max("max_sig").alias("max_sig"),
        F.min("min_sig").alias("min_sig"),
        *[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("up", "down", "zero", "cells")],
    )
    return g.select(
        *group_cols, "n_significant", "n_upregulated", "n_downregulated", "max_sig", "min_sig",
        F.slice("up", 1, top_n).alias("up"),
        F.slice("down", 1, top_n).alias("down"),
        F.slice("zero", 1, 1).alias("zero"),
        _first_per_cell(F.col("cells")).alias("cells"),
    )


def documents_from_state(
    state: DataFrame,
    top_n: int = DEFAULT_TOP_N,
    threshold: float = DEFAULT_THRESHOLD,
    group_cols: Sequence[str] = GROUP,
) -> DataFrame:
    """O38/O39 documents rendered from the mergeable state (same text and metadata
    as :func:`documents` over the rows the state summarises)."""
    heads = F.filter(
        F.array(*[F.get(F.col(c), 0) for c in ("up", "down", "zero")]), lambda x: x.isNotNull()
    )
    strongest = F.array_min(heads)
    has_cells = F.size("cells") > 0
    cell_names = F.transform("cells", lambda x: x["cell_type"])
    d = state.select(
        *group_cols,
        "n_significant",
        "n_upregulated",
        "n_downregulated",
        F.least(F.col("n_upregulated"), F.lit(top_n).cast("long")).alias("n_up_shown"),
        F.least(F.col("n_downregulated"), F.lit(top_n).cast("long")).alias("n_down_shown"),
        F.coalesce(F.col("max_sig"), F.lit(0.0)).alias("max_log2fc"),
        F.coalesce(F.col("min_sig"), F.lit(0.0)).alias("min_log2fc"),
        strongest["effect_gene"].alias("strongest_gene"),
        strongest["log2fc"].alias("strongest_log2fc"),
        "up",
        "down",
        F.slice(F.transform("up", lambda x: x["effect_gene"]), 1, METADATA_NAMES).alias("top_up_genes"),
        F.slice(F.transform("down", lambda x: x["effect_gene"]), 1, METADATA_NAMES).alias("top_down_genes"),
        F.when(has_cells, cell_names).alias("cell_types"),
        F.when(has_cells, F.array_join(cell_names, ", ")).alias("cell_type_phrase"),
    )
    return render_documents(d, threshold, group_cols)


def flatten_metadata(docs: DataFrame, group_cols: Sequence[str] = GROUP, sep: str = "|") -> DataFrame:
    """Flat view of O39's metadata (lists joined with ``sep``) for comparison/export."""
    m = "metadata."
    return docs.select(
        *group_cols,
        F.col(m + "n_significant").alias("n_significant"),
        F.col(m + "n_upregulated").alias("n_upregulated"),
        F.col(m + "n_downregulated").alias("n_downregulated"),
        F.col(m + "n_up_shown").alias("n_up_shown"),
        F.col(m + "n_down_shown").alias("n_down_shown"),
        F.array_join(F.col(m + "top_up_genes"), sep).alias("top_up_genes"),
        F.array_join(F.col(m + "top_down_genes"), sep).alias("top_down_genes"),
        F.col(m + "max_log2fc").alias("max_log2fc"),
        F.col(m + "min_log2fc").alias("min_log2fc"),
        F.col(m + "strongest_gene").alias("strongest_gene"),
        F.col(m + "strongest_log2fc").alias("strongest_log2fc"),
        F.array_join(F.col(m + "cell_types"), sep).alias("cell_types"),
    )


def guide_to_gene(guides: DataFrame, group_cols: Sequence[str] = GROUP) -> DataFrame:
    """Aggregate guide-level fold changes to a gene-level pseudo effect.

    Input rows (group..., effect_gene, log2fc, padj, score) at guide level; output
    one row per (group, effect_gene) with the mean fold change, the best (minimum)
    adjusted p-value, the mean score and the guide count; feeds O10 onward.
    """
    return guides.groupBy(*group_cols, "effect_gene").agg(
        F.avg("log2fc").alias("log2fc"),
        F.min("padj").alias("padj"),
        F.avg("score").alias("score"),
        F.count(F.lit(1)).cast("long").alias("n_guides"),
    )


def union_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack effect tables with the same columns, tagging each with ``dataset``."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables given")
    return out
