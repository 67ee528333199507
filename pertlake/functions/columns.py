"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the source behaviour for right results)
# ---------------------------------------------------------------------------
# Tokens that the pandas CSV reader turns into "missing" by default (pandas docs,
# `na_values`): we map the same tokens to NULL in every string column.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# A string is numeric only if it looks like a decimal/scientific number or an
# infinity; this keeps Spark from accepting forms pandas rejects (e.g. '5d').
NUMERIC_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
# Candidate entity names: an upper-case letter then 1-9 upper-case letters/digits,
# as a whole word. Words are maximal runs of Unicode letters, digits and '_'.
ENTITY_PATTERN = r"^[A-Z][A-Z0-9]{1,9}$"
WORD_SEPARATOR = r"[^\p{L}\p{N}_]+"
# Significance threshold (strict <) and list sizes used by the documents.
DEFAULT_THRESHOLD = 0.05
DEFAULT_TOP_N = 20
PROSE_NAMES = 5
METADATA_NAMES = 10
# Zero-norm guard used by vector normalisation.
NORM_EPS = 1e-8


def null_if_missing(c: Column) -> Column:
    """Map the missing-value tokens to NULL."""
    return F.when(c.isin(*MISSING_TOKENS), F.lit(None)).otherwise(c)


def coerce_double(c: Column, default: float | None, data_type: T.DataType | None = None) -> Column:
    """Safe numeric coercion: unparsable/NaN/NULL -> ``default``.

    String input is guarded by ``NUMERIC_PATTERN`` before ``try_cast`` (ANSI mode
    would raise on a plain cast). Numeric input only has NaN and NULL replaced.
    """
    if data_type is None or isinstance(data_type, T.StringType):
        parsed = F.when(c.rlike(NUMERIC_PATTERN), c.try_cast("double"))
    else:
        parsed = c.cast("double")
    cleaned = F.nanvl(parsed, F.lit(None).cast("double"))
    if default is None:
        return cleaned
    return F.coalesce(cleaned, F.lit(float(default)))


def direction(log2fc: Column) -> Column:
    """O11: 'up' / 'down' / NULL (zero effects are neither)."""
    return F.when(log2fc > 0, F.lit("up")).when(log2fc < 0, F.lit("down"))


def effect_order(tiebreak: tuple[str, ...] = ()) -> list[Column]:
    """Total order used by every ranking: strongest |score| first, then the gene
    name, then the caller's row-key columns."""
    return [F.abs(F.col("score")).desc(), F.col("effect_gene").asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in tiebreak
    ]


def effect_order_struct(tiebreak: tuple[str, ...] = ()) -> Column:
    """The same order as a struct whose *minimum* is the strongest row (for min_by / min)."""
    parts = [(-F.abs(F.col("score"))).alias("k0"), F.col("effect_gene").alias("k1")]
    parts += [F.col(c).alias(f"k{i + 2}") for i, c in enumerate(tiebreak)]
    return F.struct(*parts)


def thousands(n: Column) -> Column:
    """Integer with a thousands separator (1234567 -> '1,234,567')."""
    return F.format_string("%,d", n.cast("long"))


def gene_line(gene: Column, log2fc: Column, padj: Column, score: Column) -> Column:
    """One formatted effect line."""
    return F.format_string("%s: log2FC %.2f, padj %.2e, score %.2f", gene, log2fc, padj, score)


def array_l2_norm(arr: Column) -> Column:
    """L2 norm of an array<float|double> column."""
    return F.sqrt(F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def array_scale(arr: Column, divisor: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double") / divisor)


def array_unit(arr: Column, guard: str = "identity") -> Column:
    """Unit-length array.

    ``guard='clamp'`` divides by max(norm, 1e-8) (profile rule); ``guard='identity'``
    divides by 1 when norm < 1e-8 (index rule).
    """
    norm = array_l2_norm(arr)
    if guard == "clamp":
        div = F.greatest(norm, F.lit(NORM_EPS))
    elif guard == "identity":
        div = F.when(norm < NORM_EPS, F.lit(1.0)).otherwise(norm)
    else:
        raise ValueError(f"unknown guard {guard!r}")
    return array_scale(arr, div)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def entity_words(text: Column) -> Column:
    """Split text into words (maximal runs of Unicode letters, digits, '_')."""
    return F.split(text, WORD_SEPARATOR)


def is_entity(word: Column) -> Column:
    return word.rlike(ENTITY_PATTERN)
