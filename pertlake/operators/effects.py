"""Effect-table cleaning, significance and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertlake.functions.columns import (
    DEFAULT_THRESHOLD,
    coerce_double,
    direction,
    null_if_missing,
)

KEY_COLUMNS = ("perturbation", "effect_gene")
TEXT_COLUMNS = ("perturbation", "effect_gene", "score_name", "cell_type")
# Column -> default used when the value is missing or unparsable.
NUMERIC_DEFAULTS = {"log2fc": 0.0, "padj": 1.0, "score": 0.0}


def clean_missing(df: DataFrame, drop_null_keys: tuple[str, ...] = ("perturbation",)) -> DataFrame:
    """Missing-value tokens -> NULL in text columns; drop rows whose keys are NULL."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = df
    for name in TEXT_COLUMNS:
        if name in types and isinstance(types[name], T.StringType):
            out = out.withColumn(name, null_if_missing(F.col(name)))
    if drop_null_keys:
        out = out.dropna(subset=list(drop_null_keys))
    return out


def coerce_numeric(df: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Numeric columns -> DOUBLE with per-column defaults for NULL/NaN/unparsable."""
    defaults = NUMERIC_DEFAULTS if defaults is None else defaults
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = df
    for name, default in defaults.items():
        if name in types:
            out = out.withColumn(name, coerce_double(F.col(name), default, types[name]))
    return out


def clean_effects(df: DataFrame, drop_null_keys: tuple[str, ...] = ("perturbation",)) -> DataFrame:
    """O02 + O03 in one projection (no shuffle)."""
    return coerce_numeric(clean_missing(df, drop_null_keys))


def significant_effects(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Strict ``padj < threshold``.

    Written on the raw column: NULL and NaN never pass (NaN sorts above every
    number), which equals filling them with 1.0 for any threshold <= 1, and keeps
    the predicate pushable into a typed Parquet scan.
    """
    if threshold > 1.0:
        return df.filter(F.coalesce(F.nanvl(F.col("padj"), F.lit(1.0)), F.lit(1.0)) < F.lit(float(threshold)))
    return df.filter(F.col("padj") < F.lit(float(threshold)))


def direction_split(df: DataFrame) -> DataFrame:
    """Tag rows 'up' / 'down'; zero effects are in neither list."""
    return df.withColumn("direction", direction(F.col("log2fc"))).filter(F.col("direction").isNotNull())
