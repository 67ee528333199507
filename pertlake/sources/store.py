"""Sources and sinks: effects CSV, embedding maps, the index and catalogue tables,
documents JSON (O01, O04-O09).

Parquet is the canonical storage. Embedding maps are written and read as JSON *lines* whose
objects map labels to vectors (any number of entries per line); the source's own form, one
object or one array a file, is read by byte ranges (:mod:`pertlake.sources.json_entries`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertlake.functions.ranking import global_row_number
from pertlake.operators.index import embedding_unit
from pertlake.sources.json_entries import SPLIT_BYTES, read_entries

# Column names of the source CSV and the snake_case names we use.
CSV_COLUMNS = {
    "Perturbation Gene": "perturbation",
    "Effect Gene": "effect_gene",
    "Log2FC": "log2fc",
    "Padj": "padj",
    "Score Name": "score_name",
    "Score Value": "score",
    "Cell Type": "cell_type",
}

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("perturbation", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("n_significant", T.LongType()),
                    T.StructField("n_upregulated", T.LongType()),
                    T.StructField("n_downregulated", T.LongType()),
                    T.StructField("n_up_shown", T.LongType()),
                    T.StructField("n_down_shown", T.LongType()),
                    T.StructField("top_up_genes", T.ArrayType(T.StringType())),
                    T.StructField("top_down_genes", T.ArrayType(T.StringType())),
                    T.StructField("max_log2fc", T.DoubleType()),
                    T.StructField("min_log2fc", T.DoubleType()),
                    T.StructField("strongest_gene", T.StringType()),
                    T.StructField("strongest_log2fc", T.DoubleType()),
                    T.StructField("cell_types", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)


def read_effects_csv(spark: SparkSession, path: str) -> DataFrame:
    """Effects CSV with header, every column read as text (no inference).

    Header names of the source are renamed to snake_case; unknown columns are kept.
    Cleaning and coercion follow in ``operators.effects.clean_effects``.
    """
    # files may differ in header order or columns: files with the same header are read
    # together, and the groups are united by column name
    groups: dict[str, list[str]] = {}
    for row in _csv_headers(spark, path):
        groups.setdefault(row["header"], []).append(row["file"])
    parts = []
    for files in groups.values():
        names = spark.read.option("header", True).option("inferSchema", False).csv(files[0]).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        # keep empty strings as "" so the missing-token mapping (O02) decides
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("nullValue", None)
            .option("emptyValue", "")
            .option("mode", "PERMISSIVE")
            .csv(files)
        )
        for src, dst in CSV_COLUMNS.items():
            if src in df.columns:
                df = df.withColumnRenamed(src, dst)
        parts.append(df)
    if not parts:
        raise FileNotFoundError(f"no CSV file with a header at {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _csv_headers(spark: SparkSession, path: str) -> list:
    """(file, header line) of every file: one row per file, found without reading the files whole."""
    lines = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # the first line of the block at byte 0 of each file
    first = lines.filter("at = 0").withColumn("_n", F.monotonically_increasing_id())
    return first.groupBy("file").agg(F.min_by("value", "_n").alias("header")).collect()


def write_effects_csv(df: DataFrame, path: str) -> None:
    out = df
    for src, dst in CSV_COLUMNS.items():
        if dst in out.columns:
            out = out.withColumnRenamed(dst, src)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_embedding_map(emb: DataFrame, path: str, label: str = "label", vec: str = "embedding") -> None:
    """O05 (export form): JSON lines, each ``{"<label>": [floats]}``."""
    emb.select(F.to_json(F.create_map(F.col(label).cast("string"), F.col(vec))).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_embedding_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(label STRING, embedding ARRAY<FLOAT>)`` from JSON-lines maps."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no embedding map at {path}; write one with write_embedding_map first")
    lines = spark.read.text(path)
    m = F.from_json("value", "map<string,array<float>>")
    return lines.select(F.explode(m).alias("label", "embedding"))


def write_embedding_object(emb: DataFrame, path: str, label: str = "label", vec: str = "embedding") -> None:
    """O05 (the source's form): one JSON object of labels and vectors in one file.

    One file is written by one task, which streams lines that Spark made and ordered.
    """
    numbered = global_row_number(emb, [F.col(label).asc()], "_rn")
    n = emb.agg(F.count(F.lit(1))).scalar()
    name = F.regexp_extract(F.to_json(F.struct(F.col(label).cast("string").alias("k"))), r'^\{"k":(.*)\}$', 1)
    line = F.concat(
        F.when(F.col("_rn") == 1, "{").otherwise(""), name, F.lit(": "), F.to_json(vec), F.when(F.col("_rn") == n, "}").otherwise(",")
    )
    numbered.withColumn("value", line).select("_rn", "value").repartition(1).sortWithinPartitions("_rn").select("value").write.mode("overwrite").text(path)


def read_embedding_object(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """O04 in the source's form: rows (label, embedding) of one JSON object, read by byte ranges."""
    entries = read_entries(spark, path, "map", split_bytes)
    return entries.select(F.col("key").alias("label"), F.from_json("value", "array<float>").alias("embedding"))


def read_documents_array(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, schema: T.StructType = DOCUMENT_SCHEMA) -> DataFrame:
    """O09 in the source's form: documents of one JSON array, read by byte ranges."""
    return read_entries(spark, path, "array", split_bytes).select(F.from_json("value", schema).alias("d")).select("d.*")


def write_embeddings(emb: DataFrame, path: str) -> None:
    """O05 (canonical form): Parquet."""
    emb.write.mode("overwrite").parquet(path)


def save_index(index: DataFrame, path: str, vec: str = "embedding", id_col: str = "vec_id") -> None:
    """Index table + one-row manifest (embedding width, document count)."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    manifest = index.agg(
        F.max(F.size(vec)).cast("long").alias("embed_dim"),
        F.count(F.lit(1)).cast("long").alias("n_documents"),
    )
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The index (with re-normalised ``unit_embedding``) and its manifest."""
    index = embedding_unit(spark.read.parquet(f"{path}/index"), vec)
    manifest = spark.read.parquet(f"{path}/manifest")
    return index, manifest


def save_catalog(genes: DataFrame, perturbations: DataFrame, counts: DataFrame, path: str, config: dict[str, int] | None = None) -> None:
    """The catalogue as three Parquet tables and one row of configuration (width, gene limit, genes kept, ...)."""
    if config:
        row = spark_row(genes.sparkSession, config)
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    genes.write.mode("overwrite").parquet(f"{path}/genes")
    perturbations.write.mode("overwrite").parquet(f"{path}/perturbations")
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def spark_row(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(int(v) for v in values.values())], ", ".join(f"{c} long" for c in values))


def write_documents_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_documents_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Documents with the nested metadata schema (JSON lines, or one array per file)."""
    return spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", multiline).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
