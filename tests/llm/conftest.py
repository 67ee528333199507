import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs():
    """doc_id -> text of the small documents table."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    return dict(rows)


@pytest.fixture()
def docs_of(spark):
    """A documents-like table from (doc_id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, **extra):
        names = ["doc_id", "text", "digest", "salt", "keep_id", "start", "length", "piece", "task", "n", "word"]
        types = "doc_id long, text string, digest string, salt int, keep_id long, start long, length long, piece int, task int, n long, word string"
        data = [(i, t, "x", 1, -1, -1, -1, -1, -1, -1, "w") for i, t in rows]
        df = spark.createDataFrame(data, types).select(*names)
        return df.repartition(3) if len(rows) > 3 else df

    return make


ODD_TEXTS = [
    (1, None), (2, ""), (3, "  "), (4, "a"), (5, "Same text here, twice"), (6, "same TEXT here, twice"),
    (7, "same text here, twice"), (7, "same text here, twice"), (None, "no id"), (None, "no id"), (8, "tab\tand\x0bvt  double"),
    (9, "É é x y\n\nz"), (10, "don't we're \n I'll"), (11, "<|endoftext|> <|startoftext|>"),
    (12, "w" * 5000), (13, " ".join(f"t{i % 977}" for i in range(40_000))), (14, "\n"), (15, "中文 字 emoji 👩‍👩‍👧 é"),
]
