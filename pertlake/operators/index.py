"""Vector index as a table, and exact cosine search.

The index is one DataFrame keyed by id (no positional alignment). Exact kNN: an index of at most
``BLOCK_BYTES`` is sent to the tasks once and every query row stays where it is. A larger one is
cut into cells around pivots (at most ``PIVOTS`` of its own rows), and cells into blocks of that
size. A query is sent only to cells that can hold one of its k best: by the angle between query
and pivot and the cell's range of angles (triangle inequality on the sphere) no row of a skipped
cell reaches the k-th best score among the pivots. Tasks stream queries past one block at a time;
a final ``row_number() <= k`` per query merges the blocks' candidates (partial limit before the
shuffle). No pair table is materialised, and the result is exact under the total order
(score desc, id asc).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertlake.functions.columns import NORM_EPS, array_l2_norm, array_scale, array_unit
from pertlake.session import written

DEFAULT_K = 3
BLOCK_BYTES = 64 << 20
SCORE_BYTES = 16 << 20  # of the scores a task computes at a time
PIVOTS = 1024
QUERY_ROWS = 1 << 20  # of one copy of a block
SLACK = 1e-9  # of a bound, against rounding


def query_unit(arr: Column) -> Column:
    """N15 query rule: divide only when the norm exceeds 1e-8."""
    norm = array_l2_norm(arr)
    return F.when(norm > NORM_EPS, array_scale(arr, norm)).otherwise(F.transform(arr, lambda x: x.cast("double")))


def embedding_unit(emb: DataFrame, col: str = "embedding", out: str = "unit_embedding") -> DataFrame:
    """O20 (identity guard): unit-length vectors; norms below 1e-8 are left as they are."""
    return emb.withColumn(out, array_unit(F.col(col), "identity"))


def embedding_centroid(emb: DataFrame, col: str = "embedding") -> DataFrame:
    """Mean vector, as rows ``(dim, value)``.

    ``posexplode`` + a hash aggregate on the dimension: partial sums per task, one
    group per dimension; nothing gathers whole vectors.
    """
    exploded = emb.select(F.posexplode(col).alias("dim", "v"))
    return exploded.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("value")).select(
        F.col("dim").cast("long").alias("dim"), "value"
    )


def centroid_vector(emb: DataFrame, col: str = "embedding") -> DataFrame:
    """O19 as a one-row table holding the centroid array (width = embedding width)."""
    c = embedding_centroid(emb, col)
    return c.agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_c")).select(
        F.transform("_c", lambda x: x["value"]).alias("centroid")
    )


def align_index(emb: DataFrame, docs: DataFrame, emb_key: str = "vec_id", doc_key: str = "doc_id") -> DataFrame:
    """Vectors joined with their documents by key (inner equi-join)."""
    return emb.join(docs, emb[emb_key] == docs[doc_key], "inner").drop(docs[doc_key])


def align_missing(emb: DataFrame, docs: DataFrame, emb_key: str = "vec_id", doc_key: str = "doc_id") -> DataFrame:
    """Keys present on one side only, with ``side`` = 'no_document' / 'no_embedding'."""
    e = emb.select(F.col(emb_key).alias("id"))
    d = docs.select(F.col(doc_key).alias("id"))
    return e.join(d, "id", "left_anti").withColumn("side", F.lit("no_document")).unionByName(
        d.join(e, "id", "left_anti").withColumn("side", F.lit("no_embedding"))
    )


def index_quality(emb: DataFrame, docs: DataFrame, emb_key: str = "vec_id", doc_key: str = "doc_id", col: str = "embedding") -> DataFrame:
    """Alignment and vector checks as a one-row quality table (never raises)."""
    e = emb.agg(
        F.count(F.lit(1)).cast("long").alias("n_embeddings"),
        F.count_distinct(emb_key).cast("long").alias("_ek"),
        F.count_if(array_l2_norm(F.col(col)) < NORM_EPS).cast("long").alias("n_zero_norm"),
        F.count_if(F.exists(col, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))).cast("long").alias("n_nonfinite"),
        F.min(F.size(col)).cast("long").alias("min_dim"),
        F.max(F.size(col)).cast("long").alias("max_dim"),
    )
    d = docs.agg(F.count(F.lit(1)).cast("long").alias("n_documents"), F.count_distinct(doc_key).cast("long").alias("_dk"))
    miss = align_missing(emb, docs, emb_key, doc_key).agg(
        F.count_if(F.col("side") == "no_document").cast("long").alias("n_missing_document"),
        F.count_if(F.col("side") == "no_embedding").cast("long").alias("n_missing_embedding"),
    )
    row = e.select(
        "*",
        d.select("n_documents").scalar().alias("n_documents"),
        d.select("_dk").scalar().alias("_dk"),
        miss.select("n_missing_document").scalar().alias("n_missing_document"),
        miss.select("n_missing_embedding").scalar().alias("n_missing_embedding"),
    )
    return row.select(
        "n_embeddings",
        "n_documents",
        (F.col("n_embeddings") - F.col("_ek")).alias("n_duplicate_embedding_keys"),
        (F.col("n_documents") - F.col("_dk")).alias("n_duplicate_document_keys"),
        "n_missing_document",
        "n_missing_embedding",
        "n_zero_norm",
        "n_nonfinite",
        "min_dim",
        "max_dim",
        (
            (F.col("n_missing_document") == 0)
            & (F.col("n_missing_embedding") == 0)
            & (F.col("n_embeddings") == F.col("_ek"))
            & (F.col("n_documents") == F.col("_dk"))
        ).alias("aligned"),
    )


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


class Block:
    """Index rows of a task: ids in ascending order and their vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
        self.ids, self.vectors = ids, vectors

    def best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first k rows per query under (score desc, id asc)."""
        scores = queries @ self.vectors.T
        k = min(k, len(self.ids))
        if k < len(self.ids):
            # all rows at or above the k-th score of each query, then the order among those few
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        else:
            least = scores.min(axis=1, initial=np.inf)
        row, at = np.nonzero(~(scores < least[:, None]))  # in id order within a query
        order = np.lexsort((at, -scores[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, np.arange(len(queries)))
        kept = np.arange(len(row)) - first[row] < k
        return self.ids[at[kept]].reshape(len(queries), k), scores[row[kept], at[kept]].reshape(len(queries), k)


_HITS = "query_id long, id long, score double"


def _hits(query_ids: np.ndarray, block: Block, queries: np.ndarray, k: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(rows, (SCORE_BYTES // 8) // max(1, len(block.ids))))
    for a in range(0, len(queries) if len(block.ids) else 0, rows):
        ids, scores = block.best(queries[a : a + rows], k)
        yield pa.record_batch(
            [pa.array(np.repeat(query_ids[a : a + rows], ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query_id", "id", "score"]
        )


def _few_rows(batches: Iterator[pa.RecordBatch], scores: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows that ``scores`` a row take SCORE_BYTES."""
    rows = max(1, (SCORE_BYTES // 8) // max(1, scores))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _search_one_block(q: DataFrame, block: Block, k: int) -> DataFrame:
    held = q.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _hits(batch.column(0).to_numpy(), held.value, _matrix(batch.column(1)), k)

    return q.mapInArrow(search, _HITS)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _cells(x: DataFrame, pivots: np.ndarray) -> DataFrame:
    """cell, angle, id, v: every index row at its nearest pivot; rows without a direction in cell -1."""
    held = x.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches, len(held.value)):
            v = _matrix(batch.column(1))
            angle = _angles(v, held.value)
            cell = angle.argmin(axis=1)
            unit = np.abs((v * v).sum(axis=1) - 1.0) < 1e-6
            yield pa.record_batch(
                [pa.array(np.where(unit, cell, -1)), pa.array(angle[np.arange(len(v)), cell]), batch.column(0), batch.column(1)],
                names=["cell", "angle", "id", "v"],
            )

    return x.mapInArrow(assign, "cell long, angle double, id long, v array<double>")


def _routed(q: DataFrame, pivots: np.ndarray, cells: dict[int, tuple[float, float]], k: int) -> DataFrame:
    """query_id, v, cells: the cells that may hold one of the query's k best."""
    names = np.array(sorted(c for c in cells if c >= 0), np.int64)
    low, high = (np.array([cells[c][i] for c in names]) for i in (0, 1))
    held = q.sparkSession.sparkContext.broadcast((pivots, names, low, high, -1 in cells))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, names, low, high, loose = held.value
        for batch in _few_rows(batches, len(pivots)):
            v = _matrix(batch.column(1))
            scores = v @ pivots.T
            reach = np.full(len(v), -np.inf) if len(pivots) < k else -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            angle = np.arccos(np.clip(scores[:, names], -1.0, 1.0))
            nearest = np.maximum(0.0, np.maximum(angle - high, low - angle))
            wanted = ~(np.cos(nearest) < reach[:, None] - SLACK)
            # a query without a direction is searched everywhere
            wanted |= (np.abs((v * v).sum(axis=1) - 1.0) >= 1e-6)[:, None]
            lists = [np.append(names[w], -1) if loose else names[w] for w in wanted]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=["query_id", "v", "cells"]
            )

    return q.mapInArrow(route, "query_id long, v array<double>, cells array<long>")


def _stream_blocks(k: int):
    """Per (cell, part, copy): the block's rows come first, then the queries stream past them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "copy")), strict=True))
            kind = batch.column("kind").to_numpy()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kind[i] != kind[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    key, ids, vectors, block = keys[a], [], [], None
                some, m = batch.column("id").slice(a, b - a).to_numpy(), _matrix(batch.column("v").slice(a, b - a))
                if kind[a] == 0:
                    ids.append(some)
                    vectors.append(m)
                elif ids or block is not None:
                    if block is None:
                        block = Block(np.concatenate(ids), np.vstack(vectors))
                        ids, vectors = [], []  # held once
                    yield from _hits(some, block, m, k)

    return search


def _search_cells(q: DataFrame, x: DataFrame, k: int, n: int, row_bytes: int, block_bytes: int, pivots: int, query_rows: int) -> DataFrame:
    some = x.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max(2, math.ceil(n * row_bytes / block_bytes)))).collect()  # at most PIVOTS rows
    directions = np.array([r["v"] for r in some], np.float64)
    cells = written(_cells(x, directions), "knn-cells")
    ranges = {r["cell"]: r for r in cells.groupBy("cell").agg(F.min("angle").alias("a"), F.max("angle").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    routed = written(_routed(q, directions, {c: (r["a"], r["b"]) for c, r in ranges.items()}, k), "knn-queries")
    asked = {r["cell"]: r["n"] for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # parts of a cell by its bytes, copies of a part by its queries: at most PIVOTS + 1 entries
    parts = {c: max(1, math.ceil(r["n"] * row_bytes / block_bytes)) for c, r in ranges.items()}
    copies = {c: max(1, math.ceil(asked.get(c, 0) / query_rows)) for c in ranges}
    table = lambda m: F.element_at(F.create_map(*[F.lit(int(i)) for kv in m.items() for i in kv]), F.col("cell").cast("int"))
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    blocks = cells.select("cell", F.pmod(F.xxhash64("id"), table(parts)).cast("int").alias("part"), F.explode(upto(table(copies))).alias("copy"), F.lit(0).alias("kind"), "id", "v")
    queries = routed.select(F.explode("cells").alias("cell"), "query_id", "v").select(
        "cell", F.explode(upto(table(parts))).alias("part"), F.pmod(F.xxhash64("query_id"), table(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v"
    )
    dealt = blocks.unionByName(queries).repartition("cell", "part", "copy").sortWithinPartitions("cell", "part", "copy", "kind", "id")
    return dealt.mapInArrow(_stream_blocks(k), _HITS)


def knn_cosine(
    queries: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_K,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    index_id: str = "vec_id",
    index_vec: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    pivots: int = PIVOTS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Exact cosine top-k of ``index`` for every query row.

    Returns ``(query_id, rank, id, score)``; k larger than the index returns the
    whole index. Ids are BIGINT. Ties go to the smaller id.
    """
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), query_unit(F.col(query_vec)).alias("v"))
    x = index.select(F.col(index_id).cast("long").alias("id"), array_unit(F.col(index_vec), "identity").alias("v"))
    n, width = index.agg(F.count(F.lit(1)), F.max(F.size(index_vec))).first()
    row_bytes = 8 * ((width or 0) + 1)
    if n * row_bytes <= block_bytes:
        rows = x.toArrow().combine_chunks() if n else None  # at most a block
        block = Block(rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks())) if n else Block(np.empty(0, np.int64), np.empty((0, 1)))
        found = _search_one_block(q, block, k)
    else:
        found = _search_cells(q, x, k, n, row_bytes, block_bytes, pivots, query_rows)
    one = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = found.withColumn("rank", F.row_number().over(one)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def search_documents(hits: DataFrame, index: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Hits with what the index holds of them: every column of ``index`` but the vector joins on the id."""
    held = index.drop("embedding").withColumn("id", F.col(id_col).cast("long")).drop(id_col)
    return hits.join(held, "id")


def knn_single(query: Column, index: DataFrame, k: int = DEFAULT_K, index_id: str = "vec_id",
               index_vec: str = "embedding") -> DataFrame:
    """O25 for one query vector (an array-valued column, e.g. a scalar subquery).

    One scan of the index computing the cosine in the JVM, then a global top-k
    (TakeOrderedAndProject: each task keeps k rows). Returns ``(rank, id, score)``.
    """
    x = index.select(
        F.col(index_id).cast("long").alias("id"),
        array_unit(F.col(index_vec), "identity").alias("v"),
        query.alias("_q"),  # projected first: lambdas may not hold a subquery
    ).select("id", "v", query_unit(F.col("_q")).alias("_q"))
    scored = x.select("id", F.aggregate(F.zip_with("v", "_q", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v).alias("score"))
    top = scored.orderBy(F.col("score").desc(), F.col("id").asc()).limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id").asc())).cast("long").alias("rank"), "id", "score")


def self_retrieval(index: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Does every indexed vector find itself first (or an equally close twin)?

    One row: number of vectors and number whose rank-1 hit is itself or scores
    within 1e-6 of the self score.

    No score exceeds the product of the query's norm and the largest norm in the index
    (Cauchy-Schwarz), so a row whose self score comes within 1e-6 of that product needs no search:
    whatever is ranked first is itself or as close. Rows of equal direction are the case of
    equality and certify each other. Only rows without that certificate (none, where all vectors
    are finite) are searched for.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    rows = index.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec).alias("v"), query_unit(F.col(vec)).alias("q"), array_unit(F.col(vec), "identity").alias("x"))
    rows = rows.select("query_id", "v", dot("q", "x").alias("self_score"), F.sqrt(dot("q", "q")).alias("q_norm"), F.sqrt(dot("x", "x")).alias("x_norm"))
    largest = rows.agg(F.max("x_norm")).scalar()  # NaN is the largest of all
    marked = rows.withColumn("certified", F.coalesce(F.col("q_norm") * largest <= F.col("self_score") + F.lit(1e-6), F.lit(False)) & ~F.isnan(largest))
    n, sure = marked.agg(F.count(F.lit(1)), F.count_if("certified")).first()
    found = 0
    if sure < n:
        open_ = written(marked.filter(~F.col("certified")).select("query_id", "v", "self_score"), "self-open")
        hits = knn_cosine(open_, index, 1, "query_id", "v", id_col, vec).filter(F.col("rank") == 1)
        same = (F.col("id") == F.col("query_id")) | (F.col("score") <= F.col("self_score") + F.lit(1e-6))
        found = hits.join(open_.select("query_id", "self_score"), "query_id").filter(same).count()
    return index.sparkSession.createDataFrame([(n, sure + found)], "n_queries long, n_self_first long")
