"""Operator 12, vector code compression with a lexicographic trie over distinct parts.

Vectors become whole numbers, ``floor(4096 x)``, and are cut into ``PARTS`` consecutive parts.
Each part position has a codebook of at most ``ENTRIES`` entries, which starts as that part of
the vectors with the smallest ids and is refined in ``ROUNDS`` rounds of assignment and means.

Equal parts are counted once, before and after a shuffle, so a vector that fills a third of the
table is one weighted part. The distinct parts are range-partitioned in lexicographic order and
written once. In a round, every task walks the trie of its sorted parts depth first: a node adds
its dimension's squared differences to the vector of distances (one per entry) of its parent, so
parts with a common prefix share that work; a leaf takes the nearest entry and adds its weight
and weighted components to that entry's sums. A node with many leaves is walked child by child;
what has at most ``BLOCK`` leaves is walked with one numpy step per dimension. Tasks send the
sums of their entries, at most PARTS x ENTRIES x part width numbers, and the driver holds the
codebooks of that size. At the end every vector is coded with the same walk over its batch.

Defined results: rows whose vector is null or has a null or non-finite component are left out;
the width is that of the vector with the smallest id, and rows of another width are left out;
a width that isn't a multiple of PARTS gives parts whose widths differ by one, and an empty
vector empty parts; null ids come last; of rows with one id the lexicographically smallest
vector comes first; fewer than ENTRIES vectors give as many entries; ties go to the lower
entry; repeated rows get a result each; other columns aren't read; an empty table gives no
rows. Components so large that a squared distance would not fit a long raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import BROADCAST_ROWS, materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096
LABEL_SALTS = 16


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (whole components) of the rows that have a finite vector."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    kept = vectors.filter(F.col(vector_col).isNotNull() & finite)
    return kept.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"),
    )


def part_edges(width: int, parts: int = PARTS) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


class Trie:
    """The trie of the rows of ``parts`` (best sorted; a node is a run of rows with an equal prefix)."""

    def __init__(self, parts: np.ndarray, block: int = BLOCK):
        self.parts, self.block = parts, block
        n, self.width = parts.shape
        # differs[i, d]: row i leaves the prefix of row i - 1 at dimension d or before
        differs = np.ones((n, self.width), bool)
        differs[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
        self.differs = differs

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry of every row, its squared distance); ties to the lower entry."""
        n = len(self.parts)
        best, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        stack = [(0, n, 0, np.zeros(len(book), np.int64))] if n else []
        while stack:
            low, high, depth, sums = stack.pop()
            if high - low <= self.block or depth == self.width:
                self._leaves(low, high, depth, sums, book, best, distance)
                continue
            # children in order: runs of small ones together, a large one by itself
            edges = np.append(np.flatnonzero(self.differs[low:high, depth]) + low, high)
            edges[0] = low
            children, at = [], 0
            while at < len(edges) - 1:
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + self.block, "right")) - 1)
                a, b = int(edges[at]), int(edges[to])
                if b - a <= self.block:
                    children.append((a, b, depth, sums))
                else:
                    children.append((a, b, depth + 1, sums + (self.parts[a, depth] - book[:, depth]) ** 2))
                at = to
            stack.extend(reversed(children))
        return best, distance

    def _leaves(self, low: int, high: int, depth: int, sums: np.ndarray, book: np.ndarray, best: np.ndarray, distance: np.ndarray) -> None:
        """Nearest entries of the rows low..high, all below one node at ``depth`` with accumulated ``sums``."""
        acc, node = sums[None, :], np.zeros(high - low, np.int64)
        for d in range(depth, self.width):
            new = self.differs[low:high, d].copy()
            new[0] = True
            first = np.flatnonzero(new)
            gap = self.parts[low + first, d][:, None] - book[:, d][None, :]
            acc = acc[node[first]] + gap * gap
            node = np.cumsum(new) - 1
        entry = acc.argmin(axis=1)
        best[low:high] = entry[node]
        distance[low:high] = acc[np.arange(len(acc)), entry][node]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


def distinct_parts(vectors: DataFrame, width: int) -> DataFrame:
    """part, values, n: the distinct parts of each position with their counts, in lexicographic ranges."""
    edges = part_edges(width)
    parts = F.array(*[
        F.struct(F.lit(p).alias("part"), F.slice("v", a + 1, b - a).cast("array<int>").alias("values"))
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ])
    counted = vectors.select(F.inline(parts)).groupBy("part", "values").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "op12-parts")
    return materialize(counted.repartitionByRange("part", "values").sortWithinPartitions("part", "values"), "op12-sorted")


def _round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round of assignment and means."""

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]  # last column: weight
        for batch in batches:
            part, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                values = _matrix(batch.column(1).take(pa.array(mine)), books[p].shape[1])
                best, _ = Trie(values).nearest(books[p])
                np.add.at(sums[p], best, np.column_stack((values, np.ones(len(mine), np.int64))) * weight[mine, None])
        used = [(p, e, i, int(s[e, i]), int(s[e, -1])) for p, s in enumerate(sums) for e in np.flatnonzero(s[:, -1]) for i in range(s.shape[1] - 1)]
        columns = list(zip(*used, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)], names=["part", "entry", "place", "total", "n"])

    rows = parts.mapInArrow(sums_of, "part int, entry int, place int, total long, n long")
    new = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return new


def first_books(vectors: DataFrame, width: int, entries: int = ENTRIES) -> list[np.ndarray]:
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    rows = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    edges = part_edges(width)
    return [rows[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def codebooks(vectors: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """One (entries, part width) array per part position, after all rounds."""
    books = first_books(vectors, width, entries)
    parts = distinct_parts(vectors, width)
    for _ in range(rounds):
        books = _round(parts, books)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    edges = np.cumsum([0, *(b.shape[1] for b in books)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(2), int(edges[-1]))
            codes, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for p, book in enumerate(books):
                part = rows[:, edges[p] : edges[p + 1]]
                order = np.lexsort(part.T[::-1]) if part.shape[1] else np.arange(len(part))
                best, distance = Trie(part[order]).nearest(book)
                codes[order, p] = best
                error[order] += distance
            digits, n = codes.tobytes().hex(), 2 * len(books)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([digits[i : i + n] for i in range(0, n * len(rows), n)], pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(coded, f"vec_id long, label {label}, code string, error long")


def with_label_error(coded: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``coded`` with label_error: the error summed over rows of an equal label (nulls together)."""
    sums = materialize(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "op12-labels")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.count() <= broadcast_rows:
        return coded.join(F.broadcast(sums), same).drop("__label")
    # many labels, of which some may be frequent: rows of a label are dealt to several tasks
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALTS)))
    copies = sums.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LABEL_SALTS - 1).cast("long"))))
    return salted.join(copies, same & (F.col("__salt") == F.col("__copy"))).drop("__label", "__salt", "__copy")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def _within(v: Column, width: int) -> Column:
    """``v``, or an error where a sum of squared differences might not fit a long."""
    most = math.isqrt(2**61 // max(1, width))
    return F.when(F.forall(v, lambda x: F.abs(x) <= most), v).otherwise(F.raise_error(F.lit(f"op12: a component is beyond {most}")))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every kept vector."""
    whole = whole_numbers(vectors, id_col, vector_col, label_col)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    width = first[0] if first else 0
    whole = whole.filter(F.size("v") == width).withColumn("v", _within(F.col("v"), width))
    books = codebooks(whole, width) if first else [np.zeros((0, 0), np.int64)] * PARTS
    coded = materialize(encode(whole, books), "op12-coded")
    return with_label_error(coded, broadcast_rows).withColumn("codebooks_sha256", F.lit(digest(books)))
