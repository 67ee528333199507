"""Operator 7, best-fit packing with exact-complement hashing.

What fits together depends on lengths alone, and there are at most ``capacity`` of them,
so the packing is planned on the table of length counts (bounded by the capacity, whatever
the corpus) and then dealt out to the pieces by their rank within their length:

1. pieces: every document's ids, cut only if longer than the capacity;
2. counts per length; the plan: for each length, from long to short, the gap it leaves is
   looked up among single lengths, then pair sums, then triple sums of the lengths still
   available, and as many exact fills are taken as the counts allow; what is left goes by
   best fit, longest first, into the fullest sequences it fits, in bulk;
3. ranks: a running sum over (length, task) counts plus the rank within the task; rank
   ranges of each length belong to one pattern of the plan, which gives sequence and place.

Defined results: null and empty texts are one end id; an empty table gives no rows;
repeated doc_ids are documents of their own; very long texts are encoded whole and cut at the
capacity; only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pertlake.llm.common import materialize, tokenizer_path
from pertlake.llm.encoding import worker_encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 0
CAPACITY = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

# a pattern: ((length, times), ...) from the sequence's start, and how many sequences have it
Pattern = tuple[tuple[tuple[int, int], ...], int]


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their task and their rank among the task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = worker_encoder(vocabulary, False)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            for row, ids in encoder.documents(batch.column(1), end_id):
                raw = ids.astype("<u4").tobytes()
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - start)
                    out.append((row, piece, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), int(seen[n])))
                    seen[n] += 1
            if out:
                rows, piece, start, length, crc, nth = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(rows), task, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns and their numbers that use every length exactly as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[Pattern] = []

    def take(*lengths: int) -> bool:
        """Use this combination as often as the counts allow."""
        times: dict[int, int] = defaultdict(int)
        for x in lengths:
            times[x] += 1
        n = min(int(left[x]) // t for x, t in times.items())
        if n:
            for x, t in times.items():
                left[x] -= n * t
            plan.append((tuple(sorted(times.items(), reverse=True)), n))
        return n > 0

    take(capacity)
    long_first = range(capacity - 1, 0, -1)
    for x in long_first:  # singles
        if left[x] and capacity - x <= x:
            take(x, capacity - x)
    for x in long_first:  # pairs
        gap = capacity - x
        high = min(gap - 1, x)
        if left[x] and high >= 1:
            a = np.arange(high, (gap + 1) // 2 - 1, -1)
            for y in a[(left[a] > 0) & (left[gap - a] > 0)]:
                if not left[x]:
                    break
                take(x, int(y), int(gap - y))
    for x in long_first:  # triples
        gap = capacity - x
        if not left[x]:
            continue
        for y in range(min(gap - 2, x), (gap + 2) // 3 - 1, -1):
            if not left[x]:
                break
            if not left[y]:
                continue
            rest = gap - y
            a = np.arange(min(y, rest - 1), (rest + 1) // 2 - 1, -1)
            for z in a[(left[a] > 0) & (left[rest - a] > 0)]:
                if not left[x] or not left[y]:
                    break
                take(x, y, int(z), int(rest - z))
    # best fit, longest first; room -> [(pattern, number of sequences)]
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    for x in range(capacity, 0, -1):
        while left[x]:
            fits = min((r for r, bins in room.items() if r >= x and bins), default=0)
            if not fits:
                full, rest = divmod(int(left[x]), capacity // x)
                if full:
                    room[capacity - x * (capacity // x)].append((((x, capacity // x),), full))
                if rest:
                    room[capacity - x * rest].append((((x, rest),), 1))
                left[x] = 0
                break
            pattern, n = room[fits].pop()
            m = min(n, int(left[x]))
            if m < n:
                room[fits].append((pattern, n - m))
            grown = (*pattern[:-1], (x, pattern[-1][1] + 1)) if pattern[-1][0] == x else (*pattern, (x, 1))
            room[fits - x].append((grown, m))
            left[x] -= m
    plan += [b for bins in room.values() for b in bins]
    return plan


def _segments(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """Rank ranges of each length, in order of (length, first rank)."""
    rows, used, base = [], defaultdict(int), 0
    for pattern, n in plan:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], times, base, offset))
            used[length] += times * n
            offset += length * times
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T, strict=True))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(cut_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "op7-pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _segments(plan_packing(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key per segment: the last segment that starts at or before (length, rank)
        scale = float(2**40)
        starts = table["length"] * scale + table["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            s = np.searchsorted(starts, length * scale + rank, side="right") - 1
            nth, slot = np.divmod(rank - table["rank"][s], table["times"][s])
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(table["sequence"][s] + nth), pa.array(table["offset"][s] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "task")
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path(spark, VOCABULARY))
