"""Operator 4, benchmark decontamination (DataFrame functions only).

A benchmark item leaks into a document if an item-sized window of the document holds at
least ``SIMILARITY`` of the item's five-word shingles, each weighted by how often the item has
it (and counted in the window as often at most).

1. Windows: a window that reaches the similarity misses at most a quarter of the item's weight,
   so it holds one of the item's rarest shingles (in the benchmark) that weigh more than a quarter
   together: its seeds. Documents with a seed are searched for all shingles of that item. The
   places in both say where the item would start; windows of the item's length at those starts
   are cut and, where an item gets more than one start or repeats a shingle, those that begin with a shared shingle:
   any window can be moved there without losing one. A document that holds less than
   ``SIMILARITY`` of the item's weight in all its words has no such window.
2. Fingerprints: a 64-bit SimHash of every window and item, in which a shingle's coordinate is
   the square root of its number. Two of equal length then have equal norms, and their cosine is
   at least the similarity, whatever is repeated.
3. Candidates: fingerprints are cut into ``RADIUS + 1`` blocks; two that differ in at most
   ``RADIUS`` bits agree in a block, so the equality join on (item length, block number,
   block value) finds all pairs within the radius. Only these are verified.
4. Verification: the exact weighted share of the item's shingles in the window.

A cosine of 0.75 is an angle of 41 degrees: a bit differs with a chance of 0.23. The chance of
more than 25 of 64 is 0.0013 there, and less above, which is the loss of step 3 (README: measured).

The benchmark is the bounded side: items of equal words count once, its shingles are counted,
and broadcast only if few. Defined results: words are runs of letters and digits, compared after
lower-casing (so changed case or punctuation hides nothing); an item of fewer than five words is
one shingle of all its words; null or empty items match nothing and null or empty texts hold
nothing; repeated items are reported each under its id; rows that repeat a doc_id are documents of
their own and reported as one (the best window of any of them), as are rows with a null doc_id;
very long texts are searched whole; only the id and text columns are read, so others may clash;
empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertlake.llm.common import checked_broadcast, materialize

SHINGLE = 5
SIMILARITY = 0.75
BITS = 64
RADIUS = 25

_SEPARATORS = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")


def _shingle_hash(words: Column, first: Column, size: int) -> Column:
    """Hash of ``size`` words from the 1-based place ``first``."""
    return F.xxhash64(*[F.get(words, first + (j - 1)) for j in range(size)])


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: _shingle_hash(words, i, size)),
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_ids, width (words), size (words per shingle), shingles of every distinct sequence of words."""
    rows = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    # a copied item counts once; its ids are reported each
    rows = rows.groupBy("words").agg(F.collect_set(F.struct("item_id")).alias("item_ids"))
    width = F.size("words")
    short = F.coalesce(*[
        F.when(width == k, F.array(_shingle_hash(F.col("words"), F.lit(1), k))) for k in range(1, SHINGLE)
    ], shingles_of(F.col("words")))
    return rows.select(
        "item_ids", F.monotonically_increasing_id().alias("item"), width.alias("width"),
        F.least(width, F.lit(SHINGLE)).alias("size"), short.alias("shingles"),
    )


def _fingerprint(bits: list[Column]) -> Column:
    """64 weighted sums to one long: bit j is set where sum j is positive."""
    return reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(s > 0, F.lit(1 << j if j < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for j, s in enumerate(bits)
    ])


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash per key from rows (keys, hash, n): the coordinate of a shingle is the root of its number."""
    root = F.sqrt(F.col("n").cast("double"))
    named = [
        F.sum(F.when(F.expr(f"getbit(hash, {j})") == 1, root).otherwise(-root)).alias(f"s{j}")
        for j in range(BITS)
    ]
    summed = rows.groupBy(*keys).agg(*named)
    return summed.select(*keys, _fingerprint([F.col(f"s{j}") for j in range(BITS)]).alias("fingerprint"))


def _blocks(fingerprint: Column, blocks: int) -> Column:
    """The fingerprint cut into ``blocks`` runs of bits, as an array of (number, value)."""
    out, low = [], 0
    for i in range(blocks):
        width = BITS // blocks + (i < BITS % blocks)
        out.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value")))
        low += width
    return F.array(*out)


def seeds_of(counts: DataFrame) -> DataFrame:
    """The rows of ``counts`` (item, size, total, hash, n, ...) that are the item's rarest shingles up to more than a quarter of its weight."""
    rare = counts.withColumn("items", F.count(F.lit(1)).over(Window.partitionBy("hash")))
    order = Window.partitionBy("item").orderBy("items", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    return rare.withColumn("before", before).filter(F.col("before") <= F.col("total") * (1 - SIMILARITY) + 1e-9).drop("before", "items")


def _leaking(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """doc, doc_id, item_id, similarity, distance, start of every leaking window."""
    items = materialize(benchmark_items(benchmark), "op4-items")
    places = items.select("item", "width", "size", F.posexplode("shingles").alias("place", "hash"))
    n_items = items.count()
    counts = places.groupBy("item", "width", "size", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    counts = materialize(counts.withColumn("total", F.sum("n").over(Window.partitionBy("item"))), "op4-shingles")
    n_counts = counts.count()
    seeds = materialize(seeds_of(counts).select("item", "size", "hash"), "op4-seeds")
    n_seeds = seeds.count()

    text = F.col(text_col)
    # rows that repeat an id and text are one document
    key = document_key(docs, id_col, text_col).alias("doc")
    keyed = docs.select(key, F.col(id_col).cast("long").alias("doc_id"), words_of(text).alias("words"))

    def seeded(size: int) -> DataFrame:
        own = seeds.filter(F.col("size") == size).drop("size")
        return keyed.select("doc", F.explode(shingles_of(F.col("words"), size)).alias("hash")).join(checked_broadcast(own, n_seeds), "hash").select("doc", "item")

    sizes = [r["size"] for r in seeds.select("size").distinct().collect()] or [SHINGLE]  # 1 to 5
    wanted = materialize(reduce(DataFrame.unionByName, [seeded(s) for s in sizes]).distinct(), "op4-seeded")
    n_wanted = wanted.count()
    some = materialize(keyed.join(checked_broadcast(wanted.select("doc").distinct(), n_wanted), "doc", "left_semi").dropDuplicates(["doc"]), "op4-texts")

    def shared(size: int) -> DataFrame:
        """Where a seeded document holds shingles of ``size`` words of its items, and where the item would start."""
        own = counts.filter(F.col("size") == size)
        pairs = wanted.join(checked_broadcast(own.select("item").distinct(), n_items), "item", "left_semi")
        found = some.select("doc", F.posexplode(shingles_of(F.col("words"), size)).alias("at", "hash")).join(
            checked_broadcast(own.select("hash").distinct(), n_counts), "hash", "left_semi"
        )
        return found.join(pairs, "doc").join(checked_broadcast(own, n_counts), ["item", "hash"]).select(
            "doc", "item", "width", "size", "hash", "n", "total", "at", (F.col("at") - F.col("place")).alias("start")
        )

    met = materialize(reduce(DataFrame.unionByName, [shared(s) for s in sizes]), "op4-met")
    # what the whole document holds of the item: no window holds more
    held = (
        met.groupBy("doc", "item", "hash", "n", "total").agg(F.count_distinct("at").alias("m"), F.min("start").alias("low"), F.max("start").alias("high"))
        .groupBy("doc", "item", "total").agg(F.sum(F.least("n", "m")).alias("most"), ((F.min("low") < F.max("high")) | (F.max("n") > 1)).alias("shifted"))
        .filter(F.col("most") >= SIMILARITY * F.col("total") - 1e-9)
        .select("doc", "item", "shifted")
    )
    begins = F.explode(F.when(F.col("shifted"), F.array("start", "at")).otherwise(F.array("start"))).alias("start")
    starts = materialize(met.join(held, ["doc", "item"]).select("doc", "width", "size", begins).distinct(), "op4-starts")
    spans = starts.groupBy("doc").agg(F.collect_set(F.struct("start", "width", "size")).alias("spans"))
    # the windows of the documents that have any, as shingle hashes
    windows = (
        some.join(spans, "doc").select("doc_id", "doc", "words", F.explode("spans").alias("s"))
        .select(
            "doc_id", "doc", F.col("s.start").alias("start"), F.col("s.width").alias("width"), F.col("s.size").alias("size"),
            F.slice("words", F.greatest(F.col("s.start"), F.lit(0)) + 1, F.least(F.col("s.width"), F.col("s.width") + F.col("s.start"))).alias("words"),
        )
    )
    hashes = F.coalesce(*[F.when(F.col("size") == k, shingles_of(F.col("words"), k)) for k in range(1, SHINGLE + 1)])
    window_counts = materialize(
        windows.select("doc_id", "doc", "start", "width", F.explode(hashes).alias("hash")).groupBy("doc_id", "doc", "start", "width", "hash").agg(F.count(F.lit(1)).alias("n")),
        "op4-windows",
    )
    blocks = radius + 1
    window_prints = materialize(fingerprints(window_counts, ["doc", "start", "width"]), "op4-prints")
    item_prints = fingerprints(counts, ["item", "width"]).withColumnRenamed("fingerprint", "item_print")
    window_blocks = window_prints.select("doc", "start", "width", "fingerprint", F.inline(_blocks(F.col("fingerprint"), blocks)))
    item_blocks = item_prints.select("item", "width", "item_print", F.inline(_blocks(F.col("item_print"), blocks)))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    near = (
        window_blocks.join(checked_broadcast(item_blocks, n_items * blocks), ["width", "block", "value"])
        .withColumn("distance", distance).filter(F.col("distance") <= radius)
        .select("doc", "start", "width", "item", "distance").distinct()
    )
    # exact similarity: shared weight, counted with multiplicity, over the item's weight
    own = counts.select("item", "hash", F.col("n").alias("n_item"), "total")
    ids = items.select("item", F.explode("item_ids.item_id").alias("item_id"))
    return (
        near.join(window_counts, ["doc", "start", "width"])
        .join(checked_broadcast(own, n_counts), ["item", "hash"])
        .groupBy("doc_id", "doc", "start", "item", "distance", "total")
        .agg(F.sum(F.least("n", "n_item")).alias("shared"))
        .withColumn("similarity", F.col("shared") / F.col("total"))
        .filter(F.col("shared") >= SIMILARITY * F.col("total") - 1e-9)
        .join(checked_broadcast(ids, n_items), "item")
    )


def document_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """id and 128 bits of the text: rows with one key are one document."""
    return F.struct(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("a"), F.xxhash64(F.lit("second half"), docs[text_col]).alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, distance, start (first word, from 0) of the best window per document and item."""
    best = F.struct(F.col("similarity"), (-F.col("distance")).alias("near"), (-F.col("start")).alias("early"))
    return (
        _leaking(docs, benchmark, id_col, text_col, radius).groupBy("doc_id", "item_id").agg(F.max(best).alias("best"))
        .select(
            "doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"),
            (-F.col("best.near")).cast("int").alias("distance"), (-F.col("best.early")).cast("long").alias("start"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item, with all their columns."""
    hit = materialize(_leaking(docs, benchmark, id_col, text_col, RADIUS).select(F.col("doc").alias("__leaked")).distinct(), "op4-hits")
    side = checked_broadcast(hit, hit.count())
    return docs.join(side, document_key(docs, id_col, text_col) == side["__leaked"], "left_anti")
