"""Operator 9, n-gram Jaccard join by vertical partitioning.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at
least 0.75; the result is one row per document with its set size and the smallest doc_id
reachable by links.

Global order. Shingles are ordered by hash, except that the ``HOT_SHINGLES`` most frequent
ones (counted over all documents) come last, by frequency. Any fixed order gives the same
result; this one keeps frequent shingles out of most prefixes. The list is bounded by that
parameter.

Classes. Documents with equal sets form a class; all further work is on classes.

Likely classes. A shingle that one class alone holds lies in no overlap, and two sets that link
share at least ``PERCENT`` of either. So a class goes on only if other classes hold that much of
it, counted over all of its shingles: ``held_counts`` packs them by hash range, in four bytes and an
owner each, and a range finds those met twice. (Two shingles of one range and equal four bytes
count as met twice, which lets a class through at most.) Only likely classes have buckets, and what
others hold of them is counted again among themselves. Texts that merely share lines or phrases with
others, whose number of pairs grows with the square of the corpus, end here.

Candidates. Under one order, two sets that link share a shingle in a short prefix of each, and
the first shingle they share has at least ``share = 75 / 175`` of both sizes summed at or behind
it in each set. So the smaller set has it in an even shorter prefix (it is ``short`` there). A
bucket holds the classes with a shingle in their prefix; buckets of a single class, or without a
short member, make no link. Buckets with the same members count once. A pair is compared only if
it can link: what its prefixes share (all of it lies in buckets) and what is left behind the
prefix that ends first reach the threshold together, and if what others hold of the two does: each
of both numbers is a bound on the overlap, and what they don't hold is part of the difference.

Leaders. All pairs of a bucket aren't needed, only its components. First every class is compared
with one leader: the first in leader order among the first short members of its buckets that fit its
size and can link with it. Linked components are contracted, and buckets within one component go; a
group of copies costs about one pair each. Leader order puts texts first of whose prefix the fewest
shingles are theirs alone: the text that others were copied from. Leaders and members meet by bucket
and size band; bands differ by one at most where the sizes allow a link.

The rest. What is left of a bucket of at most ``SMALL`` classes is compared pair by pair, which is in
proportion to the members. Larger buckets with the same leader are one cluster, so a large group
makes a few of them. Of a cluster, the classes outside its largest component are compared with all others
in blocks of at most ``BLOCK`` classes, of neighbouring bands: a block pair counts the overlaps of
all its pairs at once, a fragment at a time, as a product of 0/1 matrices (rare shingles one by one),
and returns a spanning forest of the links. No row is made per pair, so members of a large
group whose similarities lie just below the threshold cost a product each. So every pair that could
link two components is compared.

Vertical partitioning. The global order is cut into ``FRAGMENTS``; a set becomes one sorted
array per fragment, written once for the classes of the pairs. Each (pair, fragment) counts its
partial overlap on its own, and the partial counts are summed per pair and compared with the
threshold exactly; blocks do the same with whole matrices. A leader's fragments are sent once per ``LEADER_CHUNK`` of its classes.

Skew. The bucket of a hot shingle is spread by class (``SALTS``) and its leaders are broadcast (at
most HOT_SHINGLES buckets exist); any other bucket holds fewer rows than each hot one. Joins on a
class or component go through ``skew_safe_join``.

Defined results: a document without words (null, empty, white space) has no shingles and is
alone; one with fewer than five words has its whole word sequence as one shingle; rows with
a null doc_id link like others, and a component of such rows only has a null component_id;
repeated rows are in one class; very long texts and words are whole; extra columns are kept by
``one_of_each`` and not read otherwise, so their names may clash; an empty table gives no rows.
Words, shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertlake.llm.common import checked_broadcast, materialize, skew_safe_join
from pertlake.llm.graph import components
from pertlake.llm.text_hash import iter_documents, mix, window_hashes

SHINGLE = 5
PERCENT = 75
FRAGMENTS = 8  # the last one holds the hot shingles
HOT_SHINGLES = 1 << 17
HOT_LEAST = 32  # documents
SALTS = 16

FIRST_LEADERS = 2  # of a bucket
SMALL = 32  # classes of a bucket that are compared pair by pair
BLOCK = 1024  # classes of a block
BLOCK_SHINGLES = 1 << 20  # of a block, on average at most
LEADER_CHUNK = 256
PACKED = 1 << 20  # shingles packed at a time, and of a hash range on average
_NO_OWNER = (1 << 16) - 1
_MANY = (1 << 20) - 1


def prefix_length(n: int) -> int:
    return n - (n * PERCENT + 99) // 100 + 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of every document."""
    for rows, words, _, _ in iter_documents(batches, lower=True):
        at, all_runs, out = words.doc_words.tolist(), window_hashes(words.hashes, SHINGLE), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= SHINGLE:
                found = np.sort(all_runs[a : b - SHINGLE + 1])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                out.append(found[keep])
            else:  # the whole sequence as one shingle
                out.append(window_hashes(words.hashes[a:b], b - a) if b > a else words.hashes[:0])
        yield rows, out


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set: the mixed sum of its mixed hashes and its size."""
    sums = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
    return mix(sums)


def describe(texts: DataFrame) -> DataFrame:
    """doc_id, row_key, n, class of every row (class null where the set is empty)."""

    def rows_of(batches):
        for rows, sets in _sets(batches):
            n = np.array([len(s) for s in sets], np.int64)
            key = class_keys(sets)
            yield pa.record_batch(
                [rows.column(0), rows.column(2), pa.array(n), pa.array(key.view(np.int64), mask=n == 0)], names=["doc_id", "row_key", "n", "class"]
            )

    return texts.mapInArrow(rows_of, "doc_id long, row_key long, n long, class long")


def _first_of_class(sets: list[np.ndarray], seen: set[int]) -> tuple[list[int], list[int]]:
    """Places and class keys of the non-empty sets that this task has not met before."""
    places, keys = [], []
    for i, key in enumerate(class_keys(sets).tolist()):
        if len(sets[i]) and key not in seen:
            seen.add(key)
            places.append(i)
            keys.append(key)
    return places, keys


def hot_shingles(texts: DataFrame, least: int, most: int) -> np.ndarray:
    """The most frequent prefix shingles, rarest first: at most ``most``, whatever the corpus."""

    def prefixes(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches):
            places, _ = _first_of_class(sets, seen)
            yield pa.record_batch([_lists([sets[i][: prefix_length(len(sets[i]))] for i in places])], names=["shingles"])

    counts = (
        texts.mapInArrow(prefixes, "shingles array<long>").select(F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    )
    rows = counts.orderBy(F.desc("n"), "shingle").limit(most).collect()
    return np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)


def _packed(keys: list[int], sets: list[np.ndarray], chunk: int, parts: int) -> pa.RecordBatch:
    """part, chunk, prints, owners, sizes: the shingles of a chunk of classes by hash range.

    A shingle of several classes of the chunk is sent once and without an owner. The row of the
    chunk itself (part ``parts`` or more) holds the class keys, how many shingles of each are such, and their sizes.
    """
    size = np.array([len(s) for s in sets], np.int32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.append(True, flat[1:] != flat[:-1])
    single = first & np.append(first[1:], True)
    met = np.bincount(owner[~single], minlength=len(sets)).astype(np.int32)
    flat, owner = flat[first], np.where(single, owner, np.uint16(_NO_OWNER))[first]
    part = ((flat >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    prints = flat.astype(np.uint32)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.record_batch(
        [
            pa.array([int(part[a]) for a, _ in spans] + [parts + chunk % parts], pa.int32()),
            pa.array([chunk] * (len(spans) + 1), pa.int64()),
            pa.array([prints[a:b].tobytes() for a, b in spans] + [np.array(keys, np.uint64).tobytes()], pa.binary()),
            pa.array([owner[a:b].tobytes() for a, b in spans] + [met.tobytes()], pa.binary()),
            pa.array([None] * len(spans) + [size.tobytes()], pa.binary()),
        ],
        names=["part", "chunk", "prints", "owners", "sizes"],
    )


def held_counts(texts: DataFrame, n_shingles: int) -> DataFrame:
    """class, n, held (how many of its shingles other classes hold too, or more) of every class."""
    parts = n_shingles // PACKED + 1
    packed_schema = "part int, chunk long, prints binary, owners binary, sizes binary"

    def pack(batches):
        seen: set[int] = set()
        chunk, keys, sets, size = TaskContext.get().partitionId() << 32, [], [], 0
        for _, found in _sets(batches):
            for place, key in zip(*_first_of_class(found, seen), strict=True):
                keys.append(key)
                sets.append(found[place])
                size += len(found[place])
                if size >= PACKED or len(sets) == _NO_OWNER:
                    yield _packed(keys, sets, chunk, parts)
                    chunk, keys, sets, size = chunk + 1, [], [], 0
        if sets:
            yield _packed(keys, sets, chunk, parts)

    def meet(group: pa.Table) -> pa.Table:
        """The rows of chunks as they are; of a hash range, the owners of the shingles met twice."""
        group = group.combine_chunks()
        if group["part"][0].as_py() >= parts:
            return group
        prints = [np.frombuffer(x.as_buffer(), np.uint32) for x in group["prints"]]
        flat = np.concatenate(prints)
        order = np.argsort(flat)
        same = flat[order][1:] == flat[order][:-1]
        met = np.zeros(len(flat), bool)
        met[order[1:][same]] = True
        met[order[:-1][same]] = True
        ends, owners = np.cumsum([0, *map(len, prints)]), []
        for a, b, x in zip(ends[:-1], ends[1:], group["owners"], strict=True):
            owner = np.frombuffer(x.as_buffer(), np.uint16)[met[a:b]]
            owners.append(owner[owner != _NO_OWNER].tobytes())
        none = pa.nulls(len(group), pa.binary())
        out = pa.table([group["part"], group["chunk"], none, pa.array(owners, pa.binary()), none], names=group.column_names)
        return out.filter(pa.array([len(x) > 0 for x in owners]))

    def count(group: pa.Table) -> pa.Table:
        keys = size = met = None
        owners = []
        for row in group.select(["prints", "owners", "sizes"]).to_pylist():
            if row["sizes"] is None:
                owners.append(np.frombuffer(row["owners"], np.uint16))
            else:
                keys, met, size = np.frombuffer(row["prints"], np.int64), np.frombuffer(row["owners"], np.int32), np.frombuffer(row["sizes"], np.int32)
        held = met + np.bincount(np.concatenate([np.empty(0, np.uint16), *owners]), minlength=len(keys)).astype(np.int32)
        return pa.table([pa.array(keys), pa.array(size), pa.array(held)], names=["class", "n", "held"])

    met = texts.mapInArrow(pack, packed_schema).groupBy("part").applyInArrow(meet, packed_schema)
    counts = met.groupBy("chunk").applyInArrow(count, "class long, n int, held int")
    # a class may be there once per input task
    return counts.groupBy("class").agg(F.max("n").alias("n"), F.max("held").alias("held"))


def likely_classes(texts: DataFrame, one: DataFrame, n_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The texts (one of each class, with its copies in id and text) of the classes that can link, and class, held of those."""
    enough = F.col("held").cast("long") * 100 >= F.col("n").cast("long") * PERCENT
    first = materialize(held_counts(texts, n_shingles).filter(enough).join(one, "class"), "op9-first")
    n_first, n_left = first.agg(F.count(F.lit(1)), F.sum("n")).first()
    side = checked_broadcast(first.select("row_key"), n_first)
    texts = materialize(texts.join(side, "row_key", "left_semi").select(*texts.columns), "op9-texts")
    return texts, materialize(held_counts(texts, n_left or 0).filter(enough).select("class", "held"), "op9-likely")


def _ranks(hot: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """shingles -> place among the hot ones (-1: not hot)."""
    order = np.argsort(hot)
    ordered = hot[order]

    def rank(shingles: np.ndarray) -> np.ndarray:
        if not len(ordered):
            return np.full(len(shingles), -1)
        at = np.minimum(np.searchsorted(ordered, shingles), len(ordered) - 1)
        return np.where(ordered[at] == shingles, order[at], -1)

    return rank


def _members(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """shingle, hot, class, n, rest (shingles at or behind it), end (the place of the prefix's last shingle in
    the global order): the prefixes of the classes of every task."""

    def prefixes(batches):
        rank, seen = _ranks(hot), set()
        for _, sets in _sets(batches):
            places, keys = _first_of_class(sets, seen)
            out, cold, ends = [], [], []
            for i in places:
                r = rank(sets[i])
                is_hot = r >= 0
                ordered = np.concatenate([sets[i][~is_hot], sets[i][is_hot][np.argsort(r[is_hot])]])
                n_cold = int((~is_hot).sum())
                out.append(ordered[: prefix_length(len(ordered))])
                cold.append(n_cold)
                # cold shingles in the order of their hash, as a signed number, then the hot ones
                last = len(out[-1]) - 1
                ends.append(int(out[-1][-1]) - 2**63 if last < n_cold else 2**63 - 1 - len(hot) + int(np.sort(r[is_hot])[last - n_cold]))
            yield pa.record_batch(
                [_long(keys), pa.array([len(sets[i]) for i in places], pa.int32()), pa.array(cold, pa.int32()), pa.array(ends, pa.int64()), _lists(out)],
                names=["class", "n", "cold", "end", "shingles"],
            )

    rows = texts.mapInArrow(prefixes, "class long, n int, cold int, end long, shingles array<long>")
    return rows.select("class", "n", "cold", "end", F.posexplode("shingles").alias("place", "shingle")).select(
        "shingle", (F.col("place") >= F.col("cold")).alias("hot"), "class", "n", (F.col("n") - F.col("place")).alias("rest"), "end"
    )


def _is_short(n: str, rest: str) -> Column:
    return F.col(rest).cast("long") * (100 + PERCENT) >= F.col(n).cast("long") * (2 * PERCENT)


def buckets(texts: DataFrame, hot: np.ndarray, likely: DataFrame) -> DataFrame:
    """bucket, able, hot, class, n, end, rest, shingles, shared, held: the members of the buckets of two ``likely`` classes or more.

    A bucket stands for the ``shingles`` that the same classes hold; ``rest`` belongs to the first
    of them. Only ``able`` buckets, with a short member, can be the first that a linked pair shares.
    ``shared`` counts the class's prefix shingles that are in a bucket. ``held`` is what others hold of the class
    without its shingles in buckets ahead of this one: if this is the first bucket of a pair, they lie in no overlap.
    """
    n_likely = likely.count()
    members = _members(texts, hot).join(checked_broadcast(likely.select("class"), n_likely), "class", "left_semi")
    members = members.withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("class"), F.lit(SALTS))).otherwise(0).cast("int"))
    part = Window.partitionBy("shingle", "salt")
    met = members.withColumn("low", F.min("class").over(part)).withColumn("high", F.max("class").over(part))
    # of a class, every input task may have sent one row
    met = materialize(met.filter("hot or low != high").drop("low", "high").distinct(), "op9-met")
    # hot ones, at most HOT_SHINGLES, over all their salts
    short = _is_short("n", "rest")
    many = (
        met.filter("hot").groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(short).alias("able"))
        .filter("low != high").select("shingle", "able")
    )
    same = F.xxhash64(*[F.bit_xor(F.xxhash64(F.lit(seed), "class")).over(part) for seed in (1, 2)])
    cold = met.filter("not hot").select(same.alias("bucket"), F.max(short).over(part).alias("able"), "hot", "class", "n", "end", "rest")
    spread = met.filter("hot").join(F.broadcast(many), "shingle").select(F.xxhash64("shingle").alias("bucket"), "able", "hot", "class", "n", "end", "rest")
    ahead = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("rest"))) - 1
    kept = cold.unionByName(spread).withColumn("ahead", ahead).groupBy("bucket", "hot", "class", "n", "end").agg(
        F.max("able").alias("able"), F.max("rest").alias("rest"), F.min("ahead").alias("ahead"), F.count(F.lit(1)).alias("shingles")
    )
    kept = materialize(kept, "op9-buckets")
    shared = kept.groupBy("class").agg(F.sum("shingles").alias("shared")).join(checked_broadcast(likely, n_likely), "class")
    return kept.join(shared, "class").withColumn("held", F.col("held") - F.col("ahead")).drop("ahead")


def set_parts(texts: DataFrame, hot: np.ndarray, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """class, parts (a sorted array per fragment) of the wanted classes, each from its ``row_key``."""

    def cut(batches):
        rank = _ranks(hot)
        width = np.uint64((2**64 - 1) // (FRAGMENTS - 1) + 1)
        for rows, sets in _sets(batches):
            places, keys, out = [i for i, s in enumerate(sets) if len(s)], class_keys(sets), []
            for i in places:
                s = sets[i]
                is_hot = rank(s) >= 0
                cold = s[~is_hot]
                ends = np.searchsorted(cold // width, np.arange(FRAGMENTS), "left")
                out.append([*(cold[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), s[is_hot]])
            for a in range(0, len(places), 256):
                flat = [x for parts in out[a : a + 256] for x in parts]
                offsets = pa.array(np.arange(0, len(flat) + 1, FRAGMENTS, dtype=np.int32))
                key = rows.column(2).take(pa.array(places[a : a + 256], pa.int64()))
                yield pa.record_batch([_long(keys[places[a : a + 256]]), key, pa.ListArray.from_arrays(offsets, _lists(flat))], names=["class", "row_key", "parts"])

    rows = texts.mapInArrow(cut, "class long, row_key long, parts array<array<long>>")
    return rows.join(checked_broadcast(wanted, n_wanted), ["class", "row_key"], "left_semi").select("class", "parts")


def fragments(texts: DataFrame, hot: np.ndarray, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """class, fragment, shingles (sorted array) of the wanted classes, each from its ``row_key``."""
    return set_parts(texts, hot, wanted, n_wanted).select("class", F.posexplode("parts").alias("fragment", "shingles"))


def overlaps(pairs: DataFrame, n_pairs: int, sets: DataFrame) -> DataFrame:
    """``pairs`` (class, leader, ...) with ``shared``, their summed partial overlaps."""
    # few leaders have more classes than a chunk: at most n_pairs / LEADER_CHUNK
    many = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > LEADER_CHUNK)
    parts = F.floor((F.col("classes") - 1) / LEADER_CHUNK) + 1
    dealt = pairs.join(checked_broadcast(many, n_pairs // LEADER_CHUNK), "leader", "left").withColumn(
        "chunk", F.coalesce(F.pmod(F.xxhash64("class"), parts), F.lit(0))
    ).drop("classes")
    side = checked_broadcast(dealt.select("class", "leader", "chunk"), n_pairs)
    of_class = sets.join(side, "class").select("leader", "chunk", "fragment", "class", F.col("shingles").alias("of_class"))
    led = dealt.select("leader", "chunk").distinct()
    of_leader = sets.withColumnRenamed("class", "leader").join(checked_broadcast(led, n_pairs), "leader").select(
        "leader", "chunk", "fragment", F.col("shingles").alias("of_leader")
    )
    partial = of_class.join(of_leader, ["leader", "chunk", "fragment"]).select(
        "class", "leader", "fragment", F.size(F.array_intersect("of_class", "of_leader")).cast("long").alias("part")
    )
    # a class may be there twice (repeated rows): the same partial count, to be taken once
    total = partial.groupBy("class", "leader", "fragment").agg(F.max("part").alias("part")).groupBy("class", "leader").agg(F.sum("part").alias("shared"))
    return dealt.drop("chunk").join(total, ["class", "leader"])


def _bands(n: str) -> Column:
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / PERCENT))).cast("int")


def _enough(most: Column) -> Column:
    """Can an overlap of ``most`` reach the threshold for sizes n and n_l?"""
    return most.cast("long") * (100 + PERCENT) >= (F.col("n") + F.col("n_l")).cast("long") * PERCENT


def _near_enough() -> Column:
    """Does what no other class holds of the two leave their symmetric difference small enough?"""
    both = (F.col("n") + F.col("n_l")).cast("long")
    return (both - F.col("held") - F.col("held_l")) * (100 + PERCENT) <= both * (100 - PERCENT)


def _behind_first() -> Column:
    """The number of shingles behind the prefix that ends first in the global order.

    What a pair shares up to there lies in both prefixes; what it shares behind, in this rest.
    """
    behind = lambda n: F.ceil(F.col(n) * PERCENT / 100) - 1
    return F.when(F.col("end") < F.col("end_l"), behind("n")).when(F.col("end") > F.col("end_l"), behind("n_l")).otherwise(F.least(behind("n"), behind("n_l")))


def _possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs whose overlap can reach the threshold, by all the shingles that their prefixes share."""
    left = lists.select("class", F.col("buckets").alias("of_class"))
    right = lists.select(F.col("class").alias("leader"), F.col("buckets").alias("of_leader"))
    number = lambda x: F.when(x.bitwiseAND(F.lit(_MANY)) == _MANY, F.lit(1 << 40)).otherwise(x.bitwiseAND(F.lit(_MANY)))
    shared = F.aggregate(F.array_intersect("of_class", "of_leader"), F.lit(0).cast("long"), lambda a, x: a + number(x).cast("long"))
    return pairs.join(left, "class").join(right, "leader").filter(_enough(shared + _behind_first())).drop("of_class", "of_leader", "end", "end_l")


def _candidates(state: DataFrame, most: int, n_hot: int) -> DataFrame:
    """class, leader, own_l, n, n_l, end, end_l, component, component_l: members and the first ``most`` short members of a bucket and size band."""
    place = Window.partitionBy("bucket", "band").orderBy("own", "class")
    short = state.filter(_is_short("n", "rest")).withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    leaders = short.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= most).select(
        "bucket", "hot", "band", F.col("class").alias("leader"), *[F.col(c).alias(f"{c}_l") for c in ("n", "end", "rest", "shared", "held", "own", "component")]
    )
    fits = (F.col("component") != F.col("component_l")) & (F.least("n", "n_l") * 100 >= F.greatest("n", "n_l") * PERCENT)
    fits = fits & _enough(F.least("held", "held_l")) & _near_enough()
    fits = fits & _enough(F.least("rest", "rest_l")) & _enough(F.least("shared", "shared_l") + _behind_first())

    def met(members: DataFrame, led: DataFrame) -> DataFrame:
        m, d = members.alias("m"), led.drop("hot").alias("d")
        on = (F.col("m.bucket") == F.col("d.bucket")) & (F.col("m.band") == F.col("d.band")) & fits
        return m.join(d, on).select("class", "leader", "own_l", "n", "n_l", "end", "end_l", "component", "component_l")

    out = met(state.filter("not hot"), leaders.filter("not hot"))
    if n_hot:
        out = out.unionByName(met(state.filter("hot"), checked_broadcast(leaders.filter("hot"), 3 * n_hot)))
    return out.distinct()


def _untested(candidates: DataFrame, tested: DataFrame | None) -> DataFrame:
    if tested is not None:
        for a, b in (("class", "leader"), ("leader", "class")):
            done = tested.select(F.col(a).alias("class"), F.col(b).alias("leader"))
            candidates = candidates.join(done, ["class", "leader"], "left_anti")
    return candidates


def _first_per_class(candidates: DataFrame, pairs: int | None) -> DataFrame:
    """The first ``pairs`` candidates of every class in leader order (None: all), each pair once."""
    order = Window.partitionBy("class").orderBy("own_l", "leader")
    first = candidates.drop("own_l") if pairs is None else candidates.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= pairs).drop("nth", "own_l")
    # two classes may have chosen each other
    back = first.select(F.col("leader").alias("class"), F.col("class").alias("leader"))
    return first.filter("class < leader").unionByName(first.filter("class > leader").join(back.filter("class > leader"), ["class", "leader"], "left_anti"))


def _unsettled(state: DataFrame) -> DataFrame:
    """``state`` without the buckets that lie in one component."""
    mixed = state.groupBy("bucket", "hot").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("bucket", "hot")
    cold = state.filter("not hot").join(mixed.filter("not hot").select("bucket"), "bucket", "left_semi")
    # at most HOT_SHINGLES rows
    return cold.unionByName(state.filter("hot").join(F.broadcast(mixed.filter("hot").select("bucket")), "bucket", "left_semi"))


def clusters(state: DataFrame, large: DataFrame) -> DataFrame:
    """cluster, band, query, chunk, class, n, component: the classes of the ``large`` buckets, dealt to blocks.

    A cluster is named by the leader of its buckets. Classes outside its largest component are its queries.
    """
    met = materialize(state.join(large, "bucket").select("cluster", "band", "class", "n", "component").distinct(), "op9-met")
    counted = met.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("classes"))
    main = counted.groupBy("cluster").agg(
        F.max_by("component", F.struct("classes", "component")).alias("main"), F.max("classes").alias("most"), F.sum("classes").alias("classes")
    )
    main = materialize(main.filter("most < classes").select("cluster", "main"), "op9-main")
    met = met.join(checked_broadcast(main, main.count()), "cluster").withColumn("query", F.col("component") != F.col("main")).drop("main")
    blocks = met.groupBy("cluster", "band", "query").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("long").alias("blocks")
    )
    blocks = materialize(blocks, "op9-blocks")
    dealt = met.join(checked_broadcast(blocks, blocks.count()), ["cluster", "band", "query"])
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).drop("blocks")


def block_pairs(dealt: DataFrame) -> DataFrame:
    """cluster, band, chunk (of queries), query_r, band_r, chunk_r: the blocks to compare, each two once."""
    blocks = materialize(dealt.groupBy("cluster", "band", "query", "chunk").agg(F.count(F.lit(1)).alias("classes")), "op9-blocks")
    right = blocks.select("cluster", *[F.col(c).alias(f"{c}_r") for c in ("query", "band", "chunk")])
    left = blocks.filter("query").select("cluster", "band", "chunk", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band_r"))
    once = ~F.col("query_r") | (F.struct("band", "chunk") <= F.struct(F.col("band_r").alias("band"), F.col("chunk_r").alias("chunk")))
    return left.join(right, ["cluster", "band_r"]).filter(once)


def _partial_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets share: (left, right)."""
    n_left, n_right = len(left), len(right)
    out = np.zeros(n_left * n_right, np.int32)
    both, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    sides = []
    for sets, at in ((left, place[:cut]), (right, place[cut:])):
        order = np.argsort(at, kind="stable")
        sides.append((at[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], np.bincount(at, minlength=len(both))))
    (at_l, own_l, count_l), (at_r, own_r, count_r) = sides
    # a column of the product costs as much as about n_left * n_right / 256 pairs one by one
    pairs = count_l * count_r
    dense = pairs * 256 > n_left * n_right
    column = np.cumsum(dense) - 1
    is_l, is_r = dense[at_l], dense[at_r]
    col_l, col_r = column[at_l[is_l]], column[at_r[is_r]]
    for a in range(0, int(dense.sum()), 1024):
        x, y = np.zeros((n_left, 1024), np.float32), np.zeros((n_right, 1024), np.float32)
        for m, own, col in ((x, own_l[is_l], col_l), (y, own_r[is_r], col_r)):
            part = slice(*np.searchsorted(col, [a, a + 1024]))
            m[own[part], col[part] - a] = 1
        out += (x @ y.T).astype(np.int32).ravel()
    rare = ~is_l & (count_r[at_l] > 0)
    at, own = at_l[rare], own_l[rare]
    starts, sizes = (np.cumsum(count_r) - count_r)[at], count_r[at]
    ends = np.cumsum(sizes)
    for a in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
        # the pairs numbered from a on, each with its row of the left side
        number = np.arange(a, min(a + (1 << 20), int(ends[-1])))
        row = np.searchsorted(ends, number, "right")
        out += np.bincount(own[row] * n_right + own_r[starts[row] + number - (ends - sizes)[row]], minlength=len(out)).astype(np.int32)
    return out.reshape(n_left, n_right)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of a spanning forest of the links between rows and columns."""
    out, new = [], (np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool))
    for row in np.flatnonzero(linked.any(axis=1)).tolist():
        if not new[0][row]:
            continue
        new[0][row] = False
        open_nodes = [(0, row)]
        while open_nodes:
            side, x = open_nodes.pop()
            found = np.flatnonzero((linked[:, x] if side else linked[x]) & new[1 - side])
            new[1 - side][found] = False
            out += [(y, x) if side else (x, y) for y in found.tolist()]
            open_nodes += [(1 - side, y) for y in found.tolist()]
    return out


def _block_links(group: pa.Table) -> pa.Table:
    """a, b: a spanning forest of the links between the components of two blocks."""
    group = group.combine_chunks()
    # a class may be there twice (repeated rows)
    at = np.unique(np.stack([group["side"].to_numpy(), group["class"].to_numpy()]), axis=1, return_index=True)[1]
    side, n, component = (group[c].to_numpy()[at] for c in ("side", "n", "component"))
    parts = group["parts"].combine_chunks()
    parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
    inner = parts.values
    first, ends, flat = parts.offsets.to_numpy()[at], inner.offsets.to_numpy(), inner.values.to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):  # a block with itself
        right = left
    shared = np.zeros((len(left), len(right)), np.int64)
    for fragment in range(FRAGMENTS):
        of = lambda rows: [flat[ends[k] : ends[k + 1]] for k in (first[rows] + fragment).tolist()]  # noqa: B023, E731
        shared += _partial_overlaps(of(left), of(right))
    linked = (shared * 100 >= (n[left][:, None] + n[right][None, :] - shared) * PERCENT) & (component[left][:, None] != component[right][None, :])
    found = _forest(linked)
    return pa.table([pa.array([int(component[left[i]]) for i, _ in found], pa.int64()), pa.array([int(component[right[j]]) for _, j in found], pa.int64())], names=["a", "b"])


def cluster_links(state: DataFrame, large: DataFrame, texts: DataFrame, hot: np.ndarray, one: DataFrame) -> DataFrame:
    """a, b: links that join the components of all classes of ``large`` buckets that link."""
    dealt = materialize(clusters(state, large), "op9-clusters")
    pairs = materialize(block_pairs(dealt), "op9-block-pairs")
    side = checked_broadcast(pairs, pairs.count())
    key, columns = ["cluster", "band", "chunk", "query_r", "band_r", "chunk_r"], ["class", F.col("n").cast("long").alias("n"), "component"]
    mine = dealt.filter("query").drop("query").join(side, ["cluster", "band", "chunk"]).select(*key, F.lit(0).cast("long").alias("side"), *columns)
    theirs = dealt.select("cluster", *[F.col(c).alias(f"{c}_r") for c in ("query", "band", "chunk")], "class", "n", "component")
    theirs = theirs.join(side, ["cluster", "query_r", "band_r", "chunk_r"]).filter("not query_r or band != band_r or chunk != chunk_r")
    met = materialize(mine.unionByName(theirs.select(*key, F.lit(1).cast("long").alias("side"), *columns)), "op9-sides")
    wanted = materialize(met.select("class").distinct().join(one, "class"), "op9-wanted")
    parts = materialize(set_parts(texts, hot, wanted, wanted.count()), "op9-parts")
    blocks = parts.join(checked_broadcast(met, met.count()), "class").groupBy(*key)
    return blocks.applyInArrow(_block_links, "a long, b long")


def linked_classes(texts: DataFrame, rows: DataFrame, hot_least: int = HOT_LEAST, hot_most: int = HOT_SHINGLES) -> DataFrame:
    """(node, component) of the classes that share a bucket; ``rows`` is ``describe(texts)``."""
    one = rows.filter("class is not null").groupBy("class").agg(F.min("row_key").alias("row_key"))
    texts, likely = likely_classes(texts, one, rows.agg(F.sum("n")).first()[0] or 0)
    hot = hot_shingles(texts, hot_least, hot_most)
    members = materialize(buckets(texts, hot, likely), "op9-members")
    able = members.filter("able").filter(F.col("held") * 100 >= F.col("n").cast("long") * PERCENT)
    able = able.withColumn("own", (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - F.col("shared")).cast("int"))
    labels = materialize(able.select(F.col("class").alias("node"), F.col("class").alias("component")).distinct(), "op9-labels")
    if labels.isEmpty():
        return labels
    n_hot = members.filter("hot").count()
    # a bucket and its number of shingles as one number; a number beyond 20 bits counts as more than any set has
    packed = F.col("bucket").bitwiseAND(F.lit(~_MANY)).bitwiseOR(F.least("shingles", F.lit(_MANY)))
    lists = materialize(members.groupBy("class").agg(F.collect_list(packed).alias("buckets")), "op9-lists")
    state = materialize(able.drop("able", "shingles").withColumn("band", _bands("n")).withColumn("component", F.col("class")), "op9-state")

    def compared(state: DataFrame, leaders: int, pairs: int | None, tested: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The pairs compared, and a, b: the links among them (None: no pair)."""
        found = materialize(_possible(_untested(_candidates(state, leaders, n_hot), tested), lists), "op9-found")
        chosen = materialize(_first_per_class(found, pairs), "op9-pairs")
        n_pairs = chosen.count()
        if not n_pairs:
            return chosen, None
        wanted = chosen.select("class").unionByName(chosen.select(F.col("leader").alias("class"))).distinct()
        wanted = materialize(wanted.join(one, "class"), "op9-wanted")
        sets = materialize(fragments(texts, hot, wanted, wanted.count()), "op9-sets")
        enough = F.col("shared") * 100 >= PERCENT * (F.col("n") + F.col("n_l") - F.col("shared"))
        links = overlaps(chosen, n_pairs, sets).filter(enough).select(F.col("component").alias("a"), F.col("component_l").alias("b"))
        return chosen, materialize(links, "op9-links")

    def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
        joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        return materialize(skew_safe_join(labels, joined, "component").select("node", F.coalesce("joined", "component").alias("component")), "op9-labels")

    tested, links = compared(state, FIRST_LEADERS, 1, None)
    if links is not None and not links.isEmpty():
        labels = contracted(labels, links)
        state = state.drop("component").join(labels, state["class"] == labels["node"]).drop("node")
        state = materialize(_unsettled(state), "op9-state")
    sizes = state.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "class")).alias("leader"))
    large = materialize(sizes.filter(F.col("size") > SMALL).select("bucket", F.col("leader.class").alias("cluster")), "op9-large")
    n_large = large.count()
    side = checked_broadcast(large, n_large)
    _, links = compared(state.join(side.select("bucket"), "bucket", "left_anti") if n_large else state, SMALL, None, tested)
    if n_large:
        met = materialize(cluster_links(state, side, texts, hot, one), "op9-links")
        links = met if links is None else links.unionByName(met)
    return labels if links is None or links.isEmpty() else contracted(labels, links)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key")
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, **order) -> DataFrame:
    """doc_id, row_key, n_shingles, component (null without shingles) of every row."""
    texts = _texts(docs, id_col, text_col)
    rows = materialize(describe(texts), "op9-rows")
    labels = linked_classes(texts, rows, **order).withColumnRenamed("node", "class")
    return skew_safe_join(rows, labels, "class").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **order) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id of every row."""
    placed = _placed(docs, id_col, text_col, **order)
    lowest = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return skew_safe_join(placed, lowest, "component").select(
        "doc_id", "row_key", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component one, with the smallest doc_id (null last), then row_key."""
    placed = _placed(docs, id_col, text_col).filter("component is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    stays = placed.groupBy("component").agg(F.min(rank).alias("first")).select("component", F.col("first.row_key").alias("stays"))
    counted = placed.groupBy("component", "row_key").agg(F.count(F.lit(1)).alias("rows"))
    odd = materialize(
        skew_safe_join(counted, stays, "component").filter("row_key != stays or rows > 1")
        .select(F.col("row_key").alias("__odd"), (F.col("row_key") == F.col("stays")).alias("__stays")),
        "op9-gone",
    )
    key = F.xxhash64(docs[id_col], docs[text_col])
    side = checked_broadcast(odd, odd.count())
    out = docs.join(side, key == side["__odd"], "left_anti")
    twice = side.filter("__stays")  # rows of one id and text: one of them stays
    if twice.isEmpty():
        return out
    again = docs.withColumn("__key", key).join(twice, F.col("__key") == twice["__odd"], "left_semi")
    return out.unionByName(again.dropDuplicates(["__key"]).drop("__key"))
