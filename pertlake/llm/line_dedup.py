"""Operator 11, line dedup with a sharded minimal perfect hash.

A line's key is the line without white space at both ends, A-Z lower-cased. A key of at
least ``min_chars`` code points that at least two documents hold loses all its lines, except
those of the document with the smallest doc_id.

1. Every document sends the 128-bit digest of each of its distinct keys once; the digests are
   counted with a partial aggregate (number of documents, smallest and largest doc_id). What
   one document alone holds is dropped here.
2. The remaining digests are cut into shards of about ``SHARD_KEYS`` by their first half. Each
   shard becomes a minimal perfect hash (levels of bits, in which a key owns a bit alone, and
   the rank of that bit) over compact arrays: fingerprint (the digest's second half), count and
   smallest doc_id. The shards are rows of a table.
3. Documents probe the arrays: the probes (digest and document, never a line) are dealt by
   shard and sorted behind the shard's row, so a task holds the arrays of one shard and one
   batch of probes, whatever the number of probes. The most frequent keys, at most
   ``HOT_PARTS`` by definition, form one shard of their own that every task holds; their probes
   are answered where the document is read, so no line is too frequent for a shard.
4. A document gets the digests that it loses, and is cut.

Defined results: a null text is one empty line, which stays, as does every line whose key is
shorter than ``min_chars``; rows that repeat a doc_id count as one document, and so do all
rows without one, which comes after all others (as if its id were 2^63 - 1); repeated rows get
the same result each; very long texts and lines are whole (a line is hashed as one slice of
the text's own buffer); columns besides id and text are not read, so their names can't clash;
an empty table gives no rows. Two keys count as equal if their 128-bit digests are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import materialize
from pertlake.llm.text_hash import mix

MIN_CHARS = 10
SHARD_KEYS = 8_192
HOT_PARTS = 4_096  # a key held more than 1 / HOT_PARTS of all counted times is hot
NO_ID = 2**63 - 1
SPACES = " \t\n\x0b\x0c\r"

# bits of a level per key that is still without a place; the last keys stand in a sorted list
_GAMMA = 2
_LEVELS = 24
_BATCH_BYTES = 8_000_000


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: ``place`` maps the n keys onto 0 .. n - 1.

    Level by level every key without a place asks for one bit of an array; those that are alone
    there own it. A key's place is the number of owned bits before its own. Other keys get any
    place or -1, so the caller compares fingerprints.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self._ranks, before = [], 0
        for bits in levels:
            ends = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self._ranks.append(np.concatenate(([0], ends)) + before)
            before += int(ends[-1]) if len(ends) else 0
        self._before_rest = before

    @staticmethod
    def _bits(keys: np.ndarray, level: int, n_words: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) % 2**64)
        return mix(keys ^ seed) % np.uint64(64 * n_words)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < _LEVELS:
            n_words = max(1, -(-_GAMMA * len(left) // 64))
            at = cls._bits(left, len(levels), n_words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * n_words)[at.astype(np.int64)] == 1
            bits, own = np.zeros(n_words, np.uint64), at[alone]
            np.bitwise_or.at(bits, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            levels.append(bits)
            left = left[~alone]
        return cls(levels, np.sort(left))

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self._ranks, strict=True)):
            at = self._bits(keys[open_], level, len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            own = (bits[word] & bit) != 0
            out[open_[own]] = ranks[word[own]] + np.bitwise_count(bits[word[own]] & (bit[own] - np.uint64(1)))
            open_ = open_[~own]
            if not len(open_):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == keys[open_], self._before_rest + at, -1)
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], np.int64)
        return b"".join([head.tobytes(), *(b.tobytes() for b in self.levels), self.rest.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n_levels, n_rest = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, int(n_levels), 16)
        body = np.frombuffer(data, np.uint64, offset=16 + 8 * int(n_levels))
        ends = np.cumsum([0, *sizes])
        return cls([body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], body[ends[-1] : ends[-1] + n_rest])


class Shard:
    """Fingerprint, count and smallest doc_id arrays, indexed by a minimal perfect hash.

    The hash is over first halves. Where two digests agree in that half only, the later one is
    ``extra``: its values stand behind those of the hash, with its first half beside them.
    """

    def __init__(self, index: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, lowest: np.ndarray, extra: np.ndarray):
        self.index, self.fingerprints, self.counts, self.lowest, self.extra = index, fingerprints, counts, lowest, extra

    @classmethod
    def of(cls, key: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, lowest: np.ndarray) -> Shard:
        first = np.unique(key, return_index=True)[1]
        index = PerfectHash.of(key[first])
        order = np.empty(len(first), np.int64)
        order[index.place(key[first])] = first
        extra = np.setdiff1d(np.arange(len(key)), first)
        order = np.concatenate((order, extra))
        return cls(index, fingerprint[order], np.minimum(count[order], 2**32 - 1).astype(np.uint32), lowest[order], key[extra])

    def found(self, key: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is the probe's key in the shard, its smallest doc_id)."""
        if not len(self.fingerprints):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        place = self.index.place(key)
        for i, other in enumerate(self.extra, len(self.fingerprints) - len(self.extra)):
            place[(key == other) & (fingerprint == self.fingerprints[i])] = i
        hit = (place >= 0) & (self.fingerprints[place] == fingerprint)
        return hit, self.lowest[place]

    def dump(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        return self.index.dump(), *(x.tobytes() for x in (self.fingerprints, self.counts, self.lowest, self.extra))

    @classmethod
    def load(cls, bits: bytes, fingerprints: bytes, counts: bytes, lowest: bytes, extra: bytes) -> Shard:
        types = (np.uint64, np.uint32, np.int64, np.uint64)
        return cls(PerfectHash.load(bits), *(np.frombuffer(x, t) for x, t in zip((fingerprints, counts, lowest, extra), types, strict=True)))


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``_BATCH_BYTES`` (a longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, done + _BATCH_BYTES, "right")))
        yield first, last
        first, done = last, int(ends[last - 1])


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first line of every text, all lines)."""
    parts = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    return parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64) - parts.offsets[0].as_py(), parts.flatten()


def _digests(lines: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lines whose key is long enough, their 128-bit digests as two words)."""
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=SPACES))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    digest = xxhash.xxh3_128_digest
    joined = b"".join(map(digest, keys.take(pa.array(at)).cast(pa.large_binary()).to_pylist()))
    return at, np.frombuffer(joined, np.uint64).reshape(-1, 2)


def _distinct(doc: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Places of the first line of every (document, digest)."""
    order = np.lexsort((digests[:, 1], digests[:, 0], doc))
    d, k = doc[order], digests[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]).any(axis=1)
    return order[new]


def _documents(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, document of every key, its digest), each key once a document; the text is column 0."""
    for batch in batches:
        for a, b in _runs(batch.column(0)):
            rows = batch.slice(a, b - a)
            starts, lines = _lines(rows.column(0))
            at, digests = _digests(lines, min_chars)
            doc = np.searchsorted(starts, at, "right") - 1
            first = _distinct(doc, digests)
            yield rows, doc[first], digests[first]


def _words(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def line_counts(texts: DataFrame, min_chars: int) -> DataFrame:
    """key, fingerprint, n, lowest of the line digests that at least two documents hold."""

    def held(batches):
        for rows, doc, digests in _documents(batches, min_chars):
            ids = rows.column(1).to_numpy(zero_copy_only=False)[doc]
            # the partial aggregate of a run of documents, before the JVM's own
            order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
            k, i = digests[order], ids[order]
            head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(order) else np.empty(0, np.int64)
            tail = np.r_[head[1:], len(order)] if len(order) else head
            yield pa.record_batch(
                [_words(k[head, 0]), _words(k[head, 1]), pa.array(tail - head), _words(i[head]), _words(i[tail - 1])],
                names=["key", "fingerprint", "n", "lowest", "highest"],
            )

    counts = texts.select("text", "id").mapInArrow(held, "key long, fingerprint long, n long, lowest long, highest long")
    return counts.groupBy("key", "fingerprint").agg(
        F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest")
    ).filter("lowest != highest").drop("highest")


def _shard_of(key: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(key) % np.uint64(n_shards)).astype(np.int64)


_ARRAYS = ["bits", "fingerprints", "counts", "lowest", "extra"]


def build_shards(counted: DataFrame, n_shards: int) -> DataFrame:
    """shard and its arrays."""

    def dealt(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.record_batch([pa.array(_shard_of(key, n_shards)), *batch.columns], names=["shard", "key", "fingerprint", "n", "lowest"])

    def built(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        shard = Shard.of(column("key").view(np.uint64), column("fingerprint").view(np.uint64), column("n"), column("lowest"))
        return pa.table([pa.array([column("shard")[0]]), *(pa.array([x], pa.binary()) for x in shard.dump())],
                        names=["shard", *_ARRAYS])

    rows = counted.select("key", "fingerprint", "n", "lowest").mapInArrow(dealt, "shard long, key long, fingerprint long, n long, lowest long")
    return rows.groupBy("shard").applyInArrow(built, "shard long, " + ", ".join(f"{c} binary" for c in _ARRAYS))


_PROBE = "shard long, id long, text_a long, text_b long, key long, fingerprint long, lost boolean"


def _probes(texts: DataFrame, hot, n_shards: int, min_chars: int) -> DataFrame:
    """One row per document and digest: what the hot shard answers (kept out unless lost), and the probes of the others."""

    def probed(batches):
        known = Shard.load(*hot.value)
        for rows, doc, digests in _documents(batches, min_chars):
            ids, a, b = (rows.column(c).to_numpy(zero_copy_only=False)[doc] for c in (1, 2, 3))
            key, fingerprint = digests[:, 0].copy(), digests[:, 1].copy()
            hit, lowest = known.found(key, fingerprint)
            lost = hit & (lowest != ids)
            send = lost | ~hit if n_shards else lost
            # answered rows need no shard: they are spread by their document
            spread = (mix((ids + doc).view(np.uint64)) & np.uint64(1023)).astype(np.int64)
            shard = np.where(hit, -1 - spread, _shard_of(key, max(1, n_shards)))
            yield pa.record_batch(
                [pa.array(shard[send]), pa.array(ids[send]), pa.array(a[send]), pa.array(b[send]), _words(key[send]), _words(fingerprint[send]), pa.array(lost[send])],
                names=["shard", "id", "text_a", "text_b", "key", "fingerprint", "lost"],
            )

    return texts.select("text", "id", "text_a", "text_b").mapInArrow(probed, _PROBE)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The probes that lose their lines; a shard's row stands before its probes."""
    shard, at = None, None
    for batch in batches:
        number = batch.column("shard").to_numpy(zero_copy_only=False)
        heads = pc.is_valid(batch.column("bits")).to_numpy(zero_copy_only=False)
        key, fingerprint, ids = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in ("key", "fingerprint", "id"))
        lost = pc.fill_null(batch.column("lost"), False).to_numpy(zero_copy_only=False).copy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b and heads[a]:
                shard, at = Shard.load(*(batch.column(c)[a].as_py() for c in _ARRAYS)), number[a]
                a += 1
            if a < b and number[a] >= 0 and number[a] == at:
                hit, lowest = shard.found(key[a:b].view(np.uint64), fingerprint[a:b].view(np.uint64))
                lost[a:b] = hit & (lowest != ids[a:b])
        rows = batch.filter(pa.array(lost & ~heads))
        yield pa.record_batch([rows.column(c) for c in ("id", "text_a", "text_b", "key", "fingerprint")], names=["id", "text_a", "text_b", "key", "fingerprint"])


def lost_lines(texts: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, hot_parts: int = HOT_PARTS) -> DataFrame:
    """id, text_a, text_b, digests: the 16-byte digests that every document with a loss loses."""
    spark = texts.sparkSession
    counted = materialize(line_counts(texts, min_chars), "op11-lines")
    n_keys, held = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    is_hot = F.col("n") * F.lit(hot_parts) > F.lit(held or 0)
    top = [np.array(c, np.int64) for c in zip(*counted.filter(is_hot).collect(), strict=True)] or [np.empty(0, np.int64)] * 4
    hot = spark.sparkContext.broadcast(Shard.of(top[0].view(np.uint64), top[1].view(np.uint64), top[2], top[3]).dump())
    n_cold = n_keys - len(top[0])
    n_shards = -(-n_cold // shard_keys)
    probes = _probes(texts, hot, n_shards, min_chars)
    if n_shards:
        nothing = [F.lit(None).cast("binary").alias(c) for c in _ARRAYS]
        heads = build_shards(counted.filter(~is_hot), n_shards).select(
            "shard", *[F.lit(None).cast(t).alias(c) for c, t in [x.split() for x in _PROBE.split(", ")[1:]]], *_ARRAYS
        )
        dealt = probes.select("*", *nothing).unionByName(heads)
        probes = dealt.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())
        answers = probes.mapInArrow(_answered, "id long, text_a long, text_b long, key long, fingerprint long")
    else:
        answers = probes.drop("shard", "lost")
    return answers.groupBy("id", "text_a", "text_b").agg(
        F.collect_set(F.struct("key", "fingerprint")).alias("digests")
    ).select("id", "text_a", "text_b", F.col("digests.key").alias("keys"), F.col("digests.fingerprint").alias("fingerprints"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("second half"), text).alias("text_b"), F.col(id_col).cast("long").alias("doc_id"),
    )


def remove_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, with_text: bool = True,
    shard_keys: int = SHARD_KEYS, hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and the kept text) of every row."""
    texts = _texts(docs, id_col, text_col)
    lost = materialize(lost_lines(texts, min_chars, shard_keys, hot_parts), "op11-lost")

    def finish(batches):
        for batch in batches:
            for a, b in _runs(batch.column(0)):
                yield _cut(batch.slice(a, b - a), min_chars, with_text)

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_text else "")
    return texts.join(lost, ["id", "text_a", "text_b"], "left").select("text", "doc_id", "keys", "fingerprints").mapInArrow(finish, schema)


def _cut(rows: pa.RecordBatch, min_chars: int, with_text: bool) -> pa.RecordBatch:
    starts, lines = _lines(rows.column(0))
    n_lines = np.diff(starts)
    drop = np.zeros(int(starts[-1]), bool)
    losing = np.flatnonzero(pc.is_valid(rows.column(2)).to_numpy(zero_copy_only=False))
    for i in losing.tolist():
        a, b = int(starts[i]), int(starts[i + 1])
        at, digests = _digests(lines.slice(a, b - a), min_chars)
        lost = set(zip(rows.column(2)[i].as_py(), rows.column(3)[i].as_py(), strict=True))
        mine = [tuple(x) in lost for x in digests.view(np.int64).tolist()]
        drop[a + at[np.array(mine, bool)]] = True
    dropped = np.add.reduceat(drop.astype(np.int64), starts[:-1]) if rows.num_rows else np.empty(0, np.int64)
    digests, kept = [], []
    for i, text in enumerate(rows.column(0)):
        body = text.as_py() or ""
        if dropped[i]:
            a, b = int(starts[i]), int(starts[i + 1])
            body = "\n".join(lines.slice(a, b - a).filter(pa.array(~drop[a:b])).to_pylist())
        digests.append(hashlib.sha256(body.encode()).hexdigest())
        if with_text:
            kept.append(body)
    columns = [rows.column(1), pa.array(n_lines), pa.array(dropped), pa.array(digests, pa.string())]
    return pa.record_batch(columns + ([pa.array(kept, pa.string())] if with_text else []),
                           names=["doc_id", "n_lines", "n_dropped", "kept_sha256"] + (["kept"] if with_text else []))
