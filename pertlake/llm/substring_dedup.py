"""Operator 1, substring dedup with suffix automata of reference shards.

A word is removed if a run of ``WINDOW`` consecutive words that covers it also starts at
any other place of the corpus (the same document included), judged on the input.

An automaton of the whole corpus, streamed past by the whole corpus, would cost the square
of its size. So the corpus is first narrowed, without losing a repeated window, and cut into
shards that each hold everything their documents' windows have to be compared with:

1. Minimizers: of each window, the smallest hash among its runs of ``SEED`` words. Equal
   windows have equal minimizers, so windows whose minimizer occurs once are settled.
   Minimizers are counted by a partial aggregate.
2. Segments: the windows of a document that follow each other and have the same repeated
   minimizer, as one run of words. Equal segments are one content with a number of places.
3. References: windows counted by hash (a partial aggregate, so that a passage that a third
   of the corpus shares costs a row per task); of each repeated window one content is the
   witness, and the words of the witnessed windows are the reference passages.
4. Shards: references and contents are dealt by minimizer; those of a frequent minimizer
   (more than ``PART_SEGMENTS`` contents) are first cut again, into runs of windows with the
   same second key: the smallest of the window's seeds, those that more than
   ``PART_SEGMENTS`` contents hold last. Equal windows have equal second keys, and contents of
   one key are few unless all seeds of its windows are that frequent (a window within the
   boilerplate itself). Only such references go to each of several parts. A part builds one generalised suffix
   automaton of its references and streams its contents' words through it: the matching
   statistic at a word is the longest run ending there that occurs in a reference. Where it
   reaches ``WINDOW``, the maximal span is removed.
5. The spans go back to the contents' places and are joined to the texts by row.

The repeated minimizers reach step 2 as a broadcast if they are counted and few
(``BROADCAST_SEEDS``), else by a join with the documents that hold them; the same holds for
the joins marked by ``checked_broadcast``. The result doesn't depend on it.

Defined results: words are runs of characters other than space and 0x09-0x0D, unchanged; a
null text has no words; documents shorter than the window keep all words; rows that repeat a
doc_id or a text are places of their own, so long repeated texts go entirely; very long texts
and words are whole; only the id and text columns are read, so others may clash; an empty table
gives no rows. Rows, places and contents are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import checked_broadcast, materialize
from pertlake.llm.text_hash import Words, doc_buffers, doc_chunks, iter_documents, mix, window_hashes

WINDOW = 35
SEED = 12
PART_SEGMENTS = 4_000  # contents of one part of a shard, on average
BROADCAST_SEEDS = 4_000_000  # 32 MB


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    have = 1
    out = x
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        n = len(x) - width + 1
        out = pick(out[:n], out[width - have : width - have + n])
    return out


def minimizers(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The minimizer of every window of a document's word hashes."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    return _sliding(window_hashes(words, seed), window - seed + 1, np.minimum)


def _seed_counts(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, number of its places) of one document."""
    least = minimizers(words, window, seed)
    if not len(least):
        return least, np.empty(0, np.int64)
    seeds = window_hashes(words, seed)
    values = np.unique(least)
    return values, np.searchsorted(np.sort(seeds), values, "right") - np.searchsorted(np.sort(seeds), values, "left")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id")
    )


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def document_minimizers(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """row_key, minimizer, places: the distinct minimizers of every document."""

    def rows_of(batches):
        for rows, words, _, _ in iter_documents(batches, lower=False):
            at = words.doc_words
            both = [_seed_counts(words.hashes[at[i] : at[i + 1]], window, seed) for i in range(rows.num_rows)]
            yield pa.record_batch(
                [rows.column(0), _lists([v.view(np.int64) for v, _ in both], pa.int64()), _lists([n for _, n in both], pa.int64())],
                names=["row_key", "minimizers", "places"],
            )

    rows = texts.select("row_key", "text").mapInArrow(rows_of, "row_key long, minimizers array<long>, places array<long>")
    return rows.select("row_key", F.explode(F.arrays_zip("minimizers", "places")).alias("m")).select(
        "row_key", F.col("m.minimizers").alias("minimizer"), F.col("m.places").alias("places")
    )


def segments(texts: DataFrame, window: int, seed: int, seeds: Broadcast | None) -> DataFrame:
    """row_key, first, minimizer, content, words: runs of windows with one repeated minimizer.

    ``words`` is the run as it stands in the text.
    ``texts`` has row_key, text and, where ``seeds`` (a sorted array) is not given, the
    document's repeated minimizers.
    """

    def rows_of(batches):
        for rows, words, body, _ in iter_documents(batches, lower=False):
            at = words.doc_words
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            out_key, out_first, out_min, out_content, out_words = [], [], [], [], []
            for i in range(rows.num_rows):
                own = words.hashes[at[i] : at[i + 1]]
                least = minimizers(own, window, seed)
                if not len(least):
                    continue
                if seeds is None:
                    wanted = np.sort(rows.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                else:
                    wanted = seeds.value
                if not len(wanted):
                    break
                edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                ends = np.r_[edge[1:], len(least)]
                value = least[edge]
                hit = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value
                for a, b in zip(edge[hit].tolist(), ends[hit].tolist(), strict=True):
                    run = body[words.starts[at[i] + a] : words.ends[at[i] + b + window - 2]].tobytes()
                    out_key.append(keys[i])
                    out_first.append(a)
                    out_min.append(least[a])
                    out_content.append(int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little", signed=True))
                    out_words.append(run)
            yield pa.record_batch(
                [pa.array(out_key, pa.int64()), pa.array(out_first, pa.int64()), pa.array(np.array(out_min, np.uint64).view(np.int64)),
                 pa.array(out_content, pa.int64()), pa.array(out_words, pa.binary())],
                names=["row_key", "first", "minimizer", "content", "words"],
            )

    return texts.mapInArrow(rows_of, "row_key long, first long, minimizer long, content long, words binary")


def _batch_windows(column: pa.Array, window: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, past row, words, window hashes, number of windows of each row, bytes) for bounded runs of rows."""
    np.seterr(over="ignore")
    body, offsets = doc_buffers(column)
    for a, b in doc_chunks(offsets):
        part = body[offsets[a] : offsets[b]]
        words = Words(part, offsets[a : b + 1] - offsets[a], False)
        count = np.maximum(np.diff(words.doc_words) - window + 1, 0)
        own = np.repeat(words.doc_words[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        yield a, b, words, window_hashes(words.hashes, window)[own], count, part


def content_windows(contents: DataFrame, window: int) -> DataFrame:
    """content, n, window: the hash of every window of every content."""

    def rows_of(batches):
        for batch in batches:
            for a, b, _, hashes, count, _ in _batch_windows(batch.column(2), window):
                ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
                part = batch.slice(a, b - a)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))], names=["content", "n", "windows"]
                )

    rows = contents.select("content", "n", "words").mapInArrow(rows_of, "content long, n long, windows array<long>")
    return rows.select("content", "n", F.explode("windows").alias("window"))


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[bytes]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            known = nexts[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._clone(last, word, known)
                continue
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[state] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
            last = state

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def matching_statistics(self, sequence: list[bytes]) -> list[int]:
        """For each word, the length of the longest run ending there that occurs in a reference."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in sequence:
            to = nexts[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(word)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            out.append(matched)
        return out


def maximal_spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Spans (first word, word past the end) covered by matches of at least ``least`` words."""
    spans: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= least:
            start = end - n
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))
    return spans


def matched_spans(parts: DataFrame, references: DataFrame, window: int) -> DataFrame:
    """content, start, stop of the spans found in each part; both sides have columns shard and part, ``parts`` also its place in the content."""

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        for words in sorted(set(right.column("words").to_pylist())):
            automaton.add(words.split())
        keys, starts, stops = [], [], []
        for key, at, words in zip(*(left.column(c).to_pylist() for c in ("content", "offset", "words")), strict=True):
            for a, b in maximal_spans(automaton.matching_statistics(words.split()), window):
                keys.append(key)
                starts.append(at + a)
                stops.append(at + b)
        return pa.table({"content": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "stop": pa.array(stops, pa.int64())})

    return (
        parts.groupBy("shard", "part").cogroup(references.groupBy("shard", "part"))
        .applyInArrow(match, "content long, start long, stop long")
    )


def reference_runs(witnesses: DataFrame, window: int) -> DataFrame:
    """minimizer, words of the runs of witnessed windows of each content."""

    def cut(batches):
        salt = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            lists = batch.column(2)
            for a, b, words, hashes, count, body in _batch_windows(batch.column(1), window):
                part = lists.slice(a, b - a)
                row = np.repeat(np.arange(b - a, dtype=np.uint64), count)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False)
                wanted = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(np.repeat(np.arange(b - a, dtype=np.uint64), sizes) * salt)
                hit = np.isin(hashes ^ mix(row * salt), wanted)
                # runs of witnessed windows that follow each other in one row
                first = np.flatnonzero(hit & ~np.r_[False, hit[:-1] & (row[1:] == row[:-1])])
                last = np.flatnonzero(hit & ~np.r_[hit[1:] & (row[1:] == row[:-1]), False])
                base = words.doc_words[row[first].astype(np.int64)] - (np.cumsum(count) - count)[row[first].astype(np.int64)]
                starts, ends = words.starts[base + first], words.ends[base + last + window - 1]
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a).take(pa.array(row[first].astype(np.int64))),
                     pa.array([body[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["minimizer", "words"],
                )

    return witnesses.mapInArrow(cut, "minimizer long, words binary")


def content_seeds(contents: DataFrame, seed: int) -> DataFrame:
    """seed: the distinct seeds of every content."""

    def rows_of(batches):
        for rows, words, _, _ in iter_documents(batches, lower=False):
            at = words.doc_words
            found = [np.unique(window_hashes(words.hashes[at[i] : at[i + 1]], seed)) for i in range(rows.num_rows)]
            yield pa.record_batch([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["seed"])

    return contents.select("content", "words").mapInArrow(rows_of, "seed long")


def pieces(runs: DataFrame, window: int, seed: int, common: Broadcast) -> DataFrame:
    """content, offset, key, words: runs of windows with one second key, from rows (content, words).

    ``common`` is a sorted array of the seeds that come last.
    """

    def rows_of(batches):
        for rows, words, body, _ in iter_documents(batches, lower=False):
            at = words.doc_words
            late = common.value
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            out_id, out_offset, out_key, out_words = [], [], [], []
            for i in range(rows.num_rows):
                own = window_hashes(words.hashes[at[i] : at[i + 1]], seed)
                if len(own) < window - seed + 1:
                    continue
                last = np.zeros(len(own), np.uint64)
                if len(late):
                    last[late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own] = 1
                key = _sliding((own >> np.uint64(1)) | (last << np.uint64(63)), window - seed + 1, np.minimum)
                edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                for a, b in zip(edge.tolist(), np.r_[edge[1:], len(key)].tolist(), strict=True):
                    out_id.append(ids[i])
                    out_offset.append(a)
                    out_key.append(key[a])
                    out_words.append(body[words.starts[at[i] + a] : words.ends[at[i] + b + window - 2]].tobytes())
            yield pa.record_batch(
                [pa.array(out_id, pa.int64()), pa.array(out_offset, pa.int64()), pa.array(np.array(out_key, np.uint64).view(np.int64)), pa.array(out_words, pa.binary())],
                names=["content", "offset", "key", "words"],
            )

    return runs.mapInArrow(rows_of, "content long, offset long, key long, words binary")


def keyed(contents: DataFrame, references: DataFrame, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(content, offset, key, words of the contents, key, words of the references): equal windows have equal keys."""
    counts = contents.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per PART_SEGMENTS contents
    frequent = materialize(counts.filter(F.col("n") > PART_SEGMENTS).select("minimizer"), "op1-frequent")
    whole = contents.select("content", F.lit(0).cast("long").alias("offset"), F.col("minimizer").alias("key"), "words", "minimizer")
    known = references.select(F.col("minimizer").alias("key"), "words", "minimizer")
    n_frequent = frequent.count()
    if not n_frequent:
        return whole.drop("minimizer"), known.drop("minimizer")
    side = checked_broadcast(frequent, n_frequent)
    many = contents.join(side, "minimizer", "left_semi")
    # at most one row per PART_SEGMENTS seeds of those contents
    common = content_seeds(many, seed).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART_SEGMENTS).select("seed")
    values = np.sort(np.array([r[0] for r in common.toLocalIterator()], np.int64).view(np.uint64))
    late = contents.sparkSession.sparkContext.broadcast(values)
    cut = pieces(many.select("content", "words"), window, seed, late)
    known_cut = pieces(references.join(side, "minimizer", "left_semi").select("minimizer", "words"), window, seed, late)
    return (
        materialize(whole.join(side, "minimizer", "left_anti").drop("minimizer").unionByName(cut), "op1-pieces"),
        materialize(known.join(side, "minimizer", "left_anti").drop("minimizer").unionByName(known_cut.select("key", "words").distinct()), "op1-dealt"),
    )


def repeated_segments(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """The segments of all documents whose minimizer occurs at two places or more."""
    found = document_minimizers(texts, window, seed)
    repeated = materialize(
        found.groupBy("minimizer").agg(F.sum("places").alias("places")).filter("places > 1").select("minimizer"), "op1-seeds"
    )
    if repeated.count() <= BROADCAST_SEEDS:
        values = np.sort(np.array([r[0] for r in repeated.toLocalIterator()], np.int64).view(np.uint64))
        return segments(texts.select("row_key", "text"), window, seed, texts.sparkSession.sparkContext.broadcast(values))
    flags = found.select("row_key", "minimizer").join(repeated, "minimizer").groupBy("row_key").agg(F.collect_set("minimizer").alias("minimizers"))
    return segments(texts.select("row_key", "text").join(flags, "row_key").select("row_key", "text", "minimizers"), window, seed, None)


def removed_spans(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """row_key, start, stop: spans of words to remove (they may overlap each other)."""
    runs = materialize(repeated_segments(texts, window, seed), "op1-segments")
    places = runs.select("row_key", "first", "content")
    place = F.xxhash64("row_key", "first")
    # one place of each content, whose words are kept (rows that repeat a doc_id and text share a place)
    chosen = materialize(
        places.groupBy("content").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).select("place", "n"), "op1-contents"
    )
    side = checked_broadcast(chosen, chosen.count())
    contents = materialize(
        runs.withColumn("place", place).join(side, "place").select("content", "minimizer", "n", "words"), "op1-words"
    )
    witness = content_windows(contents, window).groupBy("window").agg(F.sum("n").alias("n"), F.min("content").alias("content")).filter("n > 1")
    kept = witness.groupBy("content").agg(F.collect_set("window").alias("windows"))
    witnesses = contents.join(kept, "content").select("minimizer", "words", "windows")
    references = materialize(reference_runs(witnesses, window).distinct(), "op1-references")

    runs_of, known = keyed(contents, references, window, seed)
    shards = max(1, -(-runs_of.count() // PART_SEGMENTS))
    of_shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    n_parts = (F.floor((F.col("n") - 1) / PART_SEGMENTS) + 1).cast("int")
    counts = runs_of.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wide = materialize(counts.filter(F.col("n") > PART_SEGMENTS).select("key", n_parts.alias("parts")), "op1-wide")
    parts = runs_of.join(wide, "key", "left").select(
        of_shard, F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("content"), F.col("parts"))).cast("int").alias("part"),
        "content", "offset", "words",
    )
    dealt = known.join(wide, "key", "left").select(
        of_shard, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"), "words"
    )
    spans = materialize(matched_spans(parts, dealt, window), "op1-matches")
    return places.join(spans, "content").select(
        "row_key", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop")
    )


def merged_spans(spans: DataFrame) -> DataFrame:
    """row_key, starts, stops with overlapping and touching spans of a row united."""

    def merge(batches):
        for batch in batches:
            starts, stops = [], []
            for a, b in zip(batch.column(1), batch.column(2), strict=True):
                x, y = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                order = np.argsort(x, kind="stable")
                x, reach = x[order], np.maximum.accumulate(y[order])
                head = np.r_[True, x[1:] > reach[:-1]]
                starts.append(x[head])
                stops.append(reach[np.r_[head[1:], True]])
            yield pa.record_batch([batch.column(0), _lists(starts, pa.int64()), _lists(stops, pa.int64())], names=["row_key", "starts", "stops"])

    return spans.mapInArrow(merge, "row_key long, starts array<long>, stops array<long>")


def _finished(rows: pa.RecordBatch, words: Words, body: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """doc_id, n_words, n_removed, kept_sha256 (and kept) of rows (row_key, text, doc_id, starts, stops)."""
    at = words.doc_words
    n_words, removed, digests, texts = [], [], [], []
    starts, stops = rows.column(3), rows.column(4)
    for i in range(rows.num_rows):
        n = int(at[i + 1] - at[i])
        drop = np.zeros(n + 1, np.int64)
        if starts[i].is_valid:
            np.add.at(drop, starts[i].values.to_numpy(zero_copy_only=False), 1)
            np.add.at(drop, stops[i].values.to_numpy(zero_copy_only=False), -1)
        keep = np.cumsum(drop[:n]) == 0
        lo, hi = words.starts[at[i] : at[i + 1]][keep].tolist(), words.ends[at[i] : at[i + 1]][keep].tolist()
        kept = b" ".join([body[a:b].tobytes() for a, b in zip(lo, hi, strict=True)])
        n_words.append(n)
        removed.append(n - len(lo))
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept)
    columns = [rows.column(2), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
        names.append("kept")
    return pa.record_batch(columns, names=names)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row."""
    texts = _texts(docs, id_col, text_col)
    spans = materialize(
        removed_spans(texts, window, seed).groupBy("row_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        .select("row_key", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")),
        "op1-spans",
    )
    spans = materialize(merged_spans(spans), "op1-merged")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, body, _ in iter_documents(batches, lower=False):
            yield _finished(rows, words, body, with_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    side = checked_broadcast(spans, spans.select(F.sum(F.size("starts"))).first()[0] or 0)
    return (
        texts.join(side, "row_key", "left").select("row_key", "text", "doc_id", "starts", "stops").mapInArrow(finish, schema)
    )
