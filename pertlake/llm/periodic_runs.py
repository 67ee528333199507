"""Operator 13, periodic run detection by scale-tiled distribution.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are
equal) and a length of at least ``max(MIN_WORDS, MIN_POWERS * q)``. Collapsing a text drops the
words of every run after its first q words.

Periods are cut into octaves: 1 to 7, 8 to 15, 16 to 31, ... An octave of periods from P (8 for
the first) has boundaries every P words. A run of its periods has a boundary c at which P words
equal the P words one period later, because a run is at least three periods long.

1. Tiles. Per octave a document is exploded into overlapping tiles: the boundaries of a range
   with the words that a stretch around them may need (P + 1 before, 4 P + 1 behind). Tiles
   without a boundary whose block of P words returns one period later, by a hash of all blocks
   of that length (built by doubling), hold no run of the octave and aren't sent.
2. Boundary Z-functions. Tiles are dealt over the cluster by document, octave and place, so a
   long document keeps many tasks busy. At a boundary c the Z-function of the words from c on
   gives, for every period q of the octave, how far period q goes on behind c + q, and that of
   the reversed words before c how far it goes back. Periods whose root is itself a power are
   left out: the whole stretch then has the shorter period, which its own octave finds.
3. Stitching. The interval fragments are shuffled by (document, period); fragments that share q
   words or more are one stretch. Stretches that are long enough are the document's runs.
4. Documents without a tile are finished in the first step; only the others meet their runs.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; rows
that repeat a doc_id and text get the same result each; rows that repeat a doc_id with another
text, or have none, are documents of their own; very long texts and words are whole (bytes are
hashed and joined in pieces, tiles are bounded by 5 P + ``TILE_WORDS`` words); columns besides
id and text aren't read; an empty table gives no rows. Words of one document are equal if their
64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pertlake.llm.common import materialize
from pertlake.llm.text_hash import Words, iter_documents, mix

MIN_WORDS = 24
MIN_POWERS = 3
FIRST = 8  # boundaries of the first two octaves are so many words apart
TILE_WORDS = 16_384
PIECE_BYTES = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)

# (doc_id, number of words) -> (first, period) of words to be replaced by a repetition, or None
Tiling = Callable[[int | None, int], tuple[int, int] | None]


def z_function(s: list[int]) -> list[int]:
    """z[i]: length of the longest common prefix of ``s`` and ``s[i:]`` (z[0] = len(s))."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i) if i < right else 0
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


def octave_periods(octave: int) -> tuple[int, int, int]:
    """(first period, last period, distance of the boundaries) of an octave: 0, 1, 2, ..."""
    if octave == 0:
        return 1, FIRST - 1, FIRST
    p = FIRST << (octave - 1)
    return p, 2 * p - 1, p


def tile_fragments(words: list[int], centers: list[int], octave: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the stretches around the boundaries of a tile."""
    low_q, high_q, step = octave_periods(octave)
    found: dict[int, list[list[int]]] = {}
    for c in centers:
        first, last = max(0, c - step - 1), min(len(words), c + 4 * step + 1)
        ahead = z_function(words[c:last])
        periods = [q for q in range(low_q, min(high_q, len(ahead) - 1) + 1) if ahead[q] >= step]
        periods = [q for q in periods if all(ahead[q // r] < q - q // r for r in _prime_factors(q))]
        if not periods:
            continue
        top = periods[-1]
        before = words[first:c][::-1]
        back = z_function([*before, -1, *words[first : c + top][::-1]])
        for q in periods:
            start, stop = c - back[len(before) + 1 + top - q], c + q + ahead[q]
            mine = found.setdefault(q, [])
            if mine and start <= mine[-1][1] - q:
                mine[-1][1] = max(mine[-1][1], stop)
            else:
                mine.append([start, stop])
    return [(q, a, b) for q, spans in found.items() for a, b in spans]


def _boundaries(codes: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(octave, document, boundaries) whose block of words returns one period of the octave later.

    ``codes`` are the words of all documents one after the other, ``sizes`` their numbers.
    """
    out = []
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes), dtype=np.int64) - starts[doc]
    left = sizes[doc] - place
    width, block = 1, codes
    octave = 0
    while True:
        _, _, step = octave_periods(octave)
        while width < step:
            longer = np.zeros_like(block)
            if len(block) > width:
                longer[:-width] = mix(block[:-width] * _ODD + block[width:])
            block, width = longer, 2 * width
        # a shorter document has no run of these periods
        keep = sizes[doc] >= max(MIN_WORDS, MIN_POWERS * octave_periods(octave)[0])
        if not keep.all():
            doc, place, left, block = doc[keep], place[keep], left[keep], block[keep]
        if not len(doc):
            return out
        shift = place & (step - 1)
        if octave:
            shift += step
        at = np.arange(len(block))
        at -= shift
        equal = (block[at] == block) & (left >= step) & (place >= shift) & (shift > 0)
        hits = np.flatnonzero(equal)
        if len(hits):
            pairs = np.unique(np.stack((doc[hits].astype(np.int64), place[hits] - shift[hits])), axis=1)
            for d in np.unique(pairs[0]).tolist():
                out.append((octave, d, pairs[1][pairs[0] == d]))
        octave += 1


def _sequence(doc_id: int | None, n: int, tiling: Tiling | None) -> np.ndarray:
    """The numbers of the words that stand at 0 .. n - 1."""
    order = np.arange(n)
    change = tiling(doc_id, n) if tiling else None
    if change:
        first, period = change
        order[first:] = first + (order[first:] - first) % period
    return order


def _ordered(rows: pa.RecordBatch, words: Words, tiling: Tiling | None) -> list[np.ndarray]:
    """Per document the numbers (in ``words``) of its words in order."""
    at = words.doc_words.tolist()
    return [a + _sequence(i, b - a, tiling) for i, a, b in zip(rows.column(0).to_pylist(), at[:-1], at[1:], strict=True)]


def _joined(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words body[starts:ends] joined by a space, in pieces."""
    lens = ends - starts + 1
    upto = np.cumsum(lens)
    first, done = 0, 0
    while first < len(lens):
        last = max(first + 1, int(np.searchsorted(upto, done + PIECE_BYTES, "right")))
        if last == first + 1:
            piece = body[starts[first] : ends[first]].tobytes() + b" "
        else:
            out = upto[first:last] - done
            source = np.repeat(starts[first:last] - out + lens[first:last], lens[first:last]) + np.arange(int(out[-1]))
            text = body[np.minimum(source, len(body) - 1)]
            text[out - 1] = 32
            piece = text.tobytes()
        first, done = last, int(upto[last - 1])
        yield piece if first < len(lens) else piece[:-1]


def _digest(pieces: Iterator[bytes]) -> str:
    sha = hashlib.sha256()
    for p in pieces:
        sha.update(p)
    return sha.hexdigest()


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("text", pa.string()), ("plain", pa.string()),
    ("octave", pa.int32()), ("base", pa.int64()), ("centers", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())),
])


def _first_pass(texts: DataFrame, tiling: Tiling | None) -> DataFrame:
    """One row per document (``plain``: digest of one without tiles; else its ``text``) and one per tile."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, body, _ in iter_documents(batches, lower=False):
            orders = _ordered(rows, words, tiling)
            sizes = np.array([len(o) for o in orders], np.int64)
            order = np.concatenate(orders) if orders else np.empty(0, np.int64)
            codes = words.hashes[order]
            first = np.cumsum(sizes) - sizes
            tiled = set()
            keys = list(zip(*(rows.column(c).to_pylist() for c in (0, 2, 3)), strict=True))
            for octave, d, centers in _boundaries(codes, sizes):
                tiled.add(d)
                step = octave_periods(octave)[2]
                tile = centers // max(step, TILE_WORDS)
                for t in np.unique(tile).tolist():
                    mine = centers[tile == t]
                    a, b = max(0, int(mine[0]) - step - 1), min(int(sizes[d]), int(mine[-1]) + 4 * step + 1)
                    local = np.unique(codes[first[d] + a : first[d] + b], return_inverse=True)[1].astype(np.int32)
                    row = [*keys[d], None, None, octave, a, (mine - a).astype(np.int32), local]
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _FOUND, strict=True)], schema=_FOUND)
            plain = [None if d in tiled else _digest(_joined(body, words.starts[o], words.ends[o])) for d, o in enumerate(orders)]
            nothing = [pa.nulls(len(orders), f.type) for f in list(_FOUND)[5:]]
            text = pa.array([t.as_py() if d in tiled else None for d, t in enumerate(rows.column(1))], pa.string())
            yield pa.record_batch([rows.column(0), rows.column(2), rows.column(3), text, pa.array(plain, pa.string()), *nothing], schema=_FOUND)

    schema = "doc_id long, text_a long, text_b long, text string, plain string, octave int, base long, centers array<int>, words array<int>"
    return texts.mapInArrow(explode, schema)


def _fragments(tiles: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, period, start, stop."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, a, b, octave, base, centers, words in zip(*(batch.column(c) for c in range(7)), strict=True):
                key = (i.as_py(), a.as_py(), b.as_py())
                base = base.as_py()
                out += [(*key, q, base + x, base + y) for q, x, y in tile_fragments(words.as_py(), centers.as_py(), octave.as_py())]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_a", "text_b", "period", "start", "stop"])

    # little data and much work: a number of partitions of its own keeps them from being merged by size
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select("doc_id", "text_a", "text_b", "octave", "base", "centers", "words").repartition(n, "doc_id", "text_a", "octave", "base")
    return dealt.mapInArrow(solve, "doc_id long, text_a long, text_b long, period long, start long, stop long")


def stitched(fragments: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_a, text_b, start, length, period of every run."""
    key = ["doc_id", "text_a", "text_b", "period"]
    part = Window.partitionBy(*key).orderBy("start", "stop")
    before = F.max("stop").over(part.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("start") > before - F.col("period")), 1).otherwise(0)
    stretch = fragments.distinct().withColumn("new", starts).withColumn("nth", F.sum("new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        stretch.groupBy(*key, "nth").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
        .filter(F.col("length") >= F.greatest(F.lit(min_words), MIN_POWERS * F.col("period")))
        .select("doc_id", "text_a", "text_b", "start", "length", "period")
    )


def _described(runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256 of runs sorted by start and period."""
    lines = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, lines
    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return len(runs), s, n, q, 1000 * n // q, lines


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiling: Tiling | None = None, with_text: bool = True,
) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of every row;
    ``with_text`` adds the runs and the collapsed text (of rows without runs: null, their words are all kept)."""
    text = F.col(text_col).cast("string")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("second half"), text).alias("text_b")
    )
    found = materialize(_first_pass(texts, tiling), "op13-found")
    fragments = _fragments(found.filter("octave is not null"))
    runs = stitched(fragments).groupBy("doc_id", "text_a", "text_b").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    extra = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_text else ""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, body, _ in iter_documents(batches, lower=False):
            out = []
            for i, (order, listed) in enumerate(zip(_ordered(rows, words, tiling), rows.column(2).to_pylist(), strict=True)):
                own = sorted((r["start"], r["period"], r["length"]) for r in listed or [])
                own = [(s, n, q) for s, q, n in own]
                drop = np.zeros(len(order) + 1, np.int64)
                for s, n, q in own:
                    drop[s + q] += 1
                    drop[s + n] -= 1
                kept = order[np.cumsum(drop[:-1]) == 0]
                pieces = lambda: _joined(body, words.starts[kept], words.ends[kept])  # noqa: B023, E731
                row = (rows.column(0)[i].as_py(), *_described(own), _digest(pieces()))
                if with_text:
                    row += ([{"start": s, "length": n, "period": q} for s, n, q in own], b"".join(pieces()).decode() if own else None)
                out.append(row)
            yield _record(out, with_text)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _record([(i, *_described([]), p, *(([], None) if with_text else ())) for i, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)], with_text)

    tiled = found.filter("text is not null").select("doc_id", "text_a", "text_b", "text")
    same = [tiled[c].eqNullSafe(runs[c]) for c in ("doc_id", "text_a", "text_b")]
    met = tiled.join(runs, same, "left").select(tiled["doc_id"], "text", "runs").mapInArrow(finish, schema + extra)
    return met.unionByName(found.filter("plain is not null").select("doc_id", "plain").mapInArrow(finished, schema + extra))


def _record(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = [pa.int64()] * 6 + [pa.string()] * 2 + ([pa.list_(run), pa.string()] if with_text else [])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"][: len(types)]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
