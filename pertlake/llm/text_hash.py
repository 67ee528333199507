"""Vectorised word and shingle hashing over the bytes of Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's 64-bit hash
is a sum over its bytes of a random number per byte value times a power of an odd
constant per place, then mixed. Everything is deterministic, so hashes agree between
tasks, retries and executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# bytes hashed at a time: bounds the scratch arrays (about 40 bytes per text byte)
CHUNK_BYTES = 500_000

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x ^= x >> np.uint64(29)
    x = x * _PLACE
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _PLACE)
_powers = np.ones(1, dtype=np.uint64)


def _place_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _PLACE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def doc_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying its text; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding at most ``limit`` bytes each (a longer document stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of a run of documents: byte spans, owning document and hash."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, lower: bool):
        """``offsets`` start at 0 and end at ``len(body)``. Bytes are hashed in pieces, whatever the length of a word."""
        parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]]
        for a in range(0, len(body), CHUNK_BYTES):
            starts, ends, sums = self._part(body, offsets, a, min(a + CHUNK_BYTES, len(body)), lower)
            if len(starts) and starts[0] == a and a and not _SEPARATOR[body[a - 1]] and offsets[np.searchsorted(offsets, a)] != a:
                # the first piece goes on with the last word
                last = max(i for i, x in enumerate(parts[0]) if len(x))
                power = np.uint64(pow(int(_PLACE), a - int(parts[0][last][-1]), 2**64))
                parts[1][last][-1] = ends[0]
                parts[2][last][-1] += sums[0] * power
                starts, ends, sums = starts[1:], ends[1:], sums[1:]
            for whole, x in zip(parts, (starts, ends, sums), strict=True):
                whole.append(x)
        self.starts, self.ends, sums = (np.concatenate(x) for x in parts)
        self.hashes = mix(sums + (self.ends - self.starts).astype(np.uint64))
        # doc_words[d] .. doc_words[d + 1] are the words of document d
        self.doc_words = np.searchsorted(self.starts, offsets, side="left")

    @staticmethod
    def _part(body: np.ndarray, offsets: np.ndarray, a: int, b: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and byte sums of the pieces of words in ``body[a:b]``."""
        text = _LOWERED[body[a:b]] if lower else body[a:b]
        inside = ~_SEPARATOR[text]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        first_byte, past_byte = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        lens = past_byte - first_byte
        if not len(lens):
            return first_byte, past_byte, np.empty(0, np.uint64)
        flat = text[inside]
        first = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=first[1:])
        place = np.arange(len(flat), dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), lens)
        terms = _BYTE[flat] * _place_powers(int(lens.max()))[place]
        return first_byte + a, past_byte + a, np.add.reduceat(terms, first)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (fewer words: empty)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: the sum over 2m words is the sum over m plus the shifted sum times a power
    out, have, power, width = np.zeros(n, np.uint64), 0, words, 1
    scale = _STEP
    shift = np.uint64(1)
    rest = k
    while rest:
        if rest & 1:
            out = out + power[have : have + n] * shift
            have += width
            shift = shift * scale
        rest >>= 1
        if rest:
            power = power[: len(power) - width] + power[width:] * scale
            width *= 2
            scale = scale * scale
    return mix(out)


def iter_documents(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    """(rows, words, bytes, offsets) for bounded runs of documents; the text is column 1."""
    np.seterr(over="ignore")
    for batch in batches:
        body, offsets = doc_buffers(batch.column(1))
        for a, b in doc_chunks(offsets):
            part = body[offsets[a] : offsets[b]]
            own = offsets[a : b + 1] - offsets[a]
            yield batch.slice(a, b - a), Words(part, own, lower), part, own
