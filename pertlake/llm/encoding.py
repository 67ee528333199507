"""Tokenizer calls for whole texts: distinct chunks are encoded once and looked up after.

A public tokenizer splits a text into pre-tokens before it merges pairs, so a text may
be cut at any place where pre-tokens always end without changing its ids. The cuts
used here (tested against encoding the whole text):

* ``keep_space=True`` (byte-level vocabularies whose pre-tokens take one leading space):
  before a single space, and around a single newline, that stands between two
  characters that are not white space; a text with any other white space is encoded whole;
* ``keep_space=False`` (vocabularies that drop white space): at any ASCII white space;
* after a run of letters that a comma or full stop follows.

A text that holds the string of an added token of the vocabulary is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pertlake.llm.text_hash import Words, doc_buffers, doc_chunks, mix

# distinct chunks kept per Python worker (some tens of MB); the table starts anew beyond it
CACHE_CHUNKS = 1_000_000

# the characters after which a run of letters is cut off as a pre-token of its own
_STOPS = (",", ".")
_TYPE = np.uint64(0xA24BAED4963EE407)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(others)}


def _wide_space(body: np.ndarray) -> np.ndarray:
    """Byte places where a white-space character beyond ASCII begins."""
    lead = np.flatnonzero((body == 0xC2) | ((body >= 0xE1) & (body <= 0xE3)))
    lead = lead[lead + 1 < len(body)]
    a, b = body[lead], body[lead + 1]
    c = body[np.minimum(lead + 2, len(body) - 1)]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    wide |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    wide |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[wide]


class ChunkEncoder:
    """ids of texts, by a table of the chunks that this Python worker has already encoded."""

    def __init__(self, path: str, keep_space: bool, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of such a token are encoded whole, as the library does by default
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._model = self._tokenizer.model
        self._bytes = _byte_letters()
        self._keep_space = keep_space
        self._limit = cache_chunks
        self._stops = {c: self._whole(c) for c in _STOPS}
        self._newline = self._whole("\n") if keep_space else []
        self._known = np.empty(0, np.uint64)

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str, prefix: str) -> list[int]:
        """ids of one run of letters: such a run is one pre-token, so only the merges are left to do."""
        if not self._keep_space:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._bytes)
        return [t.id for t in self._model.tokenize("Ġ" + word if prefix else word)]

    def _chunk(self, word: str, kind: int) -> list[int]:
        """ids of a chunk; kind 0: as it stands, 1: after a space, 2: after a newline."""
        prefix = " " if kind == 1 else ""
        lead = self._newline if kind == 2 else []
        if word.isalpha() and (self._keep_space or word.isascii()):
            return lead + self._letters(word, prefix)
        body = word[:-1]
        if word[-1:] in _STOPS and body.isalpha() and (self._keep_space or body.isascii()):
            return lead + self._letters(body, prefix) + self._stops[word[-1]]
        return lead + self._whole(prefix + word)

    def _table(self, keys: np.ndarray, word_of, kinds: np.ndarray) -> np.ndarray:
        """Table rows of distinct sorted keys; unknown ones are encoded and added."""
        if len(self._known) > self._limit:
            self._known = np.empty(0, np.uint64)
        if not len(self._known):
            self._row = np.empty(0, np.int64)
            self._start, self._count = np.empty(0, np.int64), np.empty(0, np.int64)
            self._flat = np.empty(0, np.uint32)
        at = np.searchsorted(self._known, keys)
        hit = np.zeros(len(keys), bool)
        inner = at < len(self._known)
        hit[inner] = self._known[at[inner]] == keys[inner]
        new = np.flatnonzero(~hit)
        if len(new):
            ids = [self._chunk(word_of(i), int(kinds[i])) for i in new]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for part in ids for x in part), np.uint32, int(count.sum()))
            rows = len(self._start) + np.arange(len(new))
            self._start = np.concatenate([self._start, len(self._flat) + np.cumsum(count) - count])
            self._count = np.concatenate([self._count, count])
            self._flat = np.concatenate([self._flat, flat])
            self._known = np.insert(self._known, at[new], keys[new])
            self._row = np.insert(self._row, at[new], rows)
            at = np.searchsorted(self._known, keys)
        return self._row[at]

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """ids of each document of a run of documents."""
        words = Words(body, offsets, False)
        starts, ends, per_doc = words.starts, words.ends, np.diff(words.doc_words)
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        kinds = np.zeros(len(starts), np.uint64)
        odd = np.zeros(len(per_doc), bool)
        if self._keep_space:
            first = np.zeros(len(starts), bool)
            first[words.doc_words[:-1][per_doc > 0]] = True
            before = body[np.maximum(starts - 1, 0)]
            single = np.empty(len(starts), bool)
            single[1:] = starts[1:] - ends[:-1] == 1
            kinds[~first & (before == 0x20)] = 1
            kinds[~first & (before == 0x0A)] = 2
            bad = np.where(first, starts != offsets[owner], ~single | (kinds == 0))
            odd[owner[bad]] = True
            last = words.doc_words[1:] - 1
            full = per_doc > 0
            odd[full] |= ends[last[full]] != offsets[1:][full]
            odd[~full] = np.diff(offsets)[~full] > 0
            odd[np.searchsorted(offsets, _wide_space(body), side="right") - 1] = True
        raw = body.tobytes()
        for token in self._special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        use = ~odd[owner]
        keys, some, inverse = np.unique(
            mix(words.hashes[use] + kinds[use] * _TYPE), return_index=True, return_inverse=True
        )
        at = np.flatnonzero(use)[some]
        row = self._table(keys, lambda i: raw[starts[at[i]] : ends[at[i]]].decode(errors="replace"), kinds[at])[inverse]
        count, begin = self._count[row] if len(row) else row, self._start[row] if len(row) else row
        first = np.cumsum(count) - count
        ids = self._flat[np.arange(int(count.sum()), dtype=np.int64) + np.repeat(begin - first, count)] if len(row) else np.empty(0, np.uint32)
        ends_at = np.cumsum(np.bincount(owner[use], weights=count, minlength=len(per_doc))).astype(np.int64)
        a = 0
        for d, b in enumerate(ends_at.tolist()):
            if odd[d]:
                text = body[offsets[d] : offsets[d + 1]].tobytes().decode(errors="replace")
                yield np.array(self._whole(text), np.uint32)
            else:
                yield ids[a:b]
            a = b

    def documents(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row number, its ids with the end id) for every text of an Arrow column; null counts as empty."""
        np.seterr(over="ignore")
        end = np.array([end_id], np.uint32)
        body, offsets = doc_buffers(column)
        for a, b in doc_chunks(offsets):
            part = body[offsets[a] : offsets[b]]
            for row, ids in enumerate(self.encode(part, offsets[a : b + 1] - offsets[a]), a):
                yield row, np.concatenate([ids, end])


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def worker_encoder(path: str, keep_space: bool) -> ChunkEncoder:
    """One encoder per Python worker, reused by its later tasks."""
    key = (path, keep_space)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, keep_space)
    return _encoders[key]
