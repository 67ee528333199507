"""Operator 6, quality classifier: histogram gradient-boosted trees over document statistics.

Documents are described by ``FEATURES`` (byte classes, word shapes, repetition, lines), all
computed with array operations over whole texts. The trees are grown on histograms of a
bounded sample of labelled documents (``PER_CLASS`` per label, documented parameter) and
flattened into complete binary arrays, so scoring is ``depth`` gathers per tree for a whole
batch of rows. Spark computes the statistics of the sample and scores every row in tasks.

Defined results: null and empty texts have all-zero statistics and are scored like any
row; without labels of both kinds the score is the share of label 1 (0.5 without labels);
repeated rows are scored alike; very long texts are described whole; only the id, text and label
columns are read, so others may clash (``accepted`` gives all columns back); an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertlake.llm.text_hash import Words, doc_buffers, doc_chunks, mix
from pertlake.llm.training_rows import labelled_sample, remainder

PER_CLASS = 10_000
TREES, DEPTH, BINS, RATE, LEAF_WEIGHT, PENALTY = 120, 4, 64, 0.15, 5.0, 1.0

# byte classes counted per document
_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "bar", "mark", "bracket", "high")
_CLASS = np.full(256, 10, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\""]] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord(c) for c in "#$%&*@^~+=_"]] = 7
_CLASS[[ord(c) for c in "<>{}[]()/\\"]] = 8
_CLASS[128:] = 9

FEATURES = (
    *(f"share_{c}" for c in _CLASSES), "share_other", "log_bytes", "log_words", "mean_word", "sd_word", "long_word",
    "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "distinct_lines", "words_per_line",
    "one_byte_words", "symbol_words",
)

_WORD_SALT = np.uint64(0x9FB21C651E98DF25)


def _distinct_per_doc(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct keys, count of the most frequent key) of each document."""
    _, first, count = np.unique(mix(keys ^ mix(owner.astype(np.uint64) * _WORD_SALT)), return_index=True, return_counts=True)
    docs = owner[first]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, docs, count)
    return np.bincount(docs, minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text of an Arrow column."""
    np.seterr(over="ignore")
    body, offsets = doc_buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)), np.float64)
    for a, b in doc_chunks(offsets):
        out[a:b] = _statistics(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    classes = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * 11, size) + _CLASS[body], minlength=11 * n).reshape(n, 11)
    words = Words(body, offsets, False)
    per_doc = np.diff(words.doc_words)
    owner = np.repeat(np.arange(n), per_doc)
    length = words.ends - words.starts
    one, many = np.maximum(per_doc, 1), np.maximum(size, 1)
    sums = lambda x: np.bincount(owner, weights=x, minlength=n)
    mean = sums(length) / one
    distinct, top = _distinct_per_doc(words.hashes, owner, n)
    inner = owner[1:] == owner[:-1]
    pairs = words.hashes[:-1][inner] + mix(words.hashes[1:][inner])
    pair_owner = owner[1:][inner]
    distinct_pairs, _ = _distinct_per_doc(pairs, pair_owner, n)
    same = np.bincount(pair_owner[words.hashes[1:][inner] == words.hashes[:-1][inner]], minlength=n)
    # lines: the hash of a line is the mixed sum of its words' hashes by place
    newline = np.cumsum(body == 0x0A)
    line = newline[np.maximum(words.starts - 1, 0)] if len(words.starts) else np.empty(0, np.int64)
    new_line = np.ones(len(line), bool)
    new_line[1:] = (line[1:] != line[:-1]) | ~inner
    heads = np.flatnonzero(new_line)
    if len(heads):
        in_line = np.arange(len(line)) - np.repeat(heads, np.diff(np.append(heads, len(line))))
        line_keys = np.add.reduceat(mix(words.hashes + mix(in_line.astype(np.uint64))), heads)
    else:
        line_keys = np.empty(0, np.uint64)
    line_owner = owner[heads]
    lines = np.bincount(line_owner, minlength=n)
    distinct_lines, _ = _distinct_per_doc(line_keys, line_owner, n)
    last_class = _CLASS[body[words.ends - 1]] if len(length) else np.empty(0, np.uint8)
    return np.column_stack([
        classes / many[:, None], np.log1p(size), np.log1p(per_doc), mean,
        np.sqrt(np.maximum(sums(length.astype(float) ** 2) / one - mean**2, 0)), sums(length > 24) / one,
        distinct / one, top / one, same / one, distinct_pairs / np.maximum(per_doc - 1, 1),
        distinct_lines / np.maximum(lines, 1), per_doc / np.maximum(lines, 1),
        sums(length == 1) / one, sums((last_class >= 6) & (last_class <= 8)) / one,
    ])


@dataclass
class Forest:
    """Flattened trees: node i has children 2i + 1 and 2i + 2; leaves are the last level."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # (trees, 2^depth - 1); go right where the value is larger
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Second-order boosting of the logistic loss with level-wise histogram splits; classes weigh alike."""
    n, k = x.shape
    positive = float(y.mean()) if n else 0.5
    if not n or not 0 < positive < 1:
        empty = np.zeros((0, 0))
        return Forest(empty.astype(np.int64), empty, empty, 0.0 if not n else 30.0 * (1 if positive else -1))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)]).astype(np.int64)
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive))
    margin = np.zeros(n)
    feature = np.zeros((trees, 2**depth - 1), np.int64)
    threshold = np.full((trees, 2**depth - 1), np.inf)
    leaf = np.zeros((trees, 2**depth))
    flat = binned + np.arange(k) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (k * bins) + flat).ravel()
            g = np.bincount(place, weights=np.repeat(grad, k), minlength=wide * k * bins).reshape(wide, k, bins)
            h = np.bincount(place, weights=np.repeat(hess, k), minlength=wide * k * bins).reshape(wide, k, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
            gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - (gl + gr) ** 2 / (hl + hr + PENALTY)
            gain[(hl < LEAF_WEIGHT) | (hr < LEAF_WEIGHT)] = 0
            for j in range(k):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for i in range(wide):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9:
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - (2**depth - 1)
        leaf[t] = -RATE * np.bincount(at, weights=grad, minlength=2**depth) / (np.bincount(at, weights=hess, minlength=2**depth) + PENALTY)
        margin += leaf[t][at]
    return Forest(feature, threshold, leaf, 0.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", per_class: int = PER_CLASS) -> Forest:
    """Trees grown on at most ``2 * per_class`` labelled documents; only their statistics reach the driver."""

    def describe(batches):
        for batch in batches:
            x = statistics(batch.column(2))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"],
            )

    sample = labelled_sample(labels, target, learn, per_class)  # at most 2 * per_class rows: fit to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = (
        texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(describe, "doc_id long, label int, x array<double>")
        # rows of one id count once: of several texts the one with the smallest statistics, in every run the same
        .groupBy("doc_id", "label").agg(F.min("x").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return grow_forest(x, np.array([r["label"] for r in rows], np.int64))


def scorer(forest: Forest) -> Callable[[Column], Column]:
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(forest.score(statistics(text)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from the rows that are not held out."""
    learn = remainder(F.col("doc_id"), 3) != 1
    score = scorer(fit(docs, labels, learn))
    return (
        docs.select(F.col("doc_id"), F.col("text"))
        .select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected (score at least 0.5), with all their columns."""
    score = scorer(fit(docs, labels, remainder(F.col("doc_id"), 3) != 1))
    return docs.filter(score(F.col("text")) >= 0.5)
