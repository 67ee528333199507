"""Operator 5, toxicity: a subsequence string-kernel SVM with Nyström landmarks.

Kernel: words are compared by their gapped subsequences of three characters that span at
most ``SPAN`` characters; each occurrence counts DECAY to the power of its span, so an
insult with a character put in, or letters spread by dots, still shares most subsequences.
The kernel is normalised to 1 for equal words. A start mark is a character of its own.

Training, on the sentences of a bounded sample of labelled documents (``PER_CLASS``):
words that occur nearly only in sentences of toxic documents are positive (weighing as many
as the documents that hold them), words of other documents negative. Landmarks are chosen
from both, the positive ones each as unlike the earlier ones as can be; words become their kernel values with
the landmarks times the inverse square root of the landmark kernel (Nyström); a linear SVM
with squared hinge loss is solved there, then again after adding the words of other documents it got
wrong, with landmarks among them (``ROUNDS`` times, at most ``NEGATIVE_WORDS`` each). The result folds into one weight per subsequence, so a word's margin is a sum of
table look-ups. A document's score is a logistic function of its largest word margin and
its numbers of words beyond two margins, fitted on the sample's documents.

Scoring reads every word of every whole text; words longer than ``WIDTH`` characters are
taken in overlapping windows; distinct words are scored once per batch of text.

Defined results: null and empty texts have no words and score as texts without any insult;
without labels of both kinds the score is the share of label 1 (0.5 without labels);
repeated rows are scored alike; very long texts and words are scored whole, ``ROWS`` windows at
a time; only the columns named here are read, so others may clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import materialize
from pertlake.llm.text_hash import Words, doc_buffers, doc_chunks
from pertlake.llm.training_rows import labelled_sample, remainder

PER_CLASS = 4_000
POSITIVE_WORDS, NEGATIVE_WORDS, LANDMARKS, ROUNDS = 1_500, 5_000, 512, 3
MARGINS = (0.0, 0.5)
LEAST_SUPPORT, LEAST_NEGATIVE = 3, 0.02
SPAN, DECAY, WIDTH, OVERLAP = 5, 0.5, 24, 6
ROWS = 8_192  # windows scored at a time
HARD_WORDS = 1_500  # that landmarks are chosen from
COST = 20_000.0  # of all positive, and of all negative, words together
SYMBOLS = 64
CODES = SYMBOLS**3

# byte -> symbol: 0 nothing, 1 word start, 2-27 letters (either case), 28 digits, 29-31 other ASCII, 32-63 bytes beyond ASCII
_SYMBOL = np.full(256, 29, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(2, 28)
_SYMBOL[48:58] = 28
_SYMBOL[[ord(c) for c in "-_'"]] = 30
_SYMBOL[[ord(c) for c in ".*@$!"]] = 31
_SYMBOL[128:] = 32 + (np.arange(128, 256) & 31)

_EDGE = np.zeros(256, bool)  # characters dropped at a word's ends
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>|*#$%&/\\-_=+~^`@"]] = True
_PLACES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def window_places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owning word, first byte, is it the word's first window) of every window; long words have several."""
    step = WIDTH - OVERLAP
    rows = np.maximum(1, -(-(ends - starts - OVERLAP) // step))
    owner = np.repeat(np.arange(len(starts)), rows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return owner, starts[owner] + nth * step, nth == 0


def symbols_at(body: np.ndarray, at: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the windows at ``at``, a row each, after the start mark of a word's first window."""
    symbols = np.zeros((len(at), WIDTH + 1), np.int32)
    if len(at):
        place = at[:, None] + np.arange(WIDTH)
        symbols[:, 1:] = np.where(place < ends[:, None], _SYMBOL[body[np.minimum(place, len(body) - 1)]], 0)
        symbols[:, 0] = first
    return symbols


def symbol_rows(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in rows of WIDTH + 1 with the start mark, owning word): long words take several rows."""
    owner, at, first = window_places(starts, ends)
    return symbols_at(body, at, ends[owner], first), owner


def subsequences(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of all gapped subsequences, a row per word; unused places have weight 0."""
    codes, weights = [], []
    width = symbols.shape[1]
    for a, b in _PLACES:
        x, y, z = symbols[:, : width - b], symbols[:, a : width - b + a], symbols[:, b:]
        codes.append((x * SYMBOLS + y) * SYMBOLS + z)
        weights.append(np.where((x > 0) & (z > 0), np.float32(DECAY ** (b + 1)), np.float32(0)))
    return np.concatenate(codes, 1), np.concatenate(weights, 1)


def self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself: repeated subsequences add up before squaring."""
    order = np.argsort(codes, axis=1)
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1).astype(np.float64)
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    total = np.bincount(group, weights=w.ravel())
    row = np.flatnonzero(new.ravel()) // c.shape[1]
    return np.bincount(row, weights=total**2, minlength=len(c))


@dataclass
class Model:
    weight: np.ndarray  # of each subsequence code
    bias: float
    margin: tuple[float, ...]  # logistic: constant, largest margin, logs of the numbers of words beyond MARGINS

    def word_margins(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The SVM margin of each word (its best window), -1 - |bias| for words without subsequences."""
        out = np.full(len(starts), -1.0 - abs(self.bias))
        owner, at, first = window_places(starts, ends)
        for a in range(0, len(owner), ROWS):  # windows, not words: a word may be as long as a text
            mine = owner[a : a + ROWS]
            codes, weights = subsequences(symbols_at(body, at[a : a + ROWS], ends[mine], first[a : a + ROWS]))
            norm = np.sqrt(self_kernel(codes, weights))
            value = (self.weight[codes] * weights).sum(1) / np.maximum(norm, 1e-12) + self.bias
            value[norm == 0] = -1.0 - abs(self.bias)
            np.maximum.at(out, mine, value)
        return out

    def document_features(self, column: pa.Array) -> np.ndarray:
        """(largest word margin, logs of one plus the numbers of words beyond MARGINS) of each text."""
        np.seterr(over="ignore")
        body, offsets = doc_buffers(column)
        out = np.zeros((len(offsets) - 1, 1 + len(MARGINS)))
        for a, b in doc_chunks(offsets):
            part = body[offsets[a] : offsets[b]]
            words = Words(part, offsets[a : b + 1] - offsets[a], True)
            _, some, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            starts, ends = trimmed(part, words.starts[some], words.ends[some])
            margins = self.word_margins(part, starts, ends)[inverse]
            owner = np.repeat(np.arange(b - a), np.diff(words.doc_words))
            top = np.full(b - a, -2.0)
            np.maximum.at(top, owner, margins)
            out[a:b, 0] = np.clip(top, -2, 2)
            for k, least in enumerate(MARGINS, 1):
                out[a:b, k] = np.log1p(np.bincount(owner[margins > least], minlength=b - a))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.document_features(column)
        z = self.margin[0] + x @ np.array(self.margin[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def trimmed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without the punctuation around them (at most WIDTH characters of it at either end)."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(WIDTH):
        a = (starts < ends) & _EDGE[body[np.minimum(starts, len(body) - 1)]]
        starts[a] += 1
        b = (starts < ends) & _EDGE[body[np.maximum(ends - 1, 0)]]
        ends[b] -= 1
        if not a.any() and not b.any():
            break
    return starts, ends


def _kernel_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and normalised weights of whole words (their first window)."""
    raw = [w.encode()[:WIDTH] for w in words]
    body = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    lengths = np.array([len(r) for r in raw], np.int64)  # of no words too
    ends = np.cumsum(lengths)
    symbols, owner = symbol_rows(body, ends - lengths, ends)
    codes, weights = subsequences(symbols)
    return codes, weights / np.sqrt(np.maximum(self_kernel(codes, weights), 1e-12))[:, None]


def _spread(words: list[str], n: int) -> list[str]:
    """``n`` of the words at even steps of their order."""
    return words if len(words) <= n else [words[i * len(words) // n] for i in range(n)]


def _unlike(words: list[str], n: int) -> list[str]:
    """Up to ``n`` words, each with the largest part outside the span of the earlier ones (pivoted Cholesky)."""
    codes, weights = _kernel_rows(words)
    left = np.ones(len(words))
    basis = np.zeros((len(words), 0))
    chosen: list[str] = []
    for _ in range(min(n, len(words))):
        i = int(left.argmax())
        if left[i] < 1e-3:
            break
        dense = np.zeros(CODES)
        np.add.at(dense, codes[i], weights[i])
        column = (dense[codes] * weights).sum(1)
        new = (column - basis @ basis[i]) / np.sqrt(left[i])
        basis = np.column_stack([basis, new])
        left = np.maximum(left - new**2, 0)
        left[i] = 0
        chosen.append(words[i])
    return chosen


class WordMachine:
    """The Nyström SVM over words; ``solve`` may be called again with more negatives."""

    def __init__(self, positive: dict[str, int], negative: list[str], hard: list[str]):
        """``positive`` words with the number of documents that hold them; ``hard`` are negatives near the boundary."""
        self.positive, self.negative = sorted(positive), negative
        support = np.array([positive[w] for w in self.positive], float)
        self._share = support / support.sum()
        landmarks = _unlike(self.positive, LANDMARKS // 2)
        landmarks += _unlike(hard[:HARD_WORDS], 3 * LANDMARKS // 8) + _spread(negative, LANDMARKS // 8)
        codes, weights = _kernel_rows(landmarks)
        # the landmarks' subsequences are few: one column each, column 0 for all others
        self._known = np.unique(codes[weights > 0])
        self._column = np.zeros(CODES, np.int32)
        self._column[self._known] = np.arange(1, len(self._known) + 1)
        self._table = np.zeros((len(landmarks), len(self._known) + 1), np.float32)
        for i in range(len(landmarks)):
            np.add.at(self._table[i], self._column[codes[i]], weights[i])
        self._table[:, 0] = 0
        values, vectors = np.linalg.eigh(self._against_landmarks(landmarks))
        good = values > 1e-4
        self._root = vectors[:, good] / np.sqrt(values[good])

    def _against_landmarks(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self._table)))
        for a in range(0, len(words), 64):
            c, w = _kernel_rows(words[a : a + 64])
            out[a : a + 64] = np.einsum("lnk,nk->nl", self._table[:, self._column[c]], w.astype(np.float32), optimize=False)
        return out

    def solve(self) -> tuple[np.ndarray, float]:
        """(weight per subsequence, bias)."""
        z = self._against_landmarks(self.positive + self.negative) @ self._root
        z = np.column_stack([z, np.ones(len(z))])
        n_pos, n_neg = len(self.positive), len(self.negative)
        y = np.r_[np.ones(n_pos), -np.ones(n_neg)]
        cost = np.r_[self._share, np.full(n_neg, 1 / max(n_neg, 1))] * COST
        beta = np.zeros(z.shape[1])
        ridge = np.ones(z.shape[1])
        ridge[-1] = 1e-3
        for _ in range(40):  # Newton steps of the squared hinge loss
            inside = y * (z @ beta) < 1
            zi, yi, ci = z[inside], y[inside], cost[inside]
            new = np.linalg.solve((zi * ci[:, None]).T @ zi + np.diag(ridge), zi.T @ (ci * yi))
            if np.allclose(new, beta, atol=1e-8):
                break
            beta = new
        weight = np.zeros(CODES, np.float32)
        weight[self._known] = (self._root @ beta[:-1]) @ self._table[:, 1:]
        return weight, float(beta[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - 1e-2 * beta
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sentence_words(texts: DataFrame) -> DataFrame:
    """(doc_id, label, word) of every distinct word of every sentence of labelled texts."""
    sentence = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.!?\n]+\s*"))
    return (
        texts.select("doc_id", "label", sentence.alias("sentence"))
        .select("doc_id", "label", F.explode(F.array_distinct(F.split("sentence", r"[^\p{L}\p{N}'*@$-]+"))).alias("word"))
        .filter(F.length("word") >= 3)
    )


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model of at most ``2 * per_class`` labelled documents."""
    sample = labelled_sample(labels, target, learn, per_class)  # bounded: fit to broadcast
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    nothing = np.zeros(CODES, np.float32)
    if not n_pos or not n_neg:
        return Model(nothing, 0.0, (0.0 if not sizes else 30.0 if n_pos else -30.0, *[0.0] * (1 + len(MARGINS))))
    table = materialize(
        sentence_words(texts).groupBy("word", "doc_id", "label").agg(F.count(F.lit(1)).alias("sentences"))
        .groupBy("word").agg(
            F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"),
        ),
        "op5-words",
    )
    # a positive word must be in more toxic documents than any of all the words would be by chance
    by_chance = np.log(max(table.count(), 2)) / np.log(1 + n_neg / n_pos)
    least = max(LEAST_SUPPORT, int(np.ceil(by_chance)))
    most_neg = LEAST_NEGATIVE * n_neg / n_pos
    chosen = table.filter((F.col("pos") >= least) & (F.col("neg") <= F.col("pos") * most_neg)).orderBy(F.desc("pos"), "word").limit(POSITIVE_WORDS).collect()
    others = table.filter((F.col("neg") > 0) & (F.col("neg") * n_pos >= F.col("pos") * n_neg * 0.5))
    frequent = others.orderBy(F.desc("neg"), "word").limit(NEGATIVE_WORDS // 2).collect()
    rare = others.orderBy(F.xxhash64("word"), "word").limit(NEGATIVE_WORDS // 2).collect()
    positive = {r["word"]: r["pos"] for r in chosen}
    if not positive:
        return Model(nothing, 0.0, (float(np.log(n_pos / n_neg)), *[0.0] * (1 + len(MARGINS))))
    negative, hard = sorted({r["word"] for r in frequent} | {r["word"] for r in rare}), []
    for _ in range(ROUNDS):
        weight, bias = WordMachine(positive, negative, hard).solve()
        margin = _word_margin(Model(weight, bias, ()))(F.col("word"))
        wrong = others.select("word", margin.alias("margin")).filter("margin > -0.7").orderBy(F.desc("margin"), "word").limit(NEGATIVE_WORDS).collect()
        hard = [r["word"] for r in wrong]
        negative = sorted({*negative, *hard})
    weight, bias = WordMachine(positive, negative, hard).solve()
    model = Model(weight, bias, ())

    def describe(batches):
        for batch in batches:
            x = model.document_features(batch.column(2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["doc_id", "label", "x"])

    # of several texts under one id the one with the smallest features counts, in every run the same
    rows = texts.mapInArrow(describe, "doc_id long, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    beta = _logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return Model(weight, bias, tuple(float(b) for b in beta))


def _word_margin(model: Model) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def margin(word: pa.Array) -> pa.Array:
        body, offsets = doc_buffers(word)
        return pa.array(model.word_margins(body, offsets[:-1], offsets[1:]))

    return margin


def scorer(model: Model) -> Callable[[Column], Column]:
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from the rows that are not held out."""
    held_out = remainder(F.col("doc_id"), 5) == 0
    score = scorer(fit(docs, labels, remainder(F.col("doc_id"), 5) != 0))
    return (
        docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
