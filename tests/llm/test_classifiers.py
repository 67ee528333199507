"""Quality and toxicity: features and trees against plain Python, held-out accuracy, odd rows."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pertlake.llm import quality, queries, toxicity

from .conftest import ODD_TEXTS

SF01 = "/root/testdata/sf0.01"


def test_document_statistics():
    texts = [t for _, t in ODD_TEXTS] + ["a b a b\na b a b\nc | d", "x" * 30 + " y"]
    got = quality.statistics(pa.array(texts))
    at = quality.FEATURES.index
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode()
        for c in b" \t\n\x0b\x0c\r":
            raw = raw.replace(bytes([c]), b" " if c != 10 else b"\n")
        words = raw.split()
        assert row[at("log_bytes")] == pytest.approx(np.log1p(len(raw)))
        assert row[at("log_words")] == pytest.approx(np.log1p(len(words)))
        if words:
            assert row[at("distinct_words")] == pytest.approx(len(set(words)) / len(words))
            assert row[at("top_word")] == pytest.approx(max(Counter(words).values()) / len(words))
            lines = [tuple(x.split()) for x in raw.split(b"\n") if x.split()]
            assert row[at("distinct_lines")] == pytest.approx(len(set(lines)) / len(lines))
            assert row[at("words_per_line")] == pytest.approx(len(words) / len(lines))
            assert row[at("mean_word")] == pytest.approx(np.mean([len(w) for w in words]))
            assert row[at("same_as_previous")] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words))
        else:
            assert row[at("distinct_words")] == 0


def test_forest_learns_and_flattens():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(int)
    forest = quality.grow_forest(x[:2000], y[:2000], trees=60)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95

    def walk(row):  # one row at a time through the same arrays
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return total

    assert forest.margin(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert quality.grow_forest(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.grow_forest(x[:10], np.ones(10, int)).score(x[:2]) > 0.99).all()


def brute_kernel(a, b):
    """The unnormalised string kernel of two words, subsequence by subsequence."""

    def spread(w):
        s = [1, *(int(toxicity._SYMBOL[c]) for c in w.encode())]
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(s))):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = spread(a), spread(b)
    return sum(v * y[u] for u, v in x.items())


def test_subsequence_kernel():
    words = ["idiot", "id.iot", "i.d.i.o.t", "stupid", "banana", "ab", "schön"]
    codes, weights = toxicity._kernel_rows(words)
    table = np.zeros((len(words), toxicity.CODES))
    for i in range(len(words)):
        np.add.at(table[i], codes[i], weights[i])
    got = table @ table.T
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            want = brute_kernel(a, b) / max(np.sqrt(brute_kernel(a, a) * brute_kernel(b, b)), 1e-12)
            assert got[i, j] == pytest.approx(want, abs=1e-5)
    assert got[0, 1] > 0.5 > got[0, 3]


def test_no_hard_words():
    """The first round knows no hard words: the kernel of no words has no rows."""
    codes, weights = toxicity._kernel_rows([])
    assert len(codes) == len(weights) == 0
    assert toxicity._unlike([], 5) == []


@pytest.fixture(scope="module")
def toxic_rows():
    rnd = np.random.default_rng(4)
    plain = ["".join(rnd.choice(list("aeioulnrst"), rnd.integers(3, 9))) for _ in range(400)]
    bad = ["blorfing", "zwackend", "grimpfel"]
    rows, labels = [], []
    for i in range(400):
        words = list(rnd.choice(plain, rnd.integers(5, 60)))
        toxic = i % 3 == 0
        if toxic:
            words.insert(rnd.integers(len(words)), str(rnd.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_finds_altered_insults(spark, docs_of, toxic_rows):
    rows, labels = toxic_rows
    more = [(9001, "he is a Blorfing!"), (9002, "such zw.ackend talk"), (9003, "gri-mpfel"), (9004, "nothing here"), (9005, None), (9006, ""), (9007, "la " * 3000), (9006, "")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(rows + more), frame).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} & set(truth) == set(held)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert [got[i]["predicted"] for i in range(9001, 9008)] == [1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score_documents(docs_of([]), frame).collect() == []
    assert {r["score"] for r in toxicity.score_documents(docs_of(ODD_TEXTS), frame.limit(0)).collect()} == {0.5}


def accuracy(df, target, modulus, rest):
    labels = dict(duckdb.sql(f"SELECT doc_id, {target} FROM '{SF01}/labels.parquet'").fetchall())
    rows = df.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    both = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([a == b for a, b in both])


def test_quality_query_on_held_out_rows(spark):
    assert accuracy(queries.REGISTRY["op6_quality_classifier"](spark, SF01), "quality", 3, 1) > 0.95


def test_toxicity_query_on_held_out_rows(spark):
    assert accuracy(queries.REGISTRY["op5_toxicity"](spark, SF01), "toxic", 5, 0) > 0.85


def test_quality_of_odd_rows(spark, docs_of):
    frame = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(ODD_TEXTS)
    rows = quality.score_documents(docs, frame).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.accepted(docs, frame).columns == docs.columns
    assert quality.score_documents(docs_of([]), frame).collect() == []
    assert {r["score"] for r in quality.score_documents(docs, frame.limit(0)).collect()} == {0.5}
