import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertlake.llm import graph, ngram_join, queries
from pertlake.llm.graph import components

from .conftest import ODD_TEXTS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, s in enumerate(sets):
        if s:
            parent[root(i)] = root(first.setdefault(s, i))
    for a, b in combinations(first, 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            parent[root(first[a])] = root(first[b])
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return [(d, len(sets[i]), ids.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


KEY = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


def check(df, rows):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=KEY)
    assert got == sorted(brute(rows), key=KEY)


def copies(seed, n=130):
    """Families of near copies around the threshold, with lines that most documents share."""
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    line = [rnd.choice(vocabulary) for _ in range(12)]
    rows, families = [], [[rnd.choice(vocabulary) for _ in range(rnd.randrange(6, 120))] for _ in range(8)]
    for i in range(n):
        words = list(rnd.choice(families)) if rnd.random() < 0.8 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 60))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.6:
            words += line
        rows.append((1000 - i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 32, 1 << 17), (2, 2, 3)])
def test_components_equal_brute_force(docs_of, seed, least, most):
    rows = copies(seed)
    check(ngram_join.near_duplicates(docs_of(rows), hot_least=least, hot_most=most), rows)


def test_chains_link_across_many_leaders(docs_of):
    # each text shares enough with its neighbours only, and one rare line with all
    base = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(base[4 * i : 4 * i + 60] + ["x1", "x2", "x3", "x4", "x5"])) for i in range(60)]
    check(ngram_join.near_duplicates(docs_of(rows), hot_least=2), rows)


def test_odd_texts(docs_of):
    rows = ODD_TEXTS + [(90, "a b c d"), (91, "A b\tc D"), (92, "a b c d e"), (None, "a b c d"), (93, " ")]
    check(ngram_join.near_duplicates(docs_of(rows)), rows)
    assert ngram_join.near_duplicates(docs_of([])).collect() == []


def test_one_of_each_keeps_whole_rows(docs_of):
    rows = copies(5, 60) + [(5000, None), (5001, "")]
    docs = docs_of(rows)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in brute(rows)})


def test_one_of_each_keeps_one_row_where_ids_are_odd(docs_of):
    base = [f"o{i}" for i in range(80)]
    near = lambda k, tag: " ".join(f"{tag}{w}" for w in base[:-k])
    rows = [(None, near(k, "a")) for k in (1, 2, 3)] + [(7, near(k, "b")) for k in (1, 2, 3)] + [(8, near(4, "b"))]
    rows += [(None, near(1, "c")), (9, near(2, "c")), (9, near(2, "c")), (None, None), (None, ""), (10, "")]
    out = [r["doc_id"] for r in ngram_join.one_of_each(docs_of(rows)).collect()]
    assert sorted(out, key=str) == sorted([None, 7, 9, None, None, 10], key=str)


def test_texts_that_share_too_little_have_no_buckets(docs_of, monkeypatch):
    rnd = random.Random(4)
    line = [f"s{i}" for i in range(14)]
    rows = [(i, " ".join([f"u{rnd.randrange(10**9)}" for _ in range(40)] + line)) for i in range(60)] + copies(6, 40)
    rows += [(500 + i, rows[i][1]) for i in range(0, 80, 7)]
    docs = docs_of(rows)
    sets = {i: shingles(t) for i, t in rows}
    holders = Counter(s for distinct in set(sets.values()) for s in distinct)
    for packed in (1 << 20, 50):  # one chunk a task and one range; many of both
        monkeypatch.setattr(ngram_join, "PACKED", packed)
        texts = ngram_join._texts(docs, "doc_id", "text")
        described = ngram_join.describe(texts)
        total = sum(map(len, sets.values()))
        counted = {r["class"]: (r["n"], r["held"]) for r in ngram_join.held_counts(texts, total).collect()}
        class_of = {r["doc_id"]: r["class"] for r in described.collect()}
        for i, s in sets.items():
            n, held = counted[class_of[i]]
            exact = sum(holders[x] > 1 for x in s)
            # the copies of a class in other input tasks may count as another class
            assert n == len(s) and exact <= held <= n
        one = described.groupBy("class").agg(F.min("row_key").alias("row_key"))
        near, likely = ngram_join.likely_classes(texts, one, total)
        kept = {r["class"] for r in likely.collect()}
        # whatever links goes on; texts that share a line only don't
        linked = {i for i, s in sets.items() if any(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in sets.values())}
        assert linked and {class_of[i] for i in linked} <= kept
        assert not {class_of[i] for i in range(60)} & kept
        assert near.count() < len(rows) - 40


def just_below(seed, n, words=100, tag="g"):
    """Copies of one text with two words exchanged, so most pairs are just below the threshold; of some only one word is."""
    rnd = random.Random(seed)
    base = [f"{tag}{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rnd.sample(range(10, words - 10), 1 if i % 40 == 0 else 2):
            text[at] = f"{tag}x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    return rows


def test_pairs_compared_grow_with_the_classes_of_a_group(docs_of, monkeypatch):
    # no bound settles these pairs: half of all 19,900 would be compared one by one
    rows = just_below(7, 200)
    compared = []
    overlaps = ngram_join.overlaps

    def counted(pairs, n_pairs, sets):
        compared.append(n_pairs)
        return overlaps(pairs, n_pairs, sets)

    monkeypatch.setattr(ngram_join, "overlaps", counted)
    check(ngram_join.near_duplicates(docs_of(rows)), rows)
    assert sum(compared) < 10 * len(rows)


@pytest.mark.parametrize(("small", "block", "shingles"), [(2, 7, 1 << 20), (1, 1024, 300)])
def test_blocks_of_large_buckets_equal_brute_force(docs_of, monkeypatch, small, block, shingles):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    rows = copies(8) + just_below(9, 60, 60) + [(i, t + " " + " ".join(f"e{j}" for j in range(i % 5))) for i, t in just_below(10, 30, 40, "h")]
    rows += [rows[3], rows[3], (None, rows[140][1]), (None, rows[150][1] + " more"), (4000, None), (4001, "")]
    check(ngram_join.near_duplicates(docs_of(rows), hot_least=8, hot_most=40), rows)


def test_partial_overlaps_and_their_forest():
    rnd = np.random.default_rng(11)
    side = lambda n: [np.unique(rnd.integers(0, 400, rnd.integers(0, 90))).astype(np.int64) * 2**54 for _ in range(n)]
    for a, b in ((1, 1), (40, 25), (300, 7)):
        left, right = side(a), side(b)
        exact = [[len(np.intersect1d(x, y)) for y in right] for x in left]
        assert ngram_join._partial_overlaps(left, right).tolist() == exact
        linked = np.array(exact) >= 12
        forest = ngram_join._forest(linked)
        assert all(linked[i, j] for i, j in forest) and len(set(forest)) == len(forest)
        # as many links as nodes less components
        parent = list(range(a + b))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in zip(*np.nonzero(linked)):
            parent[root(int(i))] = root(a + int(j))
        assert len(forest) == a + b - sum(parent[i] == i for i in range(a + b))
        for i in range(a + b):
            parent[i] = root(i)
        whole = list(parent)
        parent[:] = range(a + b)
        for i, j in forest:
            parent[root(i)] = root(a + j)
        assert len({(whole[i], root(i)) for i in range(a + b)}) == len(set(whole))


def test_query_on_the_given_table(spark, sf_docs):
    check(queries.REGISTRY["op9_ngram_join"](spark, SF), list(sf_docs.items()))


def test_components_of_random_links(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    parent = {}
    for a, b in links:
        if a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        ra, rb = a, b
        while parent[ra] != ra:
            ra = parent[ra]
        while parent[rb] != rb:
            rb = parent[rb]
        parent[max(ra, rb)] = min(ra, rb)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent}


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_LINKS", local)
    rnd = random.Random(12)
    links = [(i, i + 1) for i in range(-30, 30)] + [(1000 + i, 1000 + (i * 7 + 3) % 90) for i in range(90)] + [(2**62, -(2**62)), (500, 500), (501, 500), (501, 500)]
    rnd.shuffle(links)
    lowest = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in links:
        for a, b in links:
            if a != b:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    out = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted((r["node"], r["component"]) for r in out.collect()) == sorted(lowest.items())
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
