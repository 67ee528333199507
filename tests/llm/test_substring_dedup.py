import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pertlake.llm import queries, substring_dedup
from pertlake.llm.text_hash import Words, window_hashes

from .conftest import ODD_TEXTS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


KEY = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


def check(df, rows, window=35):
    assert sorted((tuple(r[:4]) for r in df.collect()), key=KEY) == sorted(brute(rows, window), key=KEY)


def passages(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 50))]
            if rnd.random() < 0.6:
                words += shared[rnd.randrange(6)]
        rows.append((i, " ".join(words)))
    rows += [(n, "same " * 200), (n + 1, "a b " * 60), (n + 2, " ".join(shared[0] * 3))]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_repeats_equal_brute_force(docs_of, seed):
    rows = passages(seed)
    check(substring_dedup.remove_repeats(docs_of(rows)), rows)


def test_odd_texts(docs_of):
    rows = ODD_TEXTS + [(500, ODD_TEXTS[15][1]), (501, "É " * 40), (501, "É " * 40)]
    check(substring_dedup.remove_repeats(docs_of(rows)), rows)
    assert substring_dedup.remove_repeats(docs_of([])).collect() == []


def test_frequent_minimizers_are_spread_over_parts(docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_SEGMENTS", 5)
    rows = passages(3, 60) + [(1000 + i, "head%d " % i + " ".join(f"p{k}" for k in range(60)) + " tail%d" % i) for i in range(40)]
    check(substring_dedup.remove_repeats(docs_of(rows)), rows)


def test_references_of_a_frequent_minimizer_are_split(docs_of, monkeypatch):
    rnd = random.Random(9)
    fresh = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]

    def rank(w):
        body = np.frombuffer(" ".join(w).encode(), np.uint8)
        return int(window_hashes(Words(body, np.array([0, len(body)]), False).hashes, substring_dedup.SEED)[0])

    # a run of SEED words that is the minimizer of nearly every window that holds it
    line = next(w for w in iter(lambda: fresh(substring_dedup.SEED), None) if rank(w) < 2**64 // 500)
    rows = []
    for i in range(40):
        text = " ".join(fresh(40) + line + fresh(40))
        rows += [(2 * i, text), (2 * i + 1, "other " + text)]
    dealt, match = [], substring_dedup.matched_spans

    def seen(parts, references, window):
        dealt.extend(r["count"] for r in references.distinct().groupBy("shard", "part").count().collect())
        return match(parts, references, window)

    monkeypatch.setattr(substring_dedup, "matched_spans", seen)
    monkeypatch.setattr(substring_dedup, "PART_SEGMENTS", 5)
    check(substring_dedup.remove_repeats(docs_of(rows)), rows)
    assert max(dealt) < 40


def test_beyond_the_broadcast_limits(docs_of, monkeypatch):
    from pertlake.llm import common

    monkeypatch.setattr(substring_dedup, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = passages(6, 60) + [(2000, "same " * 100), (2000, "same " * 100)]
    check(substring_dedup.remove_repeats(docs_of(rows)), rows)


def test_kept_text_is_the_digested_text(docs_of):
    rows = passages(4, 30)
    for r in substring_dedup.remove_repeats(docs_of(rows)).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_matching_statistics():
    rnd = random.Random(7)
    for _ in range(60):
        refs = [[rnd.choice("abc") for _ in range(rnd.randrange(1, 12))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for r in refs:
            automaton.add(r)
        text = [rnd.choice("abcd") for _ in range(30)]
        joined = ["".join(r) for r in refs]
        for end, n in enumerate(automaton.matching_statistics(text), 1):
            want = max(k for k in range(end + 1) if any("".join(text[end - k : end]) in j for j in joined))
            assert n == want
        # maximal spans cover exactly the words of long enough matches
        stats = automaton.matching_statistics(text)
        covered = {w for end, n in enumerate(stats, 1) if n >= 3 for w in range(end - n, end)}
        assert covered == {w for a, b in substring_dedup.maximal_spans(stats, 3) for w in range(a, b)}


def test_query_on_the_given_table(spark, sf_docs):
    check(queries.REGISTRY["op1_substring_dedup"](spark, SF), list(sf_docs.items()))
