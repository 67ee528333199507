import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pertlake.llm import line_dedup

from .conftest import ODD_TEXTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows):
    holders = defaultdict(set)
    rank = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders[key_of(line)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def lined(n, seed):
    rng = np.random.default_rng(seed)
    line = lambda: f"  Line number {rng.integers(0, 400)} of the pool\t" if rng.random() < 0.8 else ["", "short", "ÉÄ ten chars ñ", "\x0bsame LINE again\r"][rng.integers(4)]
    return [(int(i), "\n".join(line() for _ in range(rng.integers(0, 12)))) for i in rng.permutation(n)]


ODD_LINES = [
    (1, None), (2, ""), (3, "\n"), (4, "the common line\nonly here, once\nthe common line"), (5, " THE COMMON LINE \n\nshort\nshort"),
    (None, "the common line\nwithout any id"), (None, "without any id"), (6, "without any id\n"), (7, "repeated row line"), (7, "repeated row line"),
    (8, "nine char\nnine char"), (9, "nine char"), (10, "É" * 10 + "\nx"), (11, "é" * 10), (12, "É" * 10), (13, "y" * 3_000_000 + "\nthe common line"),
    (14, "y" * 3_000_000), (15, "\n".join(["a line of a long text", "b"] * 50_000)), (16, "a line of a long text"), (2**63 - 1, "without any id"),
]


@pytest.mark.parametrize("shard_keys, hot_parts", [(8_192, 4_096), (50, 1), (7, 20)])
def test_result_equals_brute_force(docs_of, shard_keys, hot_parts):
    rows = lined(400, 3) + [(1000 + i, "one very common line\nand its own line %d" % (i // 2)) for i in range(300)]
    got = line_dedup.remove_lines(docs_of(rows), shard_keys=shard_keys, hot_parts=hot_parts)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_odd_rows(docs_of):
    rows = ODD_LINES + ODD_TEXTS
    assert sorted((tuple(r) for r in line_dedup.remove_lines(docs_of(rows)).collect()), key=repr) == brute(rows)
    assert line_dedup.remove_lines(docs_of([])).collect() == []
    assert [r["n_dropped"] for r in line_dedup.remove_lines(docs_of([(1, "alone in the table"), (2, None)])).collect()] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal_and_survives_a_round_trip(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    index = line_dedup.PerfectHash.of(keys)
    assert sorted(index.place(keys).tolist()) == list(range(len(keys)))
    again = line_dedup.PerfectHash.load(index.dump())
    assert (again.place(keys) == index.place(keys)).all()


def test_digests_that_share_a_half_stay_apart():
    key = np.array([5, 5, 9, 5], np.uint64)
    print_ = np.array([1, 2, 1, 3], np.uint64)
    shard = line_dedup.Shard.load(*line_dedup.Shard.of(key, print_, np.array([2, 3, 4, 5]), np.array([10, 20, 30, 40])).dump())
    hit, lowest = shard.found(np.array([5, 5, 9, 5, 5, 8], np.uint64), np.array([3, 1, 1, 2, 4, 77], np.uint64))
    assert hit.tolist() == [True, True, True, True, False, False]
    assert lowest[:4].tolist() == [40, 10, 30, 20]
