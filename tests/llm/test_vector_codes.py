import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from pertlake.llm import vector_codes
from pertlake.llm.vector_codes import Trie, part_edges

SCHEMA = "vec_id long, embedding array<float>, label int, part int, n long, code string, __label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x", 3) for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows):
    """vec_id, code, error, label_error, codebooks_sha256 in plain Python."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    edges = part_edges(width)
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    books = [[cut(v)[p] for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        new = []
        for p in range(8):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            new.append([tuple(sum(c) // len(c) for c in zip(*members[e], strict=True)) if e in members else books[p][e] for e in range(len(books[p]))])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, label, [nearest(p, x) for p, x in enumerate(cut(v))]) for i, v, label in kept]
    by_label = defaultdict(int)
    for _, label, found in coded:
        by_label[label] += sum(d for d, _ in found)
    return sorted(((i, label, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[label], sha) for i, label, f in coded), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(n, width, seed, step=0.0):
    rng = np.random.default_rng(seed)
    at = (lambda x: float(np.round(x / step) * step)) if step else float
    return [(int(i), [at(x) for x in rng.normal(0, 0.3, width)], int(rng.integers(0, 4))) for i in rng.permutation(n)]


@pytest.mark.parametrize("width, step, broadcast_rows", [(16, 0.0, 100), (8, 0.25, 0), (19, 0.1, 0)])
def test_result_equals_brute_force(spark, width, step, broadcast_rows):
    rows = vectors(150, width, width, step)
    rows += [(1000 + i, rows[0][1], None) for i in range(80)]  # one vector and one label hold a third
    assert collected(vector_codes.compress(table(spark, rows), broadcast_rows=broadcast_rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(20, 8, 1) + [
        (100, None, 1), (101, [None] * 8, 1), (102, [nan] + [0.0] * 7, 1), (103, [inf] + [0.0] * 7, None), (104, [0.0] * 7 + [-inf], 2),
        (None, [0.5] * 8, None), (None, [-0.5] * 8, None), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (105, [1.0] * 9, 1), (106, [], 1), (107, [-0.0] * 8, 9),
    ]
    assert collected(vector_codes.compress(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(4, [], 1), (5, [], None)], [(7, [0.1, -0.1, 0.3], 1)], [(i, [0.5] * 8, 1) for i in range(40)]])
def test_small_tables(spark, rows):
    assert collected(vector_codes.compress(table(spark, rows))) == brute(rows)


def test_components_beyond_a_long_raise(spark):
    with pytest.raises(Exception, match="op12: a component is beyond"):
        vector_codes.compress(table(spark, [(1, [1e30] * 8, 1)])).collect()


@pytest.mark.parametrize("block", [1, 3, 50, 4096])
@pytest.mark.parametrize("values, width", [(2, 6), (9, 3), (1, 2), (1000, 4)])
def test_trie_equals_all_distances(block, values, width):
    rng = np.random.default_rng(values)
    parts = rng.integers(0, values, (300, width))
    parts = parts[np.lexsort(parts.T[::-1])]
    book = rng.integers(0, values + 1, (16, width))
    want = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    best, distance = Trie(parts, block).nearest(book)
    assert (best == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
