import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest

from pertlake.llm import periodic_runs
from pertlake.llm.queries import REGISTRY, repeated_tail

from .conftest import ODD_TEXTS, SF

WORD = re.compile("[^\\x20\\x09-\\x0d]+")


def brute_runs(w):
    """Every maximal stretch per period, by comparing words q apart."""
    n, best = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)  # the smallest period of a stretch comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute(i, text, tiling=None):
    w = WORD.findall(text or "")
    change = tiling(i, len(w)) if tiling else None
    if change:
        a, p = change
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def order(rows):
    return sorted(rows, key=repr)


def periodic(rng):
    """Random words with powers of random roots, neighbours and breaks put in."""
    out = []
    for _ in range(rng.integers(1, 5)):
        out += [f"r{x}" for x in rng.integers(0, rng.choice([2, 5, 1000]), rng.integers(0, 60))]
        root = [f"r{x}" for x in rng.integers(0, rng.choice([2, 3, 1000]), rng.integers(1, 70))]
        power = root * int(rng.integers(1, 9)) + root[: rng.integers(0, len(root))]
        if rng.random() < 0.3 and power:
            power[rng.integers(0, len(power))] = "broken"
        out += power
    return " ".join(out)


@pytest.mark.parametrize("seed", range(8))
def test_tiles_of_one_text(seed):
    """Tiles, Z-functions and stitching without Spark, with tiles of one boundary each."""
    rng = np.random.default_rng(seed)
    for _ in range(40):
        w = periodic(rng).split()
        codes = np.unique(w, return_inverse=True)[1].astype(np.uint64)
        spans = set()
        with np.errstate(over="ignore"):
            found = periodic_runs._boundaries(codes, np.array([len(w)]))
        for octave, _, centers in found:
            step = periodic_runs.octave_periods(octave)[2]
            for c in centers.tolist():
                a, b = max(0, c - step - 1), min(len(w), c + 4 * step + 1)
                spans |= {(q, a + x, a + y) for q, x, y in periodic_runs.tile_fragments(codes[a:b].tolist(), [c - a], octave)}
        runs, last = [], None
        for q, x, y in sorted(spans):
            if last and last[0] == q and x <= last[2] - q:
                last[2] = max(last[2], y)
            else:
                last = [q, x, y]
                runs.append(last)
        got = sorted((x, y - x, q) for q, x, y in runs if y - x >= max(24, 3 * q))
        assert got == sorted(brute_runs(w)), w


def test_z_function():
    rng = np.random.default_rng(0)
    for n in range(60):
        s = rng.integers(0, 2, n).tolist()
        z = periodic_runs.z_function(s)
        for i in range(n):
            k = 0
            while i + k < n and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


@pytest.mark.parametrize("tile_words", [16_384, 16])
def test_result_equals_brute_force(spark, docs_of, monkeypatch, tile_words):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", tile_words)
    rng = np.random.default_rng(5)
    rows = [(i, periodic(rng)) for i in range(200)] + [(7, "x " * 100), (7, "x " * 100), (8, "a b c " * 7), (9, "a " * 23), (10, "a " * 24), (None, "b c " * 20), (None, "b c " * 30)]
    rows += [(500 + i, rows[3][1]) for i in range(150)]
    got = periodic_runs.collapse(docs_of(rows), with_text=False)
    assert order(tuple(r) for r in got.collect()) == order(brute(i, t) for i, t in rows)


def test_odd_rows_and_texts(docs_of):
    rows = ODD_TEXTS + [(20, "y" * 3_000_000 + " a b c" * 10), (21, "\x0bz\t" * 40 + "É " * 30)]
    got = periodic_runs.collapse(docs_of(rows)).collect()
    short = {20, 13}  # too long for the brute force
    assert order(tuple(r)[:8] for r in got if r["doc_id"] not in short) == order(brute(i, t) for i, t in rows if i not in short)
    texts = {r["doc_id"]: r["collapsed"] for r in got}
    assert texts[21] == "z É" and texts[20] == "y" * 3_000_000 + " a b c" and texts[1] is None
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got}
    assert runs[21] == [(0, 40, 1), (40, 30, 1)] and runs[20] == [(1, 30, 3)] and runs[13] == [(0, 40_000, 977)]
    assert periodic_runs.collapse(docs_of([])).collect() == []


def test_query_on_the_given_table(spark, sf_docs):
    got = REGISTRY["op13_periodic_runs"](spark, SF).collect()
    assert order(tuple(r) for r in got) == order(brute(i, t, repeated_tail) for i, t in sf_docs.items())
    assert sum(r["n_runs"] > 0 for r in got) >= 10
