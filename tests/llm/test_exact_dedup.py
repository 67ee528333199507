import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pertlake.llm import exact_dedup, queries

from .conftest import ODD_TEXTS, SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            stays = i == keep and not done
            done |= stays
            out.append((i, hashlib.sha256(body.encode()).hexdigest(), keep, len(ids), stays))
    return sorted(out, key=KEY)


def test_marks_equal_brute_force(docs_of):
    rows = ODD_TEXTS + [(100 + i, "hot") for i in range(300)] + [(i, "Äß" if i % 2 else "äß") for i in range(500, 520)]
    got = sorted((tuple(r) for r in exact_dedup.annotate(docs_of(rows)).collect()), key=KEY)
    assert got == brute(rows)


def test_equal_digests_do_not_join_different_texts(docs_of):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    weak = lambda c: F.concat(F.lit("d"), (F.length(c) % 2).cast("string"))
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.annotate(docs_of(rows), digest=weak).collect()}
    assert got == {(i, k, n, s) for i, _, k, n, s in brute(rows)}


def test_deduplicate_keeps_whole_rows(docs_of):
    docs = docs_of(ODD_TEXTS)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    want = sorted(((i,) for i, *_, s in brute(ODD_TEXTS) if s), key=KEY)
    assert sorted(((r["doc_id"],) for r in out.collect()), key=KEY) == want
    assert exact_dedup.deduplicate(docs_of([])).collect() == []


def test_query_on_the_given_table(spark, sf_docs):
    got = sorted((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in queries.REGISTRY["op10_exact_dedup"](spark, SF).collect())
    assert got == brute(sf_docs.items())
