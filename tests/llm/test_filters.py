"""URL filter, decontamination and chat formatting against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pertlake.llm import chat, decontamination, queries, url_filter

from .conftest import ODD_TEXTS, SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_urls(rows):
    """page_id, host, path, rule, verdict, score with plain dictionaries."""
    order, judged, counts = url_filter.ORDER, [], {"allow": Counter(), "block": Counter()}
    for i, url in rows:
        host, path = split_url(url)
        verdict, rule = brute_rule(host, path)
        text = "\2" * order + re.sub("[0-9]", "0", url or "").translate(LOWER) + "\3"
        judged.append((i, host, path, rule, verdict, text))
    for *_, verdict, text in judged:
        for at in range(order, len(text)):
            for k in range(order + 1):
                if verdict:
                    counts[verdict][text[at - k : at + 1]] += 1
    contexts = {}
    for v, table in counts.items():
        seen, kinds = Counter(), Counter()
        for g, n in table.items():
            seen[g[:-1], len(g)] += n
            kinds[g[:-1], len(g)] += 1
        contexts[v] = seen, kinds

    def logp(v, text, at):
        p = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            g = text[at - k : at + 1]
            n, t = contexts[v][0][g[:-1], len(g)], contexts[v][1][g[:-1], len(g)]
            if n:
                p = (counts[v][g] + t * p) / (n + t)
        return math.log(p)

    score = {t: sum(logp("allow", t, a) - logp("block", t, a) for a in range(order, len(t))) / (len(t) - order) for *_, t in judged}
    a = sorted(score[t] for *_, v, t in judged if v == "allow")
    b = sorted(score[t] for *_, v, t in judged if v == "block")
    return judged, score, a, b


def check_urls(got, rows):
    judged, score, a, b = brute_urls(rows)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"], r["score"]))
    assert sum(map(len, by.values())) == len(rows)
    accepted = [s for v in by.values() for *_, rule, verdict, s in v if rule is None and verdict == "allow"]
    blocked = [s for v in by.values() for *_, rule, verdict, s in v if rule is None and verdict == "block"]
    assert not accepted or not blocked or min(accepted) > max(blocked)
    for i, host, path, rule, verdict, text in judged:
        match = [g for g in by[i] if g[:3] == (host, path, rule) and abs(g[4] - score[text]) < 1e-6]
        assert match, (i, text)
        assert verdict is None or match[0][3] == verdict
    if a and b:  # the threshold is as good as any on the decided urls, up to a bin's width
        cut = lambda t: sum(x >= t for x in a) / len(a) + sum(x < t for x in b) / len(b)
        edges = [-url_filter.SPAN + k * 2 * url_filter.SPAN / url_filter.BINS for k in range(url_filter.BINS + 1)]
        best = max(cut(t) for t in edges)
        used = [t for t in edges if (not accepted or t <= min(accepted) + 0.02) and (not blocked or t > max(blocked) - 0.02)]
        assert used and best - max(cut(t) for t in used) < 0.02


URLS = [
    (1, "http://A.net/x?q#f"), (2, "https://www.Example.NET/en/12"), (3, "https://example.net/en"), (4, "ftp://example.com/de/9"), (5, "https://xexample.com/de/9"),
    (6, "https://m.example.org/fr/77"), (7, "https://m.example.org/en/77"), (8, None), (9, ""), (10, "no scheme/net/"), (11, "http://net"), (12, "http://a.net?x=/"),
    (13, "https://b.org/fr/://c.net/"), (13, "https://b.org/fr/://c.net/"), (14, "://x.net/"), (None, "https://q.example.com/fr/5"), (15, "https://ü.example.com/es/" + "z" * 3000), (16, "a\nb://c\n.net/\n"),
]


def test_url_filter_equals_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in URLS], "page_id long, url string, host string, rule string, score int")
    check_urls(url_filter.filter_urls(df).collect(), URLS)


def test_long_urls_are_scored_whole(spark):
    rnd = random.Random(2)
    rows = [(1, "https://a.org/fr/" + "".join(rnd.choice("abc/") for _ in range(1_000_000))), (2, "https://b.de/" + "".join(rnd.choice("xyz-") for _ in range(300_000))), (3, "https://c.net/q")]
    check_urls(url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect(), rows)


def test_url_filter_without_rows_or_decided_urls(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(empty).collect() == []
    plain = spark.createDataFrame([(1, "http://x.de/a"), (2, None)], "page_id long, url string")
    assert {(r["verdict"], r["score"]) for r in url_filter.filter_urls(plain).collect()} == {("allow", 0.0)}


def test_url_query_on_the_given_table(spark):
    rows = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    check_urls(queries.REGISTRY["op3_url_filter"](spark, SF).collect(), rows)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute_leaks(docs, items):
    """(doc_id, item_id) whose best item-sized window holds enough of the item's shingles."""
    plain = [(i, words(t)) for i, t in items if words(t)]
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in plain:
            k = min(5, len(item))
            own = Counter(runs(item, k))
            for start in range(-len(item) + 1, len(w)):
                window = Counter(runs(w[max(start, 0) : start + len(item)], k))
                share = sum(min(n, window[s]) for s, n in own.items()) / sum(own.values())
                if share >= 0.75 - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), share)
    return out


def check_leaks(got, docs, items):
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    for r in got:
        assert r["similarity"] == pytest.approx(want[r["doc_id"], r["item_id"]], abs=1e-5)
        assert 0 <= r["distance"] <= decontamination.RADIUS


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"), (2, "one two three"),
    (3, None), (4, ""), (5, "repeat repeat repeat repeat repeat repeat repeat repeat repeat"), (5, "one two three four five six seven eight nine ten eleven twelve"),
    (6, "Ärger über große Öfen macht jeden Tag viele müde Leute sehr froh und munter heute"),
]


def test_leaks_equal_brute_force(spark, docs_of):
    rows = ODD_TEXTS[:12] + [
        (20, "x y " + ITEMS[0][1].upper() + "!! z"), (21, "x " + ITEMS[0][1].replace("kappa", "k2")), (22, ITEMS[0][1][:60]), (23, "ÄRGER ÜBER, GROSSE " + ITEMS[6][1].upper()),
        (24, "one, two. three"), (25, "one two 3 three"), (26, "repeat " * 40), (27, "one two three four five six seven eight nine ten eleven"), (None, ITEMS[0][1]), (20, "again"),
        (28, (ITEMS[0][1] + " pad ") * 50),
    ]
    bench = spark.createDataFrame([(i, t, 0, "h") for i, t in ITEMS], "item_id long, text string, item int, hash string")
    check_leaks(decontamination.leaks(docs_of(rows), bench).collect(), rows, ITEMS)
    docs = docs_of(rows)
    kept = decontamination.clean(docs, bench)
    # by row: a clean row that repeats a leaking id, or has no id like a leaking row, stays
    gone = [bool(brute_leaks([row], ITEMS)) for row in rows]
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(row for row, g in zip(rows, gone, strict=True) if not g)
    assert (20, "again") in [(r["doc_id"], r["text"]) for r in kept.collect()] and (None, "no id") in [tuple(r)[:2] for r in kept.collect()]
    assert decontamination.leaks(docs_of([]), bench).collect() == []
    assert decontamination.leaks(docs, bench.limit(0)).collect() == []


def altered_items(seed, n_items, most):
    """Items, one of them copied to most of the benchmark, and documents that hold altered passages of them."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    hot = fresh(30)
    items = [(i, " ".join(hot if i % 5 else fresh(rnd.randrange(24, 60)))) for i in range(n_items)]
    rows = []
    for i, text in items[:most]:
        w = text.split()
        for cut in (3, 4, 5, len(w) // 4):
            rows.append((100 * i + cut, " ".join(w[:-cut] + ["same"] * (cut + 9))))  # the end is one repeated word
            rows.append((100 * i + 20 + cut, " ".join(fresh(5) + w[:-cut] + fresh(cut + 3))))
        # the head replaced and words put in: the best window begins between the two starts
        rows.append((100 * i + 50, " ".join(fresh(3) + w[3:13] + fresh(4) + w[13:] + fresh(9))))
        rows.append((100 * i + 51, " ".join(fresh(2) + w[2:9] + ["in"] * 2 + w[9:] + fresh(9))))
    return items, rows


def test_recall_of_the_radius(spark, docs_of):
    items, rows = altered_items(11, 60, 40)
    bench = spark.createDataFrame([(i, t, 0, "h") for i, t in items], "item_id long, text string, item int, hash string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs_of(rows), bench).collect()}
    want = brute_leaks(rows, items)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 500
    assert all(r["similarity"] <= want[k] + 1e-5 and r["distance"] <= decontamination.RADIUS for k, r in got.items())
    # the radius decides: fewer fingerprints lie within a smaller one
    near = decontamination.leaks(docs_of(rows), bench, radius=9).collect()
    assert all(r["distance"] <= 9 for r in near) and 0 < len(near) < len(got)


def test_leak_query_on_the_given_table(spark, sf_docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    shingles = {s for _, t in items for s in runs(words(t), 5)}
    docs = [(d, t) for d, t in sf_docs.items() if shingles & set(runs(words(t), 5))]  # others hold no item
    check_leaks(queries.REGISTRY["op4_decontamination"](spark, SF).collect(), docs, items)


def brute_chats(rows, template=chat.TEMPLATE):
    turns = defaultdict(set)
    for c, turn, role, text in rows:
        turns[c].add((-(10**9) if turn is None else turn, role or "", text or ""))
    full = {c: tuple((r, t) for _, r, t in sorted(x)) for c, x in turns.items()}
    out = []
    for c, body in full.items():
        if any(len(b) > len(body) and b[: len(body)] == body for b in full.values()):
            continue
        same = [k for k, b in full.items() if b == body]
        if c != min((k for k in same if k is not None), default=None):
            continue
        out += [(c, i, len(body), len(same), r, template[0].format(role=r) + t + template[1]) for i, (r, t) in enumerate(body, 1)]
    return out


KEY = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


def test_chats_equal_brute_force(spark):
    talk = [("user", "hi"), ("assistant", ""), ("user", None), (None, "x")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (8, None, "user", "a"), (8, 3, "user", "b"), (None, 0, "user", "null chat")]
    rows += [(20, t, "user", f"long {t}") for t in range(300)] + [(21, t, "user", f"long {t}") for t in range(170)] + [(22, t + 5, "user", f"long {t}") for t in range(65)]
    df = spark.createDataFrame([(*r, 0, "h") for r in rows], "conv_id long, turn long, role string, text string, run int, h1 string")
    got = sorted((tuple(r) for r in chat.render(df).collect()), key=KEY)
    assert got == sorted(brute_chats(rows), key=KEY)
    assert chat.render(df.limit(0)).collect() == []


def test_chat_query_on_the_given_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = sorted((tuple(r) for r in queries.REGISTRY["op8_chat_formatting"](spark, SF).collect()), key=KEY)
    assert got == sorted(brute_chats(rows), key=KEY)
