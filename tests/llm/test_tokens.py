import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pertlake.llm import packing, queries, token_output
from pertlake.llm.encoding import ChunkEncoder
from pertlake.session import scratch_path

from .conftest import ODD_TEXTS, SF

CASES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def whole(path):
    t = Tokenizer.from_file(public_tokenizers.path(path))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "keep_space"), CASES)
def test_chunked_encoding_equals_whole_texts(path, keep_space, sf_docs):
    rnd = random.Random(5)
    texts = [t for _, t in ODD_TEXTS] + list(sf_docs.values())
    texts += ["see <|endoftext|> here", "<|startoftext|>a b", "x<|endoftext|>y  z", "<|endoftext|>" * 3, "a <|ENDOFTEXT|>", "<|endof text|>", "plain <|endoftext", "|> text"]
    texts += ["".join(rnd.choice(" \n\taéΣs'L,.1 —") for _ in range(rnd.randrange(25))) for _ in range(1500)]
    coder, plain = ChunkEncoder(public_tokenizers.path(path), keep_space, cache_chunks=500), whole(path)
    got = list(coder.documents(pa.array(texts), 9))
    assert [r for r, _ in got] == list(range(len(texts)))
    for text, (_, ids) in zip(texts, got, strict=True):
        assert ids.tolist() == plain(text) + [9], repr(text)[:80]


def brute_stream(rows):
    plain, out, start = whole("byte_bpe_50k.json"), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text) + [2]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files_give_back_every_document(spark, docs_of):
    got = [tuple(r) for r in token_output.token_output(spark, docs_of(ODD_TEXTS)).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute_stream(ODD_TEXTS)


def test_token_query_on_the_given_table(spark, sf_docs):
    got = [tuple(r) for r in queries.REGISTRY["op2_token_output"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_stream(sf_docs.items()))


def test_token_files_random_access(spark, docs_of):
    folder = scratch_path(spark, "op2-test")
    manifest = token_output.write_tokens(docs_of(ODD_TEXTS), folder, public_tokenizers.path("byte_bpe_50k.json"), sequence=16).collect()
    for m in manifest:
        reader = token_output.ShardReader(m["ids_file"], m["first_batch"], m["batch_bytes"])
        n = -(-m["tokens"] // 16)
        flat = [reader.sequence(i) for i in range(n)]
        masks = np.concatenate([b for _, b in flat])
        assert masks.sum() == m["tokens"] and masks[: m["tokens"]].all()
        ids = np.concatenate([a for a, _ in flat])[: m["tokens"]]
        assert ids.tolist() == reader.tokens(0, m["tokens"]).tolist()
        assert ids.dtype == np.uint16
    assert sum(m["documents"] for m in manifest) == len(ODD_TEXTS)


def test_token_output_of_an_empty_table(spark, docs_of):
    assert token_output.token_output(spark, docs_of([])).collect() == []


def check_packing(rows, got, capacity=2048):
    plain, want = whole("word_bpe_49k.json"), []
    for i, text in rows:
        ids = plain(text) + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((i, piece, start, len(part), crc(part)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(by), -(-total // capacity)


def test_packing_places_every_piece_once(spark, docs_of):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    check_packing(ODD_TEXTS, packing.pack(docs_of(ODD_TEXTS), vocabulary).collect())
    assert packing.pack(docs_of([]), vocabulary).collect() == []


def test_packing_query_on_the_given_table(spark, sf_docs):
    used, least = check_packing(sf_docs.items(), queries.REGISTRY["op7_best_fit_packing"](spark, SF).collect())
    assert used <= least + 1


@pytest.mark.parametrize("seed", range(25))
def test_plan_uses_every_length_exactly(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 16, 64, 200])
    counts = {x: rnd.randrange(0, 40) for x in range(1, capacity + 1) if rnd.random() < 0.5}
    plan = packing.plan_packing(counts, capacity)
    used = {}
    for pattern, n in plan:
        assert n > 0 and sum(x * t for x, t in pattern) <= capacity
        for x, t in pattern:
            used[x] = used.get(x, 0) + n * t
    assert used == {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    more_than_half = sum(n for x, n in counts.items() if 2 * x > capacity)
    assert sum(n for _, n in plan) <= 1.23 * max(-(-total // capacity), more_than_half) + 1


def test_exact_fills_leave_no_gap():
    plan = packing.plan_packing({1500: 3, 548: 3, 1000: 2, 600: 2, 448: 2, 900: 1, 500: 1, 400: 1, 248: 1})
    assert sum(n for _, n in plan) == 6
