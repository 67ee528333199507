"""Properties: cosine bounds and symmetry, self-hit, pivot round trip, PCA error
monotone in k, stream = batch, and independence from the shuffle partition count."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pertlake.operators import embedding as emb
from pertlake.operators import index as idx
from pertlake.operators import profiles as prof
from pertlake.operators import summaries as summ
from pertlake.plans import adapters as ad
from pertlake.plans.queries import REGISTRY
from pertlake.session import scratch_path
from pertlake.sources.tables import read_table
from pertlake.streaming import history as hist
from pertlake.streaming import refresh


def _effects(spark):
    from pertlake.operators.effects import clean_effects

    return clean_effects(ad.effects(spark, SF_SMALL))


def test_cosine_bounds_and_symmetry(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    n = e.count()
    hits = idx.knn_cosine(e, e, k=n, query_id="vec_id").collect()
    assert len(hits) == n * n
    s = {(r["query_id"], r["id"]): r["score"] for r in hits}
    assert all(-1 - 1e-9 <= v <= 1 + 1e-9 for v in s.values())
    assert all(abs(v - s[(b, a)]) < 1e-9 for (a, b), v in s.items())


def test_self_retrieval_finds_itself(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    r = idx.self_retrieval(e).collect()[0]
    assert r["n_queries"] == e.count() and r["n_self_first"] == r["n_queries"]


@pytest.mark.parametrize("block_bytes, pivots, query_rows", [(20_000, 1024, 1 << 20), (3_000, 7, 50), (1 << 26, 2, 1)])
def test_pruned_knn_equals_plain_numpy(spark, block_bytes, pivots, query_rows):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12))
    x = (centres[rng.integers(0, 9, 500)] + rng.normal(0, 0.15, (500, 12))).astype(np.float32)
    x[7] = x[30] = x[31]  # ties
    x[50] = 0.0  # no direction
    q = np.vstack((x[:40], -x[:5], rng.normal(size=(5, 12)).astype(np.float32), np.zeros((1, 12), np.float32)))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(4)
    hits = idx.knn_cosine(frame(q), frame(x), 5, query_id="vec_id", block_bytes=block_bytes, pivots=pivots, query_rows=query_rows).collect()
    unit = lambda m: m.astype(float) / np.where(np.linalg.norm(m.astype(float), axis=1) < 1e-8, 1, np.linalg.norm(m.astype(float), axis=1))[:, None]
    scores = unit(q) @ unit(x).T
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in hits}
    assert len(got) == len(hits) == 5 * len(q)
    for i in range(len(q)):
        want = np.sort(scores[i])[::-1][:5]
        assert np.allclose([got[i, j + 1][1] for j in range(5)], want, atol=1e-12)
        ids = [got[i, j + 1][0] for j in range(5)]
        assert len(set(ids)) == 5 and np.allclose(scores[i, ids], want, atol=1e-12)
        assert all(a < b or abs(scores[i, a] - scores[i, b]) > 1e-15 for a, b in zip(ids, ids[1:]))


def test_cells_that_cannot_hold_a_hit_are_skipped(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = np.eye(16)[:8]
    x = centres[np.arange(800) % 8] + rng.normal(0, 0.01, (800, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    from pertlake.functions.columns import array_unit

    unit = frame.select("id", array_unit(F.col("v"), "identity").alias("v"))
    pivots = np.array([r["v"] for r in unit.filter("id < 64").orderBy("id").collect()])
    cells = idx._cells(unit, pivots)
    ranges = {r["cell"]: (r["a"], r["b"]) for r in cells.groupBy("cell").agg(F.min("angle").alias("a"), F.max("angle").alias("b")).collect()}
    routed = idx._routed(unit.select(F.col("id").alias("query_id"), "v"), pivots, ranges, 3).collect()
    assert max(len(r["cells"]) for r in routed) <= 8 < len(ranges)  # of 64 cells, those of the query's own centre


def test_rows_without_a_certificate_are_searched(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    r = idx.self_retrieval(e.filter("vec_id != 3")).collect()[0]
    assert (r["n_queries"], r["n_self_first"]) == (3, 3)
    assert idx.self_retrieval(e).collect()[0]["n_queries"] == 4
    assert idx.self_retrieval(e.limit(0)).collect()[0]["n_queries"] == 0


def test_wide_rows_hold_every_gene_and_value(spark):
    unit = prof.profile_unit(prof.profile_long(_effects(spark)))
    genes = sorted({r["effect_gene"] for r in unit.select("effect_gene").distinct().collect()})
    blocks = prof.profile_wide(unit, block=16).collect()
    long = {(r["perturbation"], r["effect_gene"]): r["value"] for r in unit.collect()}
    got = {(r["perturbation"], genes[16 * r["block"] + p]): v for r in blocks for p, v in zip(r["places"], r["values"], strict=True)}
    assert got == long
    # as many entries as there are non-zero ones, in ascending places, no row beyond its block
    assert sum(len(r["places"]) for r in blocks) == len(long)
    assert all(r["n_genes"] == len(genes) and r["places"] == sorted(set(r["places"])) and r["places"][-1] < 16 for r in blocks)


def test_pca_error_non_increasing_in_k(spark):
    unit = prof.profile_unit(prof.profile_long(_effects(spark)))
    kept = prof.top_genes(prof.gene_importance(unit), 64)
    rows = sorted(emb.reconstruction_sweep(unit, kept, (1, 2, 4, 8, 16, 32, 64)).collect(), key=lambda r: r["k"])
    for col in ("train_mse", "val_mse"):
        vals = [r[col] for r in rows]
        assert all(b <= a + 1e-12 for a, b in zip(vals, vals[1:]))
    assert sum(r["is_best"] for r in rows) == 1


def test_embedding_is_deterministic(spark):
    unit = prof.profile_unit(prof.profile_long(_effects(spark)))
    kept = prof.top_genes(prof.gene_importance(unit), 32)
    a = {r["perturbation"]: r["embedding"] for r in emb.profile_embedding(unit, kept, 8).collect()}
    b = {r["perturbation"]: r["embedding"] for r in emb.profile_embedding(unit, kept, 8).collect()}
    assert a.keys() == b.keys()
    assert all(max(abs(x - y) for x, y in zip(a[k], b[k])) < 1e-9 for k in a)
    assert all(len(v) == 8 for v in a.values())


def test_refresh_stream_equals_batch_rebuild(spark):
    e = _effects(spark)
    base = scratch_path(spark, "test-refresh")
    arrival = F.pmod(F.xxhash64("l_orderkey"), F.lit(4))
    for wave in range(4):
        e.filter(arrival == wave).coalesce(1).write.mode("append").parquet(f"{base}/src")
    out = refresh.incremental_refresh(
        spark, f"{base}/src", e.schema, f"{base}/eff", f"{base}/docs", f"{base}/ckpt",
        n_buckets=8, max_files_per_trigger=1, tiebreak=ad.EFFECT_TIEBREAK,
    )
    batch = summ.documents(e, tiebreak=ad.EFFECT_TIEBREAK).select("perturbation", "text")
    assert sorted(map(tuple, out.select("perturbation", "text").collect())) == sorted(map(tuple, batch.collect()))


def test_history_stream_equals_batch(spark):
    from pertlake.operators.dialogue import chat_history

    m = ad.messages(spark, SF_SMALL)
    base = scratch_path(spark, "test-history")
    for cond in (F.col("turn") < 3, F.col("turn") >= 3):
        m.filter(cond).write.mode("append").parquet(f"{base}/src")
    out = hist.stream_history(spark, f"{base}/src", m.schema, f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    got = sorted((r["conv_id"], r["turn"], r["n_history"], r["history_text"]) for r in out.collect())
    want = sorted(
        (r["conv_id"], r["turn"], len(r["history"]), "\n".join(x["content"] for x in r["history"]))
        for r in chat_history(m).collect()
    )
    assert got == want


@pytest.mark.parametrize("key", ["top_effects", "documents_text", "knn_cosine", "retrieve_context", "best_checkpoint"])
def test_same_result_under_1_and_8_partitions(spark, key):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(repr, REGISTRY[key](spark, SF_SMALL).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run(1) == run(8)


def test_refresh_batch_replay_is_idempotent(spark):
    e = _effects(spark)
    base = scratch_path(spark, "test-replay")
    batch = e.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == 0)
    for _ in range(2):  # the same batch id twice, as after a failure between write and commit
        refresh.refresh_batch(batch, 7, f"{base}/eff", f"{base}/docs", n_buckets=4, tiebreak=ad.EFFECT_TIEBREAK)
    assert spark.read.parquet(f"{base}/eff").count() == batch.count()
    want = summ.documents(batch, tiebreak=ad.EFFECT_TIEBREAK).select("perturbation", "text")
    got = refresh.read_documents(spark, f"{base}/docs").select("perturbation", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _doc_rows(df):
    return sorted(map(repr, df.select("perturbation", "text", "metadata").collect()))


@pytest.mark.parametrize("parts", [2, 5])
def test_document_state_merge_equals_batch(spark, parts):
    e = _effects(spark)
    t = ad.EFFECT_TIEBREAK
    piece = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts))
    states = [summ.document_state(e.filter(piece == i), tiebreak=t) for i in range(parts)]
    u = states[0]
    for s in states[1:]:
        u = u.unionByName(s)
    merged = summ.merge_document_state(u)
    assert _doc_rows(summ.documents_from_state(merged)) == _doc_rows(summ.documents(e, tiebreak=t))
    assert _doc_rows(summ.documents_from_state(states[0])) == _doc_rows(
        summ.documents(e.filter(piece == 0), tiebreak=t)
    )


def test_refresh_replay_after_merge_is_idempotent(spark):
    e = _effects(spark)
    base = scratch_path(spark, "test-replay-merge")
    half = F.pmod(F.xxhash64("l_orderkey"), F.lit(2))
    first, second = e.filter(half == 0), e.filter(half == 1)
    args = (f"{base}/eff", f"{base}/docs")
    refresh.refresh_batch(first, 0, *args, n_buckets=4, tiebreak=ad.EFFECT_TIEBREAK)
    for _ in range(2):  # batch 1 replayed: it must merge with batch 0's snapshot only
        refresh.refresh_batch(second, 1, *args, n_buckets=4, tiebreak=ad.EFFECT_TIEBREAK)
    want = summ.documents(e, tiebreak=ad.EFFECT_TIEBREAK)
    got = refresh.read_documents(spark, f"{base}/docs")
    assert _doc_rows(got) == _doc_rows(want)
    assert spark.read.parquet(f"{base}/eff").count() == e.count()


def _flat_history(rows):
    return sorted((r["conv_id"], r["turn"], r["n_history"], r["history_roles"], r["history_text"]) for r in rows)


def test_history_stream_turn_by_turn_with_replay(spark):
    from pertlake.operators.dialogue import chat_history

    m = ad.messages(spark, SF_SMALL)
    base = scratch_path(spark, "test-history-waves")
    out, state = f"{base}/out", f"{base}/state"
    max_turn = m.agg(F.max("turn")).first()[0]
    for t in range(max_turn + 1):  # one batch per turn: every message gets its history from the carry
        batch = m.filter(F.col("turn") == t)
        hist.history_batch(batch, t, out, state, n_buckets=4)
        if t == 3:  # a replayed batch id must not change anything
            hist.history_batch(batch, t, out, state, n_buckets=4)
    got = _flat_history(hist.read_history(spark, out).collect())
    want = _flat_history(hist.history_rows(chat_history(m)).collect())
    assert got == want


def test_refresh_sparse_batches_equal_batch_rebuild(spark):
    # many small perturbations, some without a significant row, arriving in three batches
    from pertlake.operators.effects import clean_effects

    e = clean_effects(ad.effects_sparse(spark, SF_SMALL))
    base = scratch_path(spark, "test-refresh-sparse")
    part = F.pmod(F.col("l_linenumber"), F.lit(3))
    for b in range(3):
        refresh.refresh_batch(e.filter(part == b), b, f"{base}/eff", f"{base}/docs", n_buckets=8,
                              tiebreak=ad.SPARSE_TIEBREAK)
    want = summ.documents(e, tiebreak=ad.SPARSE_TIEBREAK)
    assert _doc_rows(refresh.read_documents(spark, f"{base}/docs")) == _doc_rows(want)


def test_refresh_failure_before_commit_then_replay(spark, monkeypatch):
    # batch 1 writes its state snapshot and documents, then fails before the manifest
    # lists it; the replay must read batch 0's snapshot again and give the same documents
    from pertlake.streaming import deltas as snapshots

    e = _effects(spark)
    base = scratch_path(spark, "test-refresh-fail")
    half = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(2))
    first, second = e.filter(half == 0), e.filter(half == 1)
    args = (f"{base}/eff", f"{base}/docs")
    refresh.refresh_batch(first, 0, *args, n_buckets=4, tiebreak=ad.EFFECT_TIEBREAK)

    def lost(*_a, **_k):
        raise RuntimeError("driver lost before commit")

    monkeypatch.setattr(snapshots, "commit", lost)
    with pytest.raises(RuntimeError):
        refresh.refresh_batch(second, 1, *args, n_buckets=4, tiebreak=ad.EFFECT_TIEBREAK)
    monkeypatch.undo()
    refresh.refresh_batch(second, 1, *args, n_buckets=4, tiebreak=ad.EFFECT_TIEBREAK)
    assert _doc_rows(refresh.read_documents(spark, f"{base}/docs")) == _doc_rows(summ.documents(e, tiebreak=ad.EFFECT_TIEBREAK))


def test_history_failure_before_commit_then_replay(spark, monkeypatch):
    from pertlake.operators.dialogue import chat_history
    from pertlake.streaming import snapshots

    m = ad.messages(spark, SF_SMALL)
    base = scratch_path(spark, "test-history-fail")
    out, state = f"{base}/out", f"{base}/state"
    early, late = m.filter(F.col("turn") < 3), m.filter(F.col("turn") >= 3)
    hist.history_batch(early, 0, out, state, n_buckets=4)

    def lost(*_a, **_k):
        raise RuntimeError("driver lost before commit")

    monkeypatch.setattr(snapshots, "commit", lost)
    with pytest.raises(RuntimeError):
        hist.history_batch(late, 1, out, state, n_buckets=4)
    monkeypatch.undo()
    hist.history_batch(late, 1, out, state, n_buckets=4)
    got = _flat_history(hist.read_history(spark, out).collect())
    assert got == _flat_history(hist.history_rows(chat_history(m)).collect())


def test_history_batch_without_turns_carries_the_map(spark):
    # batch 1 holds only system messages: it touches no bucket but must pass the
    # bucket -> snapshot map on, so batch 2 still finds batch 0's carry
    from pertlake.operators.dialogue import chat_history

    m = ad.messages(spark, SF_SMALL)
    base = scratch_path(spark, "test-history-empty")
    out, state = f"{base}/out", f"{base}/state"
    system = F.col("role") == "system"
    hist.history_batch(m.filter(~system & (F.col("turn") < 3)), 0, out, state, n_buckets=4)
    hist.history_batch(m.filter(system), 1, out, state, n_buckets=4)
    hist.history_batch(m.filter(~system & (F.col("turn") >= 3)), 2, out, state, n_buckets=4)
    got = _flat_history(hist.read_history(spark, out).collect())
    assert got == _flat_history(hist.history_rows(chat_history(m)).collect())


@pytest.mark.parametrize("key", ["significant_effects", "top_effects", "profile_long"])
def test_significance_reaches_the_scan(spark, key, capsys):
    df = REGISTRY[key](spark, SF_SMALL)
    df.explain("formatted")
    plan = capsys.readouterr().out
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "l_discount" in line]
    assert pushed and all("LessThan(l_discount" in line for line in pushed)


def test_refresh_of_one_perturbation_writes_one_row(spark):
    from pertlake.operators.effects import clean_effects

    e = clean_effects(ad.effects_sparse(spark, SF_SMALL))
    base = scratch_path(spark, "test-refresh-delta")
    one = e.filter("l_linenumber = 2").agg(F.min("perturbation")).first()[0]
    few = (F.col("perturbation") == one) & (F.col("l_linenumber") % 2 == 0)
    args = {"n_buckets": 8, "tiebreak": ad.SPARSE_TIEBREAK}
    refresh.refresh_batch(e.filter(~few), 0, f"{base}/eff", f"{base}/docs", **args)
    refresh.refresh_batch(e.filter(few), 1, f"{base}/eff", f"{base}/docs", **args)
    for table in ("docs", "docs_state"):
        assert [r["perturbation"] for r in spark.read.parquet(f"{base}/{table}/batch_id=1").collect()] == [one]
    assert _doc_rows(refresh.read_documents(spark, f"{base}/docs")) == _doc_rows(summ.documents(e, tiebreak=ad.SPARSE_TIEBREAK))


def test_refresh_of_all_perturbations_keeps_few_versions(spark):
    from pertlake.streaming import deltas

    rows = [(p, f"G{g}", g / 4 - 1, 0.01, (g * 7 + b) % 5 - 2.0, "c", b) for b in range(3) for p in "PQRS" for g in range(6)]
    e = spark.createDataFrame(rows, "perturbation string, effect_gene string, log2fc double, padj double, score double, cell_type string, b int")
    base = scratch_path(spark, "test-refresh-versions")
    for b in range(3):  # every batch touches every perturbation: the third writes the only live version
        refresh.refresh_batch(e.filter(F.col("b") == b), b, f"{base}/eff", f"{base}/docs", n_buckets=4, tiebreak=("b",))
    assert deltas.live_batches(spark, f"{base}/docs_state", 3) == [2]
    assert _doc_rows(refresh.read_documents(spark, f"{base}/docs")) == _doc_rows(summ.documents(e, tiebreak=("b",)))


def test_refresh_compaction_and_retention(spark):
    import os

    from pertlake.operators.effects import clean_effects

    e = clean_effects(ad.effects_sparse(spark, SF_SMALL)).filter("l_orderkey < 200")
    base = scratch_path(spark, "test-refresh-compact").removeprefix("file:")
    wave = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(6))
    kw = {"n_buckets": 4, "tiebreak": ad.SPARSE_TIEBREAK, "compact_after": 2}
    for b in range(6):
        for _ in range(2):  # every batch is replayed once
            refresh.refresh_batch(e.filter(wave == b), b, f"{base}/eff", f"{base}/docs", **kw)
        seen = e.filter(wave <= b)
        assert _doc_rows(refresh.read_documents(spark, f"{base}/docs")) == _doc_rows(summ.documents(seen, tiebreak=ad.SPARSE_TIEBREAK))
    refresh.refresh_batch(e.limit(0), 6, f"{base}/eff", f"{base}/docs", **kw)  # an empty batch passes the list on
    assert _doc_rows(refresh.read_documents(spark, f"{base}/docs")) == _doc_rows(summ.documents(e, tiebreak=ad.SPARSE_TIEBREAK))
    left = {d for d in os.listdir(f"{base}/docs_state") if d.startswith("batch_id=")}
    assert len(left) <= 4  # superseded versions are deleted


@pytest.mark.parametrize("replay", [False, True])
def test_history_with_late_turns_equals_batch(spark, replay):
    from pertlake.operators.dialogue import chat_history

    m = ad.messages(spark, SF_SMALL)
    base = scratch_path(spark, "test-history-late")
    out, state = f"{base}/out", f"{base}/state"
    late = (F.col("turn") >= 1) & (F.col("turn") <= 2) & (F.pmod(F.xxhash64("conv_id"), F.lit(3)) == 0)
    waves = [~late & (F.col("turn") < 4), late & (F.col("turn") == 2), ~late & (F.col("turn") >= 4), late & (F.col("turn") == 1)]
    for b, cond in enumerate(waves):
        for _ in range(1 + replay):
            hist.history_batch(m.filter(cond), b, out, state, n_buckets=4)
    assert spark.read.parquet(f"{state}/late").count() > 0
    # conversations without a late turn are not emitted again
    versions = spark.read.parquet(out).groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id").distinct()
    assert versions.filter(F.pmod(F.xxhash64("conv_id"), F.lit(3)) != 0).count() == 0
    got = _flat_history(hist.read_history(spark, out).collect())
    assert got == _flat_history(hist.history_rows(chat_history(m)).collect())


def test_embedding_equals_a_dense_decomposition(spark):
    """Subspace iteration over sparse rows against numpy's SVD of the dense centred matrix."""
    import numpy as np

    from pertlake.operators.effects import clean_effects

    # few perturbations: exact; many with a flat spectrum: as good as MAX_PASSES make it
    for effects, rtol in ((ad.effects(spark, SF_SMALL), 1e-9), (ad.effects_sparse(spark, SF_SMALL), 1e-3)):
        unit = prof.profile_unit(prof.profile_long(clean_effects(effects)))
        rows, n_genes = emb.sparse_rows(unit)
        dense = np.zeros((rows.count(), n_genes))
        for i, r in enumerate(rows.collect()):
            dense[i, r["places"]] = r["values"]
        dense -= dense.mean(axis=0)
        s, v = np.linalg.svd(dense, full_matrices=False)[1:]
        k = 6
        f = emb.fit(rows, n_genes, k)
        assert np.allclose(f.variance, s[:k] ** 2, rtol=rtol)
        assert np.allclose(f.basis.T @ f.basis, np.eye(k), atol=1e-9)
        if rtol < 1e-6:
            assert all(abs(f.basis[:, j] @ v[j]) > 1 - 1e-6 for j in range(k) if s[j] - s[j + 1] > 1e-6 and (j == 0 or s[j - 1] - s[j] > 1e-6))


def test_export_reads_the_best_width_from_the_factor_table(spark):
    unit = prof.profile_unit(prof.profile_long(_effects(spark)))
    out = emb.export_embeddings(unit, dims=(1, 3, 7)).collect()
    direct = {r["perturbation"]: r["embedding"] for r in emb.profile_embedding(unit, None, 7).collect()}
    assert all(r["k"] == 7 and max(abs(a - b) for a, b in zip(r["embedding"], direct[r["perturbation"]], strict=True)) < 1e-6 for r in out)
    assert len(out) == len(direct)


def test_answers_from_effects_to_prompt(spark):
    """Index, fallback and metadata of the chain against plain Python."""
    import numpy as np

    from pertlake.operators import effect_index as eidx
    from pertlake.session import written

    docs = spark.createDataFrame([(p, f"text {p}", p.lower()) for p in ("A1", "B2", "C3", "D4", "E5")], "perturbation string, text string, note string")
    docs = written(docs.select("perturbation", "text", F.struct("note").alias("metadata")), "t-docs")
    values = {"A1": {"x": 1.0}, "B2": {"x": 0.6, "y": 0.8}, "C3": {"y": -1.0}, "D4": {"z": 1.0}, "Q9": {"x": 1.0}}
    unit = written(spark.createDataFrame([(p, g, v) for p, e in values.items() for g, v in e.items()], "perturbation string, effect_gene string, value double"), "t-unit")
    index = {r["label"]: r["vec_id"] for r in eidx.effect_index(docs, unit).collect()}
    assert index == {"A1": 1, "B2": 2, "C3": 3, "D4": 4}
    assert {(r["perturbation"], r["side"]) for r in eidx.without_vector(docs, unit).collect()} == {("E5", "no_embedding"), ("Q9", "no_document")}
    dense = np.array([[values[p].get(g, 0.0) for g in "xyz"] for p in "A1 B2 C3 D4".split()])
    c = dense.mean(axis=0)
    score = dense @ c / np.linalg.norm(c)
    near = eidx.nearest_to_centroid(unit, written(eidx.effect_index(docs, unit), "t-index"), 3).collect()
    best = sorted(range(4), key=lambda i: (-round(score[i], 9), i))[:3]
    assert [(r["rank"], r["vec_id"]) for r in sorted(near)] == [(i + 1, b + 1) for i, b in enumerate(best)]
    req = spark.createDataFrame([(1, "B2", "mechanism"), (2, "E5", "mechanism"), (3, "d4", "other")], "request_id long, perturbation string, question_type string")
    got = {r["request_id"]: r for r in eidx.answer_requests(written(req, "t-req"), docs, unit).collect()}
    assert "[B2]\ntext B2" in got[1]["prompt"] and got[1]["metadata"]["note"] == "b2" and got[1]["sources"] == "B2"
    assert got[2]["metadata"] is None and got[2]["sources"] == ", ".join("A1 B2 C3 D4".split()[b] for b in best)
    assert got[3]["metadata"]["note"] == "d4" and got[3]["sources"] == got[2]["sources"]


def test_requests_for_one_name_move_no_text_per_request(spark, capsys):
    from pertlake.operators import retrieval as ret
    from pertlake.session import written

    rows = [(1, "A1", "one"), (2, "B2", "two"), (2, "B2", "two again"), (3, "c3", None), (4, "a1", "later"), (5, "D4", "four")]
    index = spark.createDataFrame(rows, "vec_id long, label string, text string").withColumn("metadata", F.struct(F.length("label").alias("n"), "label"))
    index = written(index, "t-index")
    near = written(spark.createDataFrame([(1, "D4", 5, 0.5), (2, "B2", 2, 0.25)], "rank long, label string, vec_id long, score double"), "t-near")
    names = ["A1", "a1", "B2", "C3", "c3", "ZZ", "B2 or D4", "D4 D4", "B2, B2, B2 and A1", "b2 B2", "", None]
    rows = [(2 * i + j, p, t) for i, p in enumerate(names) for j, t in enumerate(("mechanism", "unknown"))]
    req = written(spark.createDataFrame(rows, "request_id long, perturbation string, question_type string"), "t-req")
    answers = spark.createDataFrame([(0, "yes"), (5, "no"), (99, "none")], "request_id long, answer string")
    q = req.select(F.col("request_id").alias("query_id"), ret.question_from_template(req).alias("question"))
    for k in (1, 2, 3):
        want = ret.augmented_prompt(q, ret.retrieve_context(q, index, k, with_text=True, fallback=near), k)
        want = want.join(answers, F.col("query_id") == F.col("request_id"), "left").select("query_id", "question", "prompt", "sources", "answer")
        got = ret.structured_requests(req, index, k, answers, fallback=near)
        assert sorted(map(repr, got.select(F.col("request_id").alias("query_id"), "question", "prompt", "sources", "answer").collect())) == sorted(map(repr, want.collect()))
        found = {r["perturbation"]: r["matched_label"] for r in got.collect()}
        assert found == {"A1": "A1", "a1": "A1", "B2": "B2", "C3": "c3", "c3": "c3", "ZZ": None, "": None, None: None,
                         **{n: None for n in names if n and " " in n}}
    plain = written(req.filter("perturbation not like '% %'"), "t-plain")
    capsys.readouterr()
    ret.structured_requests(plain, index, 3, fallback=near).explain("formatted")
    inputs = [line for line in capsys.readouterr().out.split("Exchange\n")[1:] if line.startswith("Input")]
    moved = [{c.strip().split("#")[0] for c in line.split("\n")[0].split("[", 2)[-1].rstrip("]").split(",")} for line in inputs]
    assert moved and not any(m & {"query_id"} for m in moved)
    assert all(m <= {"request_id", "perturbation", "question_type", "_n", "answer"} for m in moved if "request_id" in m)


@pytest.mark.parametrize("key, most", [("documents_text", 2), ("document_metadata", 2), ("documents_sparse", 2), ("profile_unit", 1)])
def test_scans_of_lineitem(spark, key, most):
    plan = REGISTRY[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= most


def _odd_documents():
    texts = ['plain', 'a }, { "perturbation": "x" } text', '},{', 'quote " and \\ backslash \\"', 'é 中文 👩', '{}', ']}', '', 'long ' * 3000]
    return [{"perturbation": f"P{i}, {{", "text": t, "metadata": {"n_significant": i, "top_up_genes": ["},{", "]", t[:20]], "max_log2fc": 1.5e-3}} for i, t in enumerate(texts)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("step", [1, 7, 50, 10**6])
def test_entries_of_every_byte_range(indent, step):
    import json

    from pertlake.sources.json_entries import entries

    docs = _odd_documents()
    cases = [("array", docs), ("array", []), ("map", {d["perturbation"] + d["text"][:30]: [1.0, -2.5e-3, i] for i, d in enumerate(docs)}), ("map", {}), ("map", {"k": []})]
    for kind, value in cases:
        if step == 1 and kind == "array":
            value = value[:4]
        raw = json.dumps(value, indent=indent, ensure_ascii=False).encode()
        ends = [*range(0, len(raw), step), len(raw)]
        got = [e for a, b in zip(ends[:-1], ends[1:]) for e in entries(lambda at, n: raw[at : at + n], len(raw), a, b, kind)]
        want = [(None, d) for d in value] if kind == "array" else list(value.items())
        assert [(k, json.loads(v)) for k, v in got] == want


def test_documents_array_is_read_in_several_tasks(spark, tmp_path):
    import json

    from pertlake.sources import store

    docs = _odd_documents()
    path = tmp_path / "documents.json"
    path.write_text(json.dumps(docs, indent=2))
    df = store.read_documents_array(spark, str(path), split_bytes=2000)
    assert df.rdd.getNumPartitions() > 5
    got = {r["perturbation"]: r for r in df.collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["perturbation"]]
        assert r["text"] == d["text"] and r["metadata"]["top_up_genes"] == d["metadata"]["top_up_genes"] and r["metadata"]["n_significant"] == d["metadata"]["n_significant"]


@pytest.mark.parametrize("n, few, digits", [(1, 4096, 4), (777, 3, 1), (1000, 5, 2), (1001, 5, 2), (0, 5, 2)])
def test_nth_smallest_hash(spark, n, few, digits):
    import hashlib

    keys = [f"k{i}" for i in range(1000)]
    rows = spark.createDataFrame([(k, hashlib.md5(k.encode()).hexdigest()) for k in keys], "k string, h string")
    want = sorted((hashlib.md5(k.encode()).hexdigest(), k) for k in keys)
    assert prof.nth_smallest(rows, "h", "k", n, digits, few) == (want[n - 1] if 0 < n <= 1000 else None)


def _peak(call):
    import tracemalloc

    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_profile_entries_are_multiplied_in_bounded_blocks():
    import numpy as np

    rnd = np.random.default_rng(3)
    to, at = np.sort(rnd.integers(0, 500, 100_000)), rnd.integers(0, 300, 100_000)
    value, table = rnd.standard_normal(len(to)), rnd.standard_normal((300, 64))
    want, got = np.ones((500, 64)), np.ones((500, 64))
    np.add.at(want, to, value[:, None] * table[at])  # 51 MB at once
    _, peak = _peak(lambda: emb._add_rows(got, to, value, table, at))
    assert np.abs(got - want).max() < 1e-9
    assert peak < 4 * emb.ENTRIES * 64 * 8
    emb._add_rows(got, to[:0], value[:0], table, at[:0])
    assert np.abs(got - want).max() < 1e-9


def test_search_holds_few_scores_at_a_time():
    import numpy as np

    rnd = np.random.default_rng(4)
    block = idx.Block(rnd.permutation(20_000), rnd.standard_normal((20_000, 4)))
    queries = rnd.standard_normal((500, 4))
    hits, peak = _peak(lambda: list(idx._hits(np.arange(500), block, queries, 3)))  # 80 MB of scores
    assert peak < 5 * idx.SCORE_BYTES
    best = np.argsort(-(queries @ block.vectors.T), axis=1, kind="stable")[:, :3]
    assert np.concatenate([h.column("id").to_numpy() for h in hits]).tolist() == block.ids[best].ravel().tolist()
