"""Hand-made edge rows: one test per null/edge rule of the blueprint."""

import math

from pyspark.sql import functions as F

from pertlake.operators import dialogue as dlg
from pertlake.operators import effects as eff
from pertlake.operators import index as idx
from pertlake.operators import profiles as prof
from pertlake.operators import retrieval as ret
from pertlake.operators import summaries as summ

RAW = "perturbation string, effect_gene string, log2fc string, padj string, score string, cell_type string"


def raw(spark, rows):
    return spark.createDataFrame([r + (None,) * (6 - len(r)) for r in rows], RAW)


def by(rows, key):
    return {r[key]: r for r in rows}


def test_bad_numbers_coerce_to_defaults(spark):
    values = ["abc", "5d", "", "1_0", " 1.5 ", "inf", "nan", "0x10", "-2.5e1", ".5"]
    rows = [("P", f"G{i}", v, "0.01", v) for i, v in enumerate(values)]
    out = by(eff.clean_effects(raw(spark, rows)).collect(), "effect_gene")
    got = [out[f"G{i}"]["log2fc"] for i in range(len(values))]
    assert got[:5] == [0.0, 0.0, 0.0, 0.0, 1.5]
    assert math.isinf(got[5]) and got[5] > 0
    assert got[6:] == [0.0, 0.0, -25.0, 0.5]


def test_threshold_is_strict_and_null_nan_fail(spark):
    rows = [("P", "A", "1", "0.05", "1"), ("P", "B", "1", "0.049999", "1"), ("P", "C", "1", None, "1"), ("P", "D", "1", "nan", "1")]
    sig = eff.significant_effects(eff.clean_effects(raw(spark, rows))).collect()
    assert [r["effect_gene"] for r in sig] == ["B"]


def test_zero_effect_is_significant_but_neither_direction(spark):
    rows = [("P", "Z", "0", "0.01", "3"), ("P", "U", "1", "0.01", "1")]
    s = summ.perturbation_summary(eff.clean_effects(raw(spark, rows))).collect()[0]
    assert (s["n_significant"], s["n_upregulated"], s["n_downregulated"]) == (2, 1, 0)
    assert s["strongest_gene"] == "Z"  # strongest by |score|, not by fold change


def test_zero_hit_perturbation_gets_a_document(spark):
    rows = [("EMPTY", "A", "1", "0.5", "1"), ("EMPTY", "B", "-1", None, "-1"), ("FULL", "C", "1", "0.01", "1")]
    docs = by(summ.documents(eff.clean_effects(raw(spark, rows))).collect(), "perturbation")
    m = docs["EMPTY"]["metadata"]
    assert (m["n_significant"], m["max_log2fc"], m["min_log2fc"], m["strongest_gene"]) == (0, 0.0, 0.0, None)
    assert m["top_up_genes"] == [] and m["top_down_genes"] == []
    assert docs["EMPTY"]["text"].endswith("Largest effect: none.")
    assert "(none)" in docs["EMPTY"]["text"]


def test_missing_tokens_in_keys(spark):
    rows = [("NA", "A", "1", "0.01", "1"), ("None", "B", "1", "0.01", "1"), ("null", "C", "1", "0.01", "1"), ("P", "NA", "1", "0.01", "1")]
    out = eff.clean_effects(raw(spark, rows)).collect()
    assert [(r["perturbation"], r["effect_gene"]) for r in out] == [("P", None)]
    assert prof.profile_long(eff.clean_effects(raw(spark, rows))).count() == 0


def test_duplicate_rows_are_averaged(spark):
    rows = [("P", "G", "2.0", "0.01", "1"), ("P", "G", "4.0", "0.01", "1")]
    p = prof.profile_long(eff.clean_effects(raw(spark, rows))).collect()
    assert [(r["effect_gene"], r["value"]) for r in p] == [("G", 3.0)]


def test_ties_are_broken_by_gene_name(spark):
    rows = [
        ("P", "B", "-1", "0.01", "-2"), ("P", "A", "1", "0.01", "2"),
        ("P", "D", "1", "0.01", "3"), ("P", "C", "1", "0.01", "3"),
    ]
    e = eff.clean_effects(raw(spark, rows))
    s = summ.perturbation_summary(e).collect()[0]
    assert s["strongest_gene"] == "C"
    top = summ.top_effects(e).filter(F.col("direction") == "up").orderBy("rank").collect()
    assert [r["effect_gene"] for r in top] == ["C", "D", "A"]


def test_shown_counts_are_capped_but_metadata_counts_are_not(spark):
    rows = [("P", f"G{i:02d}", "1", "0.01", str(i)) for i in range(25)]
    d = summ.documents(eff.clean_effects(raw(spark, rows)), top_n=20).collect()[0]
    assert d["metadata"]["n_upregulated"] == 25 and d["metadata"]["n_up_shown"] == 20
    assert len(d["metadata"]["top_up_genes"]) == 10
    assert "up-regulated: 25 (20 listed)" in d["text"]


def test_cell_types_in_order_of_first_appearance(spark):
    rows = [("P", "A", "1", "0.01", "1", "T"), ("P", "B", "1", "0.01", "5", "B"), ("P", "C", "1", "0.01", "3", "T"), ("P", "D", "1", "0.01", "9", None)]
    c = summ.cell_type_phrase(eff.clean_effects(raw(spark, rows))).collect()[0]
    assert c["cell_type_phrase"] == "B, T"


VEC = "vec_id long, embedding array<float>, label string"


def test_vector_edges_zero_tiny_and_k_larger_than_n(spark):
    index = spark.createDataFrame([(0, [0.0, 0.0], "z"), (1, [1e-9, 0.0], "t"), (2, [1.0, 0.0], "x"), (3, [0.0, 1.0], "y")], VEC)
    unit = by(idx.embedding_unit(index).collect(), "vec_id")
    assert unit[0]["unit_embedding"] == [0.0, 0.0]
    assert abs(unit[1]["unit_embedding"][0] - 1e-9) < 1e-15  # below the guard: left as is
    q = spark.createDataFrame([(7, [2.0, 0.0], "q")], VEC)
    hits = idx.knn_cosine(q, index, k=10, query_id="vec_id").orderBy("rank").collect()
    assert [r["id"] for r in hits] == [2, 1, 0, 3]
    one = spark.createDataFrame([(5, [1.0, 1.0], "o")], VEC)
    assert idx.knn_cosine(q, one, k=3, query_id="vec_id").count() == 1


def test_entity_mentions_rules(spark):
    qs = spark.createDataFrame(
        [(1, "SPI1 then SPI1 again"), (2, "HLA-A and AC108868.6"), (3, "spi1 ABCDEFGHIJK ÉSPI1 SPI1é")],
        "query_id long, question string",
    )
    m = ret.entity_mentions(qs).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["pos"], r["mention"]) for r in m] == [(1, 0, "SPI1"), (1, 2, "SPI1"), (2, 0, "HLA"), (2, 3, "AC108868")]


def _index(spark):
    return spark.createDataFrame(
        [(0, [1.0, 0.0, 0.0], "AB"), (1, [0.0, 1.0, 0.0], "CD"), (2, [0.0, 0.0, 1.0], "EF"), (3, [1.0, 1.0, 0.0], "GH")], VEC
    )


def test_retrieval_names_first_then_fallback(spark):
    index = _index(spark)
    qs = spark.createDataFrame([(1, "AB CD EF GH"), (2, "nothing known here"), (3, "ab is lower case")], "query_id long, question string")
    hits = ret.retrieve_context(qs, index, k=3).collect()
    q1 = sorted((r["rank"], r["label"], r["source_kind"]) for r in hits if r["query_id"] == 1)
    assert q1 == [(1, "AB", "name"), (2, "CD", "name"), (3, "EF", "name"), (4, "GH", "name")]
    for q in (2, 3):
        fb = [r for r in hits if r["query_id"] == q]
        assert len(fb) == 3 and {r["source_kind"] for r in fb} == {"similarity"}
    index = index.withColumn("text", F.concat(F.lit("doc of "), F.col("label")))
    full = ret.retrieve_context(qs, index, k=3, with_text=True)
    ctx = by(ret.context_block(full, k=3).collect(), "query_id")
    assert "doc of EF" in ctx[1]["context"] and "doc of GH" not in ctx[1]["context"]
    prompt = by(ret.augmented_prompt(qs, full, k=3).collect(), "query_id")
    assert prompt[1]["sources"] == "AB, CD, EF, GH"  # sources are not cut to k


def test_lookup_is_case_insensitive_first_match_wins(spark):
    cat = spark.createDataFrame([("Ab", 5), ("AB", 2), ("CD", 1)], "label string, vec_id long")
    names = spark.createDataFrame([("ab",), ("zz",)], "name string")
    out = by(ret.lookup_by_name(names, cat).collect(), "name")
    assert (out["ab"]["label"], out["ab"]["vec_id"]) == ("AB", 2)
    assert out["zz"]["label"] is None


MSG = "conv_id long, turn long, role string, text string, reset_flag int"


def test_dialogue_system_reset_and_window(spark):
    rows = [(1, 0, "system", "s1", 0), (1, 1, "system", "s2", 0)]
    rows += [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}", 0) for t in range(2, 12)]
    rows += [(2, 0, "user", "a", 1), (2, 1, "assistant", "b", 0), (2, 2, "user", "c", 0), (2, 5, "user", "d", 1), (2, 6, "assistant", "e", 0)]
    msgs = spark.createDataFrame(rows, MSG)
    split = by(dlg.role_split(msgs).collect(), "conv_id")
    assert split[1]["system_text"] == "s2" and split[1]["n_turns"] == 10
    h = {(r["conv_id"], r["turn"]): r["history"] for r in dlg.chat_history(msgs).collect()}
    assert [m["content"] for m in h[(1, 11)]] == ["m5", "m6", "m7", "m8", "m9", "m10"]
    assert h[(2, 0)] == [] and [m["content"] for m in h[(2, 2)]] == ["a", "b"]
    assert h[(2, 5)] == [] and [m["content"] for m in h[(2, 6)]] == ["d"]


def test_best_checkpoint_strict_minimum_across_chunks(spark):
    losses = [5.0, 4.0, 4.0, None, 3.0, 3.5, 2.0]
    m = spark.createDataFrame([(1, i * 3, v) for i, v in enumerate(losses)], "run_id long, epoch long, val_loss double")
    flags = [r["is_best"] for r in dlg.best_checkpoint(m, chunk=4).orderBy("epoch").collect()]
    assert flags == [True, True, False, False, True, False, True]
    be = dlg.best_epoch(m).collect()[0]
    assert (be["best_epoch"], be["n_improvements"]) == (18, 4)


def test_split_sizes(spark):
    def sizes(n):
        labels = spark.createDataFrame([(f"P{i}",) for i in range(n)], "perturbation string")
        s = prof.holdout_split(labels).groupBy("split").count().collect()
        return {r["split"]: r["count"] for r in s}

    assert sizes(10) == {"train": 8, "val": 2}
    for n in (3, 9, 15, 37):  # validation size is ceil(0.2 * n), as in the source split
        val = math.ceil(0.2 * n)
        assert sizes(n) == {"train": n - val, "val": val}


def test_chunked_dialogue_windows_equal_single_chunk(spark):
    rows = []
    for conv, n in ((1, 23), (2, 9), (3, 2)):
        for t in range(n):
            role = "system" if t == 0 else ("user" if t % 2 == 1 else "assistant")
            rows.append((conv, t * (1 + conv % 2), role, f"c{conv}t{t}", 1 if (t % 7 == 3 and role == "user") else 0))
    msgs = spark.createDataFrame(rows, MSG)

    def run(chunk):
        seg = sorted(map(tuple, dlg.chat_segments(msgs, chunk=chunk).select("conv_id", "turn", "segment_id").collect()))
        hist = sorted((r["conv_id"], r["turn"], tuple((m["role"], m["content"]) for m in r["history"]))
                      for r in dlg.chat_history(msgs, chunk=chunk).collect())
        pairs = sorted(map(tuple, dlg.turn_pairs(msgs, chunk=chunk).collect()))
        return seg, hist, pairs

    assert run(2) == run(3) == run(4096)


def test_csv_files_with_another_header_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Perturbation Gene,Effect Gene,Log2FC,Padj,Score Value\nP1,G1,1.5,0.01,2\n")
    (tmp_path / "b.csv").write_text("Effect Gene,Perturbation Gene,Padj,Log2FC,Cell Type\nG2,P2,0.02,-1.5,T\n")
    (tmp_path / "c.csv").write_text("")
    from pertlake.sources import store

    rows = {r["perturbation"]: r.asDict() for r in store.read_effects_csv(spark, str(tmp_path)).collect()}
    assert rows["P1"] == {"perturbation": "P1", "effect_gene": "G1", "log2fc": "1.5", "padj": "0.01", "score": "2", "cell_type": None}
    assert rows["P2"] == {"perturbation": "P2", "effect_gene": "G2", "log2fc": "-1.5", "padj": "0.02", "score": None, "cell_type": "T"}


def test_reset_on_a_system_message_counts(spark):
    rows = [(1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0), (1, 2, "system", "s", 1), (1, 3, "user", "c", 0), (1, 4, None, "d", 0)]
    msgs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, reset_flag int")
    from pertlake.operators.dialogue import chat_history

    got = {r["turn"]: [h["content"] for h in r["history"]] for r in chat_history(msgs).collect()}
    assert got == {0: [], 1: ["a"], 3: [], 4: ["c"]}


def test_split_has_no_switch_by_size(spark):
    from pertlake.operators import profiles as prof

    keys = spark.createDataFrame([(f"P{i}",) for i in range(5)], "perturbation string")
    assert sorted(r["split"] for r in prof.holdout_split(keys).collect()) == ["train"] * 4 + ["val"]
    assert prof.holdout_split(keys, demo_mode=True).count() == 10


def test_system_text_lists_every_label_in_bounded_parts(spark):
    from pertlake.operators import retrieval as ret

    cat = spark.createDataFrame([(f"L{i:04d}",) for i in range(25)] * 2, "label string")
    parts = {r["part"]: r["system_text"] for r in ret.system_text(cat, per_part=10).collect()}
    assert sorted(parts) == [0, 1, 2, 3]
    assert ", ".join(parts[p] for p in (1, 2, 3)).split(", ") == [f"L{i:04d}" for i in range(25)]


def test_written_index_holds_text_and_metadata(spark, monkeypatch):
    from pertlake.plans import queries
    from pertlake.sources import store

    small = "/root/testdata/sf0.001"
    read, load = [], store.load_index

    def seen(spark, path):
        read.append(load(spark, path))
        return read[-1]

    monkeypatch.setattr(store, "load_index", seen)
    assert queries.q_index_roundtrip(spark, small).columns == ["vec_id", "label", "unit_norm"]
    queries.q_index_manifest(spark, small)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for index, _ in read:
        rows = index.select("vec_id", "text", "metadata").collect()
        assert rows
        for r in rows:
            d = docs[r["vec_id"]]
            assert (r["text"], *r["metadata"]) == (d["text"], d["lang"], d["source"], d["n_chars"])


def test_contexts_from_the_index_equal_those_of_hits_with_text(spark):
    """Texts are moved once per list of slots, with the same results for repeated and null ids, repeated index rows and lists longer than k."""
    rows = [(1, "AB1", "one", [1.0, 0.0]), (2, "CD2", None, [0.9, 0.1]), (3, "EF3", "three", [0.5, 0.5]), (3, "EF3", "three", [0.5, 0.5]), (4, "GH4", "four", [0.0, 1.0])]
    index = spark.createDataFrame(rows, "vec_id long, label string, text string, embedding array<double>")
    asked = [(1, "of AB1"), (2, "none"), (3, "EF3 AB1 EF3 GH4 CD2"), (3, "and GH4"), (4, "CD2"), (5, "CD2"), (6, None), (None, "AB1"), (None, "no"), (7, "of AB1")]
    qs = spark.createDataFrame(asked, "query_id long, question string")
    order = lambda df: sorted(map(str, df.collect()))
    for near in (ret.fallback_hits(index, 3), ret.fallback_hits(index, 3).limit(0)):
        full = ret.retrieve_context(qs, index, 3, with_text=True, fallback=near)
        plain = ret.retrieve_context(qs, index, 3, fallback=near)
        at = {"index": index, "fallback": near}
        assert order(ret.context_block(plain, 3, **at)) == order(ret.context_block(full, 3))
        assert order(ret.augmented_prompt(qs, plain, 3, **at)) == order(ret.augmented_prompt(qs, full, 3))
