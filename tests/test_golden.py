"""Golden facts from the source's stored documents.

Fixed values: the complete significant gene lines of two small perturbations as
printed in the stored documents (gene, log2FC, padj, score; two decimals), plus
the counts, lists and strongest genes of their stored metadata.
"""

from pyspark.sql import functions as F

from pertlake.operators import effects as eff
from pertlake.operators import summaries as summ

LINES = {
    "CREB1": [
        ("HBG2", 0.33, 7.94e-11, 7.84), ("RPSA", 0.11, 5.45e-10, 7.54), ("HBG1", 0.25, 8.02e-07, 6.48),
        ("EMP3", 0.30, 3.76e-05, 5.84), ("GAL", -0.36, 2.70e-13, -8.61), ("TPT1", -0.10, 6.68e-04, -5.31),
        ("RPLP2", -0.07, 5.20e-03, -4.89), ("WDR83OS", -0.21, 1.35e-02, -4.67), ("GPX4", -0.12, 3.09e-02, -4.47),
        ("HBA1", -0.23, 3.74e-02, -4.41),
    ],
    "DDIT3": [
        ("HBG1", 0.30, 4.66e-10, 7.70), ("HBG2", 0.33, 5.16e-09, 7.30), ("STMN1", 0.26, 4.39e-03, 4.99),
        ("DDIT3", -2.56, 5.57e-06, -6.23), ("NPW", -0.45, 8.82e-05, -5.73), ("KRT18", -0.21, 1.55e-02, -4.70),
    ],
}
GOLDEN = {
    "CREB1": dict(n_significant=10, n_upregulated=4, n_downregulated=6, max_log2fc=0.33468223, min_log2fc=-0.35957432,
                  top_up_genes=["HBG2", "RPSA", "HBG1", "EMP3"],
                  top_down_genes=["GAL", "TPT1", "RPLP2", "WDR83OS", "GPX4", "HBA1"], strongest="GAL"),
    "DDIT3": dict(n_significant=6, n_upregulated=3, n_downregulated=3, max_log2fc=0.333677, min_log2fc=-2.5603747,
                  top_up_genes=["HBG1", "HBG2", "STMN1"], top_down_genes=["DDIT3", "NPW", "KRT18"], strongest="HBG1"),
}


def effects(spark):
    rows = [(p, g, lf, pa, sc, None) for p, lines in LINES.items() for g, lf, pa, sc in lines]
    # non-significant rows that must not change anything
    rows += [("DDIT3", "XIST", 9.0, 0.05, 99.0, None), ("CREB1", "ACTB", -9.0, None, -99.0, None)]
    return spark.createDataFrame(rows, "perturbation string, effect_gene string, log2fc double, padj double, score double, cell_type string")


def test_metadata_matches_stored_documents(spark):
    docs = {r["perturbation"]: r for r in summ.documents(eff.clean_effects(effects(spark))).collect()}
    for p, g in GOLDEN.items():
        m = docs[p]["metadata"]
        assert (m["n_significant"], m["n_upregulated"], m["n_downregulated"]) == (
            g["n_significant"], g["n_upregulated"], g["n_downregulated"])
        assert m["n_significant"] == m["n_upregulated"] + m["n_downregulated"]
        assert abs(m["max_log2fc"] - g["max_log2fc"]) < 0.005 and abs(m["min_log2fc"] - g["min_log2fc"]) < 0.005
        assert m["top_up_genes"] == g["top_up_genes"] and m["top_down_genes"] == g["top_down_genes"]
        assert m["strongest_gene"] == g["strongest"]


def test_strongest_is_by_score_not_fold_change(spark):
    # DDIT3: largest |log2FC| is DDIT3 itself (-2.56), the largest |score| is HBG1 (7.70)
    s = summ.strongest_effect(eff.clean_effects(effects(spark))).filter(F.col("perturbation") == "DDIT3").collect()[0]
    assert s["effect_gene"] == "HBG1"


def test_printed_lines_in_falling_abs_score(spark):
    top = summ.top_effects(eff.clean_effects(effects(spark))).collect()
    for p in LINES:
        for d in ("up", "down"):
            got = [r for r in top if r["perturbation"] == p and r["direction"] == d]
            scores = [abs(r["score"]) for r in sorted(got, key=lambda r: r["rank"])]
            assert scores == sorted(scores, reverse=True)
