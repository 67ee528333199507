"""Operator 3, URL filter: rules, then a character language-model ratio (DataFrame functions only).

Rules name a host and a path start; a rule fits its host and all subdomains, and the
longest fitting rule decides. The urls that rules decide are the training data of two
smoothed variable-order Markov models over characters (accepted, rejected); urls without
a rule are decided by the models' length-normalised log-likelihood difference against a
threshold calibrated on the decided urls.

The models are count tables, never a program in a task: n-grams of 1 to ``ORDER + 1``
characters with their counts per class, and for each context its count and its number of
distinct continuations (Witten-Bell weights). A scored n-gram looks up its suffixes of
every length and interpolates from the shortest context to the longest; contexts never
seen add nothing, which makes the order variable. Digits are one character class.

Hot urls and hosts: texts are made distinct (with their multiplicity) before n-grams are
cut, every n-gram table is aggregated before it is joined, and the rows of a url that fills any
share of the table (all nulls are one text) get their score from a broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and no
rule; it is scored like any text (null as the empty text). Repeated rows and page_ids
give one result each. Very long urls are scored whole, in time in proportion to their length; only the
id and url columns are read, so others may clash. Without urls decided either way all scores are 0 and the verdict
is ``allow``. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import LOWER, UPPER, checked_broadcast, materialize, skew_safe_join

ORDER = 4  # characters of context at most
ALPHABET = 128.0  # the uniform model under the shortest one
BINS = 400  # of the calibration histogram, over differences of -SPAN to SPAN per character
SPAN = 4.0
_PAD = "\u0002"
_END = "\u0003"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    part = lambda i: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _by_rules(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):  # the longest is tested first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judge_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict) and the models' text of every row."""
    host, path = host_and_path(F.col("url"))
    text = F.concat(
        F.lit(_PAD * ORDER),
        F.translate(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[0-9]", "0"), UPPER, LOWER),
        F.lit(_END),
    )
    return (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
        .select(
            "page_id", "host", "path", "text",
            _by_rules(F.col("host"), F.col("path"), rules, lambda r: r.name).alias("rule"),
            _by_rules(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("ruled"),
        )
    )


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in the n-gram tables."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second half"), text).alias("b"))


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    """One row per character after the padding: the n-gram of ``ORDER + 1`` characters that it ends.

    The text is cut into characters once, so the work grows with its length, and the rows carry
    the columns ``keep``, never the text.
    """
    chars = texts.select(*keep, F.split("text", "").alias("chars"))
    gram = lambda i: F.concat(*[F.get("chars", i + j) for j in range(ORDER + 1)])
    return chars.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.size("chars") - ORDER - 1), gram)).alias("gram"))


def _suffixes(grams: DataFrame) -> DataFrame:
    """Every n-gram's suffixes of 1 to ORDER + 1 characters and their contexts."""
    k = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))
    return grams.withColumn("k", k).withColumn("tail", F.substring(F.col("gram"), ORDER + 2 - F.col("k"), F.col("k"))).withColumn(
        "context", F.concat((F.col("k") - 1).cast("string"), F.substring(F.col("tail"), F.lit(1), F.col("k") - 1))
    )


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n-gram counts, context statistics) from texts with multiplicities ``accepted`` and ``rejected``."""
    grams = (
        _grams(texts.filter("accepted + rejected > 0"), "accepted", "rejected")
        .groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    )
    counts = materialize(
        _suffixes(grams).groupBy("tail", "context")
        .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")),
        "op3-grams",
    )
    contexts = counts.groupBy("context").agg(
        F.sum("accepted").alias("seen_a"), F.sum("rejected").alias("seen_r"),
        F.sum((F.col("accepted") > 0).cast("long")).alias("kinds_a"), F.sum((F.col("rejected") > 0).cast("long")).alias("kinds_r"),
    )
    return counts.select("tail", "accepted", "rejected"), contexts


def gram_scores(grams: DataFrame, counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """gram, gain: log-probability of its last character under the accepted model less that under the rejected."""
    found = _suffixes(grams).join(counts, "tail", "left").join(contexts, "context", "left")
    value = lambda c, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0))
    wide = found.groupBy("gram").agg(*[
        value(c, k).cast("double").alias(f"{c}_{k}")
        for c in ("accepted", "rejected", "seen_a", "seen_r", "kinds_a", "kinds_r") for k in range(1, ORDER + 2)
    ])

    def step(table: DataFrame, hit: str, seen: str, kinds: str, name: str) -> DataFrame:
        table = table.withColumn(name, F.lit(1 / ALPHABET))
        for k in range(1, ORDER + 2):
            n, t = F.col(f"{seen}_{k}"), F.col(f"{kinds}_{k}")
            mixed = (F.col(f"{hit}_{k}") + t * F.col(name)) / (n + t)
            table = table.withColumn(name, F.when(n > 0, mixed).otherwise(F.col(name)))
        return table

    both = step(step(wide, "accepted", "seen_a", "kinds_a", "p_a"), "rejected", "seen_r", "kinds_r", "p_r")
    return both.select("gram", (F.log("p_a") - F.log("p_r")).alias("gain"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on decided texts (0 without texts of both kinds).

    Works on a histogram of BINS bins; ties go to the middle of the best run of bins.
    """
    bin_no = F.floor((F.least(F.greatest(F.col("score"), F.lit(-SPAN)), F.lit(SPAN - 1e-9)) + SPAN) / (2 * SPAN / BINS)).cast("int")
    table = {
        r["bin"]: (r["a"], r["r"])
        for r in scored.filter("accepted + rejected > 0").groupBy(bin_no.alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()
    }
    all_a, all_r = sum(a for a, _ in table.values()), sum(r for _, r in table.values())
    if not all_a or not all_r:
        return 0.0
    below_a = below_r = 0
    quality = []
    for b in range(BINS + 1):  # threshold at the lower edge of bin b
        quality.append((all_a - below_a) / all_a + below_r / all_r)
        a, r = table.get(b, (0, 0))
        below_a, below_r = below_a + a, below_r + r
    best = max(quality)
    first = quality.index(best)
    last = first
    while last + 1 <= BINS and quality[last + 1] == best:
        last += 1
    return -SPAN + (first + last) / 2 * (2 * SPAN / BINS)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    judged = judge_by_rules(pages, rules, id_col, url_col).withColumn("key", text_key(F.col("text")))
    texts = materialize(
        judged.groupBy("key", "text").agg(
            F.sum((F.coalesce(F.col("ruled"), F.lit("")) == "allow").cast("long")).alias("accepted"),
            F.sum((F.coalesce(F.col("ruled"), F.lit("")) == "block").cast("long")).alias("rejected"),
        ),
        "op3-texts",
    )
    counts, contexts = train(texts)
    scores = materialize(gram_scores(_grams(texts).distinct(), counts, contexts), "op3-scores")
    side = checked_broadcast(scores, scores.count())
    scored = materialize(
        # a text's equal n-grams are counted before they are looked up
        _grams(texts, "key", "accepted", "rejected").groupBy("key", "accepted", "rejected", "gram").agg(F.count(F.lit(1)).alias("n"))
        .join(side, "gram")
        .groupBy("key", "accepted", "rejected").agg((F.sum(F.col("gain") * F.col("n")) / F.sum("n")).alias("score")),
        "op3-scored",
    )
    threshold = calibrate(scored)
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block"))
    return (
        skew_safe_join(judged.drop("text"), scored.select("key", "score"), "key")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    )
