"""Registered queries of the training-data operators and their SQL.

``REGISTRY`` maps a query name to ``f(spark, sf_dir) -> DataFrame``; ``ORACLE`` has
DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pertlake.llm import (
    chat,
    decontamination,
    exact_dedup,
    line_dedup,
    ngram_join,
    packing,
    periodic_runs,
    quality,
    substring_dedup,
    token_output,
    toxicity,
    url_filter,
    vector_codes,
)
from pertlake.sources.tables import read_table

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query(
    "op1_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
    runs AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS run
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) t),
    often AS (SELECT run FROM runs GROUP BY run HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM runs SEMI JOIN often USING (run)),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body
             FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)


@query("op2_token_output")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(spark, read_table(spark, sf_dir, "documents"))


@query("op3_url_filter")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


@query("op4_decontamination")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op5_toxicity")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_quality_classifier")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_best_fit_packing")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, read_table(spark, sf_dir, "documents"))


@query(
    "op8_chat_formatting",
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS turns,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM t),
    h AS (SELECT *, md5(string_agg(md5(role) || md5(text), '') OVER (
                     PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS prefix FROM p),
    whole AS (SELECT turns, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM h WHERE position = turns GROUP BY ALL),
    maximal AS (SELECT w.* FROM whole w ANTI JOIN (SELECT position AS turns, prefix FROM h WHERE position < turns) s USING (turns, prefix))
    SELECT p.conv_id, p.position, m.turns, m.copies, p.role,
           '<|' || p.role || '|>' || chr(10) || p.text || chr(10) || '<|end|>' || chr(10) AS rendered
    FROM p JOIN maximal m USING (conv_id)
    """,
)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


@query(
    "op9_ngram_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWERED)} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
    e AS (SELECT doc_id, len(g) AS n, md5_number_lower(unnest(g)) AS shingle FROM s),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
    SELECT s.doc_id, len(g) AS n_shingles, component_id
    FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")



@query(
    "op10_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_LOWERED} AS body FROM documents)
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY body) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
           sha256(body) AS text_sha256
    FROM d
    """,
)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.annotate(read_table(spark, sf_dir, "documents"))
    return marks.withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")

@query(
    "op11_line_dedup",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place FROM documents),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    often AS (SELECT key, min(doc_id) AS lowest FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    m AS (SELECT k.*, lowest IS NOT NULL AND lowest <> doc_id AS gone FROM k LEFT JOIN often USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(read_table(spark, sf_dir, "documents"), with_text=False)


def _code_sql(rounds: int = 6) -> str:
    """Assignment and means as one pair of relations per round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM p JOIN b{i} USING (part, pos) GROUP BY ALL),
    a{i} AS (SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM d{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS m FROM p JOIN a{i} USING (vec_id, part) GROUP BY ALL),
    b{i + 1} AS (SELECT part, entry, pos, coalesce(m, c) AS c FROM b{i} LEFT JOIN s{i} USING (part, entry, pos))""")
    return f"""
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT vec_id, (i - 1) * 8 // len(v) AS part, (i - 1) % (len(v) // 8) AS pos, v[i] AS x
          FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept) t),
    f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16),
    b0 AS (SELECT part, entry, pos, x AS c FROM p JOIN f USING (vec_id)),
    {", ".join(steps)},
    coded AS (SELECT vec_id, string_agg('0' || substr('0123456789abcdef', (entry + 1)::INT, 1), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
              FROM a{rounds} GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id) CROSS JOIN books
    """


@query("op12_vector_codes", _code_sql())
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Every tenth document's words from ``first`` on repeat with a period (fixed by the query's contract)."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    first = h // 10 % n
    return first, 1 + (n - first) // (3 + h // 10 % 8)


@query("op13_periodic_runs")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapse(read_table(spark, sf_dir, "documents"), tiling=repeated_tail, with_text=False)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
