"""DuckDB SQL for each registered query (same column names and types).

Tables are the pre-registered views of the given parquet files. The adapters are
written out as CTEs; each statement is independent.
"""

from __future__ import annotations

from pertlake.functions.columns import MISSING_TOKENS
from pertlake.operators.retrieval import DEFAULT_TEMPLATE, QUESTION_TEMPLATES

ORACLE: dict[str, str] = {}

EFFECTS = """effects as (
  select s_name as perturbation, concat(p_brand, ':', p_type) as effect_gene,
         (l_quantity - 25.0) / 4.0 as log2fc,
         case when l_linenumber = 7 then null else l_discount end as padj,
         (l_quantity - 25.0) * (1 + l_linenumber) / 4.0 as score,
         case when l_linenumber = 6 then null else l_returnflag end as cell_type,
         l_orderkey, l_linenumber, l_partkey
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey)"""

EFFECTS_SPARSE = """effects as (
  select concat('O', cast(l_orderkey as varchar)) as perturbation,
         concat('P', cast(l_partkey as varchar)) as effect_gene,
         (l_quantity - 25.0) / 4.0 as log2fc,
         case when l_linenumber = 7 then null else l_discount end as padj,
         (l_quantity - 25.0) * (1 + l_linenumber) / 4.0 as score,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  from lineitem)"""

ORDER = "abs(score) desc, effect_gene asc nulls last, l_orderkey, l_linenumber, l_partkey"
ORDER_SPARSE = ORDER + ", l_suppkey"

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in MISSING_TOKENS)


def sql(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn

    return deco


@sql("clean_missing")
def _():
    return f"""with {EFFECTS},
raw as (select case when l_linenumber = 3 then 'NA' else perturbation end as perturbation,
               case when l_linenumber = 4 then 'null' else effect_gene end as effect_gene,
               l_orderkey, l_linenumber, l_partkey from effects)
select * from (
  select case when perturbation in ({_TOKENS}) then null else perturbation end as perturbation,
         case when effect_gene in ({_TOKENS}) then null else effect_gene end as effect_gene,
         l_orderkey, l_linenumber, l_partkey from raw) t
where perturbation is not null"""


_NUM = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def _coerce(col: str, default: str) -> str:
    parsed = f"(case when regexp_full_match({col}, '{_NUM}') then try_cast({col} as double) end)"
    return f"coalesce(case when isnan({parsed}) then null else {parsed} end, {default})"


@sql("coerce_numeric")
def _():
    return f"""with {EFFECTS},
raw as (select perturbation, l_orderkey, l_linenumber, l_partkey,
               cast(log2fc as varchar) as log2fc,
               case when l_linenumber = 5 then '5d' else cast(padj as varchar) end as padj,
               case when l_linenumber = 2 then 'abc' else cast(score as varchar) end as score
        from effects)
select perturbation, l_orderkey, l_linenumber, l_partkey,
       {_coerce('log2fc', 'cast(0.0 as double)')} as log2fc,
       {_coerce('padj', 'cast(1.0 as double)')} as padj,
       {_coerce('score', 'cast(0.0 as double)')} as score
from raw"""


@sql("significant_effects")
def _():
    return f"""with {EFFECTS}
select perturbation, effect_gene, log2fc, padj, score, l_orderkey, l_linenumber, l_partkey
from effects where padj < 0.05"""


@sql("direction_split")
def _():
    return f"""with {EFFECTS}
select perturbation, case when log2fc > 0 then 'up' else 'down' end as direction,
       cast(count(*) as bigint) as n, sum(log2fc) as sum_log2fc
from effects where padj < 0.05 and log2fc <> 0 group by all"""


def _summary_ctes(effects_cte: str, order: str) -> str:
    return f"""{effects_cte},
s as (select *, coalesce(padj, 1.0) < 0.05 as sig from effects),
agg as (
  select perturbation,
         cast(count_if(sig) as bigint) as n_significant,
         cast(count_if(sig and log2fc > 0) as bigint) as n_upregulated,
         cast(count_if(sig and log2fc < 0) as bigint) as n_downregulated,
         coalesce(max(case when sig then log2fc end), cast(0.0 as double)) as max_log2fc,
         coalesce(min(case when sig then log2fc end), cast(0.0 as double)) as min_log2fc
  from s group by perturbation),
best as (
  select perturbation, effect_gene as strongest_gene, log2fc as strongest_log2fc from (
    select *, row_number() over (partition by perturbation order by {order}) as rn from s where sig) t
  where rn = 1),
summary as (
  select agg.perturbation, n_significant, n_upregulated, n_downregulated,
         cast(least(n_upregulated, 20) as bigint) as n_up_shown,
         cast(least(n_downregulated, 20) as bigint) as n_down_shown,
         max_log2fc, min_log2fc, strongest_gene, strongest_log2fc
  from agg left join best on agg.perturbation = best.perturbation)"""


ORACLE["perturbation_summary"] = f"with {_summary_ctes(EFFECTS, ORDER)} select * from summary"
ORACLE["summary_sparse"] = f"with {_summary_ctes(EFFECTS_SPARSE, ORDER_SPARSE)} select * from summary"


@sql("strongest_effect")
def _():
    return f"""with {EFFECTS}
select perturbation, effect_gene, log2fc, padj, score from (
  select *, row_number() over (partition by perturbation order by {ORDER}) as rn
  from effects where padj < 0.05) t where rn = 1"""


def _top(order: str) -> str:
    return f"""top as (
  select * from (
    select *, cast(row_number() over (partition by perturbation, direction order by {order}) as bigint) as rank
    from (select *, case when log2fc > 0 then 'up' when log2fc < 0 then 'down' end as direction
          from effects where padj < 0.05) d
    where direction is not null) r
  where rank <= 20)"""


@sql("top_effects")
def _():
    return f"""with {EFFECTS}, {_top(ORDER)}
select perturbation, direction, rank, effect_gene, log2fc, padj, score from top"""


LINE = "printf('%s: log2FC %.2f, padj %.2e, score %.2f', effect_gene, log2fc, padj, score)"


@sql("gene_lines")
def _():
    return f"""with {EFFECTS}, {_top(ORDER)}
select perturbation, direction, rank, {LINE} as line from top"""


@sql("top_gene_lists")
def _():
    return f"""with {EFFECTS}, {_top(ORDER)}
select perturbation,
       coalesce(string_agg(effect_gene, '|' order by rank) filter (where direction = 'up' and rank <= 10), '') as top_up_genes,
       coalesce(string_agg(effect_gene, '|' order by rank) filter (where direction = 'down' and rank <= 10), '') as top_down_genes
from top group by perturbation"""


def _cells(order: str) -> str:
    return f"""cells as (
  select perturbation, string_agg(cell_type, ', ' order by first_rn) as cell_type_phrase from (
    select perturbation, cell_type, min(rn) as first_rn from (
      select *, row_number() over (partition by perturbation order by {order}) as rn
      from effects where padj < 0.05) r
    where cell_type is not null group by perturbation, cell_type) f
  group by perturbation)"""


@sql("cell_type_phrase")
def _():
    return f"""with {EFFECTS}, {_cells(ORDER)}
select perturbation, cell_type_phrase from cells"""


def _documents(effects_cte: str, order: str, has_cells: bool) -> str:
    cells = _cells(order) if has_cells else "cells as (select null::varchar as perturbation, null::varchar as cell_type_phrase where false)"
    return f"""with {_summary_ctes(effects_cte, order)}, {_top(order)}, {cells},
lists as (
  select perturbation,
    string_agg('  ' || {LINE}, chr(10) order by rank) filter (where direction = 'up') as up_block,
    string_agg('  ' || {LINE}, chr(10) order by rank) filter (where direction = 'down') as down_block,
    string_agg(effect_gene, ', ' order by rank) filter (where direction = 'up' and rank <= 5) as up_names,
    string_agg(effect_gene, ', ' order by rank) filter (where direction = 'down' and rank <= 5) as down_names
  from top group by perturbation)
select s.perturbation,
  'Knockout of ' || s.perturbation
  || case when length(coalesce(c.cell_type_phrase, '')) > 0 then ' (cell types: ' || c.cell_type_phrase || ')' else '' end
  || chr(10) || 'Significant genes (padj < 0.05): ' || printf('%,d', n_significant)
  || '; up-regulated: ' || printf('%,d', n_upregulated) || ' (' || cast(n_up_shown as varchar) || ' listed)'
  || '; down-regulated: ' || printf('%,d', n_downregulated) || ' (' || cast(n_down_shown as varchar) || ' listed)'
  || chr(10) || 'Up-regulated, strongest |score| first:'
  || chr(10) || coalesce(l.up_block, '  (none)')
  || chr(10) || 'Down-regulated, strongest |score| first:'
  || chr(10) || coalesce(l.down_block, '  (none)')
  || chr(10) || 'Reading: the knockout '
  || case when l.up_names is not null then 'raises ' || l.up_names else 'raises no gene significantly' end
  || ' and '
  || case when l.down_names is not null then 'lowers ' || l.down_names else 'lowers no gene significantly' end
  || '.'
  || chr(10) || case when s.n_significant > 0
       then 'Largest effect: ' || coalesce(s.strongest_gene, '(unnamed)') || ' (log2FC ' || printf('%.2f', s.strongest_log2fc) || ').'
       else 'Largest effect: none.' end as text
from summary s left join lists l on s.perturbation = l.perturbation
left join cells c on s.perturbation = c.perturbation"""


ORACLE["documents_text"] = _documents(EFFECTS, ORDER, True)
ORACLE["documents_sparse"] = _documents(EFFECTS_SPARSE, ORDER_SPARSE, False)


@sql("document_metadata")
def _():
    return f"""with {_summary_ctes(EFFECTS, ORDER)}, {_top(ORDER)}, {_cells(ORDER)},
lists as (
  select perturbation,
    coalesce(string_agg(effect_gene, '|' order by rank) filter (where direction = 'up' and rank <= 10), '') as top_up_genes,
    coalesce(string_agg(effect_gene, '|' order by rank) filter (where direction = 'down' and rank <= 10), '') as top_down_genes
  from top group by perturbation)
select s.*, coalesce(l.top_up_genes, '') as top_up_genes, coalesce(l.top_down_genes, '') as top_down_genes,
       coalesce(replace(c.cell_type_phrase, ', ', '|'), '') as cell_types
from summary s left join lists l on s.perturbation = l.perturbation
left join cells c on s.perturbation = c.perturbation"""


# ---------------------------------------------------------------- profiles

def _profile(effects_cte: str) -> str:
    return f"""{effects_cte},
profile as (select perturbation, effect_gene, avg(log2fc) as value from effects
            where padj < 0.05 and perturbation is not null and effect_gene is not null group by all),
norms as (select perturbation, sqrt(sum(value * value)) as norm from profile group by all),
unit as (select p.perturbation, p.effect_gene, p.value / greatest(n.norm, 1e-8) as value
         from profile p join norms n on p.perturbation = n.perturbation),
npert as (select count(distinct perturbation) as n from unit),
importance as (select effect_gene, sum(abs(value)) / (select n from npert) as importance from unit group by all),
kept as (select effect_gene, importance,
                cast(row_number() over (order by effect_gene) - 1 as bigint) as gene_index from (
           select * from importance order by round(importance, 10) desc, effect_gene asc limit 32) t)"""


PROFILE = _profile(EFFECTS)

ORACLE["profile_long"] = f"with {PROFILE} select perturbation, effect_gene, round(value, 6) as value from profile"
ORACLE["profile_unit"] = f"with {PROFILE} select perturbation, effect_gene, round(value, 6) as value from unit"
ORACLE["gene_importance"] = f"with {PROFILE} select effect_gene, round(importance, 6) as importance from importance"
ORACLE["top_genes"] = f"with {PROFILE} select effect_gene, gene_index, round(importance, 6) as importance from kept"
ORACLE["catalog_genes"] = f"""with {PROFILE}
select g.effect_gene, k.effect_gene is not null as kept
from (select distinct effect_gene from profile) g left join kept k on g.effect_gene = k.effect_gene"""
ORACLE["catalog_counts"] = f"""with {PROFILE}
select cast(count(distinct effect_gene) as bigint) as n_genes, cast(count(distinct perturbation) as bigint) as n_perturbations,
       cast(count(distinct effect_gene) as bigint) as gene_rows, min(effect_gene) as first_gene, max(effect_gene) as last_gene,
       cast(count(distinct perturbation) as bigint) as perturbation_rows, min(perturbation) as first_perturbation,
       cast(2048 as bigint) as max_genes, cast(256 as bigint) as embed_dim, cast(least(count(distinct effect_gene), 2048) as bigint) as genes_kept
from profile"""
ORACLE["profile_wide"] = f"""with {PROFILE},
places as (select effect_gene, row_number() over (order by effect_gene) - 1 as place from (select distinct effect_gene from unit) g)
select u.perturbation, (select cast(count(*) as bigint) from places) as n_genes, cast(p.place as bigint) as place, round(u.value, 6) as value
from unit u join places p on u.effect_gene = p.effect_gene where u.value <> 0"""
ORACLE["holdout_split"] = f"""with {PROFILE},
r as (select perturbation, row_number() over (order by md5('42:' || perturbation), perturbation) as rn,
             count(*) over () as n
      from (select distinct perturbation from profile) k)
select perturbation, case when rn <= ceil(n * 0.2) then 'val' else 'train' end as split
from r"""


# ---------------------------------------------------------------- index

VEC = """vecs as (
  select vec_id, label, embedding,
         sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm
  from embeddings),
aligned as (select v.*, d.lang, d.n_chars from vecs v join documents d on v.vec_id = d.doc_id),
xs as (select vec_id as id,
              list_transform(embedding, lambda x: cast(x as double) / (case when norm < 1e-8 then 1.0 else norm end)) as xv
       from aligned),
qs as (select vec_id as query_id,
              case when norm > 1e-8 then list_transform(embedding, lambda x: cast(x as double) / norm)
                   else list_transform(embedding, lambda x: cast(x as double)) end as qv
       from vecs)"""

ORACLE["embedding_centroid"] = """select cast(i - 1 as bigint) as dim, round(avg(cast(embedding[i] as double)), 6) as value
from (select embedding, generate_subscripts(embedding, 1) as i from embeddings) t group by i"""
ORACLE["embedding_unit"] = f"""with {VEC}
select vec_id, cast(i - 1 as bigint) as dim,
       round(cast(embedding[i] as double) / (case when norm < 1e-8 then 1.0 else norm end), 6) as value
from (select vec_id, embedding, norm, generate_subscripts(embedding, 1) as i from vecs) t"""
ORACLE["align_index"] = f"with {VEC} select vec_id, label, lang, n_chars from aligned"
ORACLE["align_missing"] = """select vec_id as id, 'no_document' as side from embeddings where vec_id not in (select doc_id from documents)
union all
select doc_id as id, 'no_embedding' as side from documents where doc_id not in (select vec_id from embeddings)"""
ORACLE["index_quality"] = f"""with {VEC},
m as (select (select count(*) from embeddings where vec_id not in (select doc_id from documents)) as nmd,
             (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as nme)
select cast(count(*) as bigint) as n_embeddings,
       (select cast(count(*) as bigint) from documents) as n_documents,
       cast(count(*) - count(distinct vec_id) as bigint) as n_duplicate_embedding_keys,
       (select cast(count(*) - count(distinct doc_id) as bigint) from documents) as n_duplicate_document_keys,
       cast((select nmd from m) as bigint) as n_missing_document,
       cast((select nme from m) as bigint) as n_missing_embedding,
       cast(count_if(norm < 1e-8) as bigint) as n_zero_norm,
       cast(count_if(list_bool_or(list_transform(embedding, lambda x: isnan(x) or isinf(x)))) as bigint) as n_nonfinite,
       cast(min(len(embedding)) as bigint) as min_dim,
       cast(max(len(embedding)) as bigint) as max_dim,
       (select nmd from m) = 0 and (select nme from m) = 0 and count(*) = count(distinct vec_id)
         and (select count(*) - count(distinct doc_id) from documents) = 0 as aligned
from vecs"""
KNN = f"""{VEC},
scored as (select query_id, id, list_inner_product(qv, xv) as score from qs, xs),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, id) as bigint) as rank from scored)"""
ORACLE["knn_cosine"] = f"with {KNN} select query_id, rank, id, round(score, 6) as score from ranked where rank <= 3"
ORACLE["self_retrieval"] = f"""with {VEC},
q1 as (select vec_id as query_id,
              case when norm > 1e-8 then list_transform(embedding, lambda x: cast(x as double) / norm)
                   else list_transform(embedding, lambda x: cast(x as double)) end as qv
       from aligned),
scored as (select query_id, id, list_inner_product(qv, xv) as score from q1, xs),
top1 as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rn from scored) t where rn = 1),
selfs as (select q1.query_id, list_inner_product(q1.qv, xs.xv) as self_score from q1 join xs on q1.query_id = xs.id)
select cast(count(*) as bigint) as n_queries,
       cast(count_if(top1.id = top1.query_id or top1.score <= selfs.self_score + 1e-6) as bigint) as n_self_first
from top1 join selfs on top1.query_id = selfs.query_id"""
ORACLE["catalog_labels"] = f"with {VEC} select vec_id, (select cast(count(*) as bigint) from aligned) as n_documents from aligned"
ORACLE["embedding_object"] = """select vec_id, cast(i - 1 as bigint) as dim, round(cast(embedding[i] as double), 6) as value
from (select vec_id, embedding, generate_subscripts(embedding, 1) as i from embeddings) t"""
VSUM = """select vec_id, cast(len(embedding) as bigint) as n_dims,
       round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norm
from embeddings"""
ORACLE["embedding_rows"] = VSUM
ORACLE["embedding_roundtrip"] = VSUM
ORACLE["index_manifest"] = f"""with {VEC} select cast(max(len(embedding)) as bigint) as embed_dim, cast(count(*) as bigint) as n_documents from aligned"""
ORACLE["index_roundtrip"] = f"""with {VEC}
select vec_id, label,
       round(sqrt(list_sum(list_transform(embedding, lambda x: power(cast(x as double) / (case when norm < 1e-8 then 1.0 else norm end), 2)))), 6) as unit_norm
from aligned"""


# ---------------------------------------------------------------- retrieval

CATALOG = r"""idx as materialized (
  select d.doc_id as vec_id,
         coalesce(list_filter(regexp_split_to_array(d.text, '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{1,9}'))[1],
                  'D' || cast(d.doc_id as varchar)) as label,
         d.text, d.lang, d.source, d.n_chars, e.embedding
  from documents d join embeddings e on e.vec_id = d.doc_id),
catfirst as (select upper(label) as name_key, arg_min(label, vec_id) as label, min(vec_id) as vec_id
             from idx group by 1),
cen as (select list(v order by i) as c from (
          select i, avg(cast(embedding[i] as double)) as v
          from (select embedding, generate_subscripts(embedding, 1) as i from idx) t group by i) s),
cen_n as (select c, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from cen),
cq as (select case when n > 1e-8 then list_transform(c, lambda x: x / n) else c end as qv from cen_n),
idx_n as (select label, vec_id, embedding,
                 sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from idx),
fb as (select * from (
         select label, vec_id, score, cast(row_number() over (order by score desc, vec_id) as bigint) as rank from (
           select i.label, i.vec_id,
                  list_inner_product(cq.qv, list_transform(i.embedding, lambda x: cast(x as double) / (case when i.n < 1e-8 then 1.0 else i.n end))) as score
           from idx_n i, cq) s) r
       where rank <= 3)"""


def _mentions(source: str) -> str:
    """``source`` yields (query_id, question)."""
    return rf"""q as ({source}),
words as (select query_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos
          from (select query_id, regexp_split_to_array(question, '[^\pL\pN_]+') as ws from q) t),
mentions as (select query_id, cast(pos as bigint) as pos, w as mention from words
             where regexp_full_match(w, '[A-Z][A-Z0-9]{{1,9}}'))"""


HITS = """named as (
  select m.query_id, cast(row_number() over (partition by m.query_id order by m.pos) as bigint) as rank,
         c.label, c.vec_id, cast(null as double) as score, 'name' as source_kind
  from mentions m join catfirst c on m.mention = c.name_key),
hits as (
  select * from named
  union all
  select q.query_id, fb.rank, fb.label, fb.vec_id, fb.score, 'similarity' as source_kind
  from q, fb where q.query_id not in (select query_id from named))"""

PROMPT = """ctx as (
  select query_id, string_agg('[' || h.label || ']' || chr(10) || d.text, chr(10) || chr(10) order by h.rank) as context, count(*) as n_shown
  from hits h join idx d on h.vec_id = d.vec_id where h.rank <= 3 group by query_id),
src as (select query_id, string_agg(label, ', ' order by rank) as sources from hits group by query_id),
prompts as (
  select q.query_id, q.question,
         'QUESTION' || chr(10) || q.question || chr(10) || chr(10)
         || 'INDEX DOCUMENTS (' || cast(coalesce(ctx.n_shown, 0) as varchar) || ')' || chr(10) || coalesce(ctx.context, '')
         || chr(10) || chr(10) || 'LABELS' || chr(10) || case when length(coalesce(src.sources, '')) > 0 then src.sources else '(none)' end as prompt,
         case when length(coalesce(src.sources, '')) > 0 then src.sources else '(none)' end as sources
  from q left join ctx on q.query_id = ctx.query_id left join src on q.query_id = src.query_id)"""

QUESTIONS = "select doc_id as query_id, text as question from documents"

ORACLE["entity_mentions"] = f"with {_mentions(QUESTIONS)} select * from mentions"
ORACLE["known_entities"] = f"with {CATALOG}, {_mentions(QUESTIONS)} select * from mentions where mention in (select upper(label) from idx)"
ORACLE["retrieve_context"] = f"""with {CATALOG}, {_mentions(QUESTIONS)}, {HITS}
select query_id, rank, label, vec_id, round(score, 6) as score, source_kind from hits"""
ORACLE["context_block"] = f"with {CATALOG}, {_mentions(QUESTIONS)}, {HITS}, {PROMPT} select query_id, context from ctx"
ORACLE["augmented_prompt"] = f"with {CATALOG}, {_mentions(QUESTIONS)}, {HITS}, {PROMPT} select query_id, prompt, sources from prompts"

ORACLE["system_text"] = f"""with {CATALOG},
n as (select label, row_number() over (order by label) as rn from (select distinct label from idx) t)
select cast(0 as bigint) as part, 'You answer from an index of ' || cast(count(*) as varchar)
       || ' labelled documents about gene perturbations. Name the label behind each statement; if no document covers the question, say that.' as system_text
from n
union all
select cast((rn - 1) // 1000 + 1 as bigint) as part, string_agg(label, ', ' order by label) as system_text from n group by 1"""

_TYPES = " union all ".join(f"select '{t}' as t" for t in (*QUESTION_TEMPLATES, "other"))
_WORDING = " ".join(f"when '{t}' then '{w}'" for t, w in QUESTION_TEMPLATES.items())
REQUESTS = f"""requests as (
  select cast(row_number() over (order by p, t) as bigint) as request_id, p as perturbation, t as question_type
  from (select label as p from idx union select lower(label) from idx union select 'ZZ') a
  cross join ({_TYPES}) b),
rq as (
  select *, replace(case question_type {_WORDING} else '{DEFAULT_TEMPLATE}' end, '{{p}}', perturbation) as question
  from requests)"""

ORACLE["question_templates"] = f"with {CATALOG}, {REQUESTS} select request_id, question from rq"
ORACLE["lookup_by_name"] = f"""with {CATALOG}, {REQUESTS}
select r.request_id, r.perturbation as name, c.label, c.vec_id
from requests r left join catfirst c on upper(r.perturbation) = c.name_key"""

STRUCT = f"""{CATALOG}, {REQUESTS}, {_mentions("select request_id as query_id, question from rq")}, {HITS}, {PROMPT},
answers as (select cast(row_number() over (order by conv_id, turn) as bigint) as request_id, text as answer
            from conversations where role = 'assistant')"""
ORACLE["structured_requests"] = f"""with {STRUCT}
select r.request_id, r.perturbation, r.question_type, r.question, p.prompt, p.sources, m.label as matched_label,
       'system,user' as roles, p.prompt as user_content, a.answer
from rq r left join prompts p on r.request_id = p.query_id left join catfirst m on upper(r.perturbation) = m.name_key
left join answers a on a.request_id = r.request_id"""
ORACLE["structured_metadata"] = f"""with {CATALOG}, {REQUESTS}
select r.request_id, m.label as matched_label, i.lang, i.source, i.n_chars
from rq r left join catfirst m on upper(r.perturbation) = m.name_key left join idx i on i.vec_id = m.vec_id"""


EFFECT_ANSWERS = f"""docs as materialized ({ORACLE["documents_sparse"]}),
unit as materialized (with {_profile(EFFECTS_SPARSE)} select * from unit),
idx as materialized (
  select row_number() over (order by perturbation) as vec_id, perturbation as label, text
  from docs where perturbation in (select perturbation from unit)),
catfirst as (select upper(label) as name_key, label, vec_id from idx),
mean as (select effect_gene, sum(value) / (select count(*) from idx) as m from unit group by 1),
fb as (select label, vec_id, score, row_number() over (order by score desc, vec_id) as rank from (
         select i.label, i.vec_id, round(sum(u.value * m.m) / (case when sqrt(sum(u.value * u.value)) < 1e-8 then 1 else sqrt(sum(u.value * u.value)) end) / (select sqrt(sum(m * m)) from mean), 9) as score
         from unit u join idx i on i.label = u.perturbation join mean m on m.effect_gene = u.effect_gene group by all) s
       order by score desc, vec_id limit 3),
requests as (
  select cast(row_number() over (order by p, t) as bigint) as request_id, p as perturbation, t as question_type
  from (select perturbation as p from docs union all select 'ZZ') a cross join ({_TYPES}) b),
rq as (
  select *, replace(case question_type {_WORDING} else '{DEFAULT_TEMPLATE}' end, '{{p}}', perturbation) as question
  from requests),
meta as materialized ({ORACLE["summary_sparse"]}),
names as (with {EFFECTS_SPARSE}, {_top(ORDER_SPARSE)}
  select perturbation,
    coalesce(string_agg(effect_gene, '|' order by rank) filter (where direction = 'up' and rank <= 10), '') as top_up_genes,
    coalesce(string_agg(effect_gene, '|' order by rank) filter (where direction = 'down' and rank <= 10), '') as top_down_genes
  from top group by perturbation)"""
ORACLE["effects_structured"] = f"""with {EFFECT_ANSWERS}, {_mentions("select request_id as query_id, question from rq")}, {HITS}, {PROMPT}
select r.request_id, r.perturbation, r.question_type, r.question, p.prompt, p.sources, c.label as matched_label,
       n_significant, n_upregulated, n_downregulated, n_up_shown, n_down_shown,
       case when c.label is not null then coalesce(n.top_up_genes, '') end as top_up_genes,
       case when c.label is not null then coalesce(n.top_down_genes, '') end as top_down_genes,
       max_log2fc, min_log2fc, strongest_gene, strongest_log2fc
from rq r left join prompts p on r.request_id = p.query_id left join catfirst c on upper(r.perturbation) = c.name_key
left join meta m on m.perturbation = c.label left join names n on n.perturbation = c.label"""

ORACLE["search_documents"] = f"""with {CATALOG},
units as (select vec_id, label, text, lang,
                 list_transform(embedding, lambda x: cast(x as double) / (case when n > 1e-8 then n else 1.0 end)) as qv,
                 list_transform(embedding, lambda x: cast(x as double) / (case when n < 1e-8 then 1.0 else n end)) as xv
          from (select i.*, sqrt(list_sum(list_transform(i.embedding, lambda x: cast(x as double) * cast(x as double)))) as n from idx i) t),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, id) as bigint) as rank from (
             select q.vec_id as query_id, x.vec_id as id, list_inner_product(q.qv, x.xv) as score from units q, units x) s)
select query_id, rank, i.label, round(score, 6) as score, i.text, i.lang from ranked join idx i on i.vec_id = ranked.id where rank <= 3"""


# ---------------------------------------------------------------- dialogue

MESSAGES = """messages as (
  select conv_id, turn, role, text,
         case when role in ('user', 'system') and length(text) % 7 = 0 then 1 else 0 end as reset_flag from conversations),
segments as (select *, cast(sum(reset_flag) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as segment_id
             from messages),
turns as (select * from segments where role <> 'system'),
hist as (select *, list({'role': role, 'content': text}) over (partition by conv_id, segment_id order by turn
                                                               rows between 6 preceding and 1 preceding) as history
         from turns)"""

ORACLE["chat_segments"] = """select conv_id, turn,
  cast(sum(case when role in ('user', 'system') and length(text) % 7 = 0 then 1 else 0 end)
       over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as segment_id
from conversations"""
ORACLE["chat_history"] = f"""with {MESSAGES}
select conv_id, turn, cast(coalesce(len(history), 0) as bigint) as n_history,
       coalesce(array_to_string(list_transform(history, lambda x: x.role), ','), '') as history_roles,
       coalesce(array_to_string(list_transform(history, lambda x: x.content), chr(10)), '') as history_text
from hist"""
ORACLE["turn_pairs"] = """select conv_id, turn, question, answer from (
  select conv_id, turn, role, text as question,
         case when lead(role) over w = 'assistant' then lead(text) over w end as answer
  from conversations where role <> 'system' window w as (partition by conv_id order by turn)) t
where role = 'user'"""
ORACLE["role_split"] = """select conv_id, arg_max(text, turn) filter (where role = 'system') as system_text,
       cast(count_if(role <> 'system') as bigint) as n_turns
from conversations group by conv_id"""
ORACLE["message_list"] = f"""with {CATALOG}, {MESSAGES},
{_mentions("select {'conv_id': conv_id, 'turn': turn} as query_id, text as question from conversations where role = 'user'")},
{HITS}, {PROMPT}
select h.conv_id, h.turn, cast(coalesce(len(h.history), 0) + 2 as bigint) as n_messages,
       'system' || case when coalesce(len(h.history), 0) > 0 then ',' || array_to_string(list_transform(h.history, lambda x: x.role), ',') else '' end || ',user' as roles,
       case when coalesce(len(h.history), 0) > 0 then array_to_string(list_transform(h.history, lambda x: x.content), chr(10)) || chr(10) else '' end || p.prompt as contents
from hist h join prompts p on p.query_id.conv_id = h.conv_id and p.query_id.turn = h.turn
where h.role = 'user'"""
ORACLE["best_checkpoint"] = """select run_id, epoch, val_loss,
       val_loss is not null and (prev is null or val_loss < prev) as is_best from (
  select user_id as run_id, event_id as epoch, value as val_loss,
         min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev
  from events) t"""
ORACLE["best_epoch"] = """with f as (
  select user_id as run_id, event_id as epoch, value as val_loss,
         min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev
  from events)
select run_id, arg_min(epoch, {'l': val_loss, 'e': epoch}) filter (where val_loss is not null) as best_epoch,
       min(val_loss) as best_loss,
       cast(count_if(val_loss is not null and (prev is null or val_loss < prev)) as bigint) as n_improvements
from f group by run_id"""


# ---------------------------------------------------------------- extensions and streams

ORACLE["guide_to_gene"] = f"""with {EFFECTS}
select perturbation, effect_gene, round(avg(log2fc), 6) as log2fc, min(coalesce(padj, 1.0)) as padj,
       round(avg(score), 6) as score, cast(count(*) as bigint) as n_guides
from effects group by perturbation, effect_gene"""


def _grouped_summary(effects_cte: str, keys: list[str], order: str) -> str:
    k = ", ".join(keys)
    on = " and ".join(f"agg.{c} is not distinct from best.{c}" for c in keys)
    return f"""with {effects_cte},
s as (select *, coalesce(padj, 1.0) < 0.05 as sig from effects),
agg as (
  select {k},
         cast(count_if(sig) as bigint) as n_significant,
         cast(count_if(sig and log2fc > 0) as bigint) as n_upregulated,
         cast(count_if(sig and log2fc < 0) as bigint) as n_downregulated,
         coalesce(max(case when sig then log2fc end), cast(0.0 as double)) as max_log2fc,
         coalesce(min(case when sig then log2fc end), cast(0.0 as double)) as min_log2fc
  from s group by {k}),
best as (
  select {k}, effect_gene as strongest_gene, log2fc as strongest_log2fc from (
    select *, row_number() over (partition by {k} order by {order}) as rn from s where sig) t
  where rn = 1)
select {", ".join("agg." + c for c in keys)}, n_significant, n_upregulated, n_downregulated,
       cast(least(n_upregulated, 20) as bigint) as n_up_shown,
       cast(least(n_downregulated, 20) as bigint) as n_down_shown,
       max_log2fc, min_log2fc, strongest_gene, strongest_log2fc
from agg left join best on {on}"""


ORACLE["summary_by_variant"] = _grouped_summary(EFFECTS, ["perturbation", "cell_type"], ORDER)
ORACLE["multi_dataset_summary"] = _grouped_summary(
    """e1 as (""" + EFFECTS[len("effects as ("):] + """,
e2 as (""" + EFFECTS_SPARSE[len("effects as ("):] + """,
effects as (
  select 'suppliers' as dataset, perturbation, effect_gene, log2fc, padj, score, cell_type,
         l_orderkey, l_linenumber, l_partkey, cast(null as bigint) as l_suppkey from e1
  union all
  select 'orders' as dataset, perturbation, effect_gene, log2fc, padj, score, cast(null as varchar) as cell_type,
         l_orderkey, l_linenumber, l_partkey, l_suppkey from e2)""",
    ["dataset", "perturbation"],
    ORDER_SPARSE + " nulls last",
)
ORACLE["incremental_refresh"] = ORACLE["documents_text"]
ORACLE["stream_history"] = ORACLE["chat_history"]


# ---------------------------------------------------------------- sources round trips

ORACLE["read_effects"] = f"""with {EFFECTS}
select perturbation, effect_gene, log2fc, coalesce(padj, 1.0) as padj, score, cell_type,
       cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
       cast(l_partkey as bigint) as l_partkey
from effects"""
ORACLE["documents_json"] = f"""with m as ({ORACLE["document_metadata"]}), d as ({ORACLE["documents_text"]})
select m.perturbation, d.text, n_significant, n_upregulated, n_downregulated, n_up_shown, n_down_shown,
       top_up_genes, top_down_genes, cell_types, max_log2fc, min_log2fc, strongest_gene, strongest_log2fc
from m join d on m.perturbation = d.perturbation"""


# ---------------------------------------------------------------- embedding: quantities that no rotation changes

CENTRED = f"""{PROFILE},
split as materialized (
  select perturbation, case when row_number() over (order by md5('42:' || perturbation), perturbation) <= ceil(count(*) over () * 0.2) then 'val' else 'train' end as split
  from (select distinct perturbation from profile) k),
mu as (select g.effect_gene, sum(coalesce(u.value, 0)) / (select count(*) from split where split = 'train') as m
       from (select distinct effect_gene from unit) g
       left join (select unit.* from unit join split using (perturbation) where split = 'train') u using (effect_gene) group by all),
centred as materialized (
  select s.perturbation, s.split, mu.effect_gene, coalesce(u.value, 0) - mu.m as v
  from split s cross join mu left join unit u on u.perturbation = s.perturbation and u.effect_gene = mu.effect_gene)"""

# at full width the projection keeps lengths and dot products
_VECTORS = f"""with {CENTRED},
first as (select effect_gene, v from centred where perturbation = (select min(perturbation) from split))
select c.perturbation, cast(count(*) as bigint) as n_dims, round(sqrt(sum(c.v * c.v)), 6) as norm, round(sum(c.v * f.v), 6) as dot_first
from centred c join first f using (effect_gene) group by all"""
ORACLE["profile_embedding"] = _VECTORS
ORACLE["embedding_export"] = _VECTORS


def _captured(components: int, squarings: int = 14) -> str:
    """Sums of squares that the leading components hold per split: each from repeated squaring of
    the training rows' Gram matrix, which then loses that component."""
    out = ["""gram as materialized (select a.perturbation as i, b.perturbation as j, a.split as si, b.split as sj, sum(a.v * b.v) as v
  from centred a join centred b using (effect_gene) group by all),
k1 as materialized (select i, j, v from gram where si = 'train' and sj = 'train')"""]
    for c in range(1, components + 1):
        out.append(f"p{c}_0 as materialized (select i, j, v / (select sum(v) from k{c} where i = j) as v from k{c})")
        for s in range(squarings):
            out.append(f"""q{c}_{s} as materialized (select a.i, b.j, sum(a.v * b.v) as v from p{c}_{s} a join p{c}_{s} b on a.j = b.i group by all),
p{c}_{s + 1} as materialized (select i, j, v / (select sum(v) from q{c}_{s} where i = j) as v from q{c}_{s})""")
        last = f"p{c}_{squarings}"
        out.append(f"""u{c} as materialized (select i, v / (select sqrt(max(v)) from {last} where i = j) as v from {last}
  where j = (select arg_max(i, v) from {last} where i = j)),
l{c} as materialized (select sum(a.v * k.v * b.v) as l from k{c} k join u{c} a on a.i = k.i join u{c} b on b.i = k.j),
k{c + 1} as materialized (select k.i, k.j, k.v - (select l from l{c}) * a.v * b.v as v from k{c} k join u{c} a on a.i = k.i join u{c} b on b.i = k.j),
z{c} as (select si as split, sum(z * z) / (select l from l{c}) as s from (
  select g.i, g.si, sum(g.v * u.v) as z from gram g join u{c} u on u.i = g.j group by all) t group by si)""")
    held = " union all ".join(f"select {c} as c, * from z{c}" for c in range(1, components + 1))
    out.append(f"""held as materialized ({held}),
whole as (select si as split, count(*) as n, sum(v) as s from gram where i = j group by si),
genes as (select count(*) as g from mu),
mse as (select w.split, cast(k.k as bigint) as k,
               greatest(0, (w.s - (select sum(h.s) from held h where h.split = w.split and h.c <= k.k)) / (w.n * (select g from genes))) as mse
        from whole w cross join (select unnest([1, 2, 4]) as k) k)""")
    return ",\n".join(out)


ORACLE["reconstruction_mse"] = f"with {CENTRED}, {_captured(4)} select split, k, round(mse, 9) as mse from mse"
ORACLE["embedding_sweep"] = f"""with {CENTRED}, {_captured(4)}
select k, round(max(mse) filter (where split = 'train'), 9) as train_mse, round(max(mse) filter (where split = 'val'), 9) as val_mse, false as is_best
from mse group by k
union all select cast(g as bigint), cast(0 as double), cast(0 as double), true from genes"""
