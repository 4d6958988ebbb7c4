"""Independent SQL for index and retrieval queries (DuckDB dialect), used only to check results."""

from __future__ import annotations

from dossier.plans.sql_tables import cells, DOCUMENTS, VALUE_FACTS
from dossier.plans.sql_text import BLOCKS, BODY, CHUNKS, NL, ROUTED, SECTIONS, strip

# Letters outside ASCII count as word characters for the boundary, but are never capitals or
# digits of a code; a plain small letter stands in for them.
_CODES = (
    r"\b(?:[A-Z]{1,4}[\s-]?)?\d+(?:\.\d+)+\b|\b[A-Z]{1,4}[\s-]?\d+\b|\bGroup\s+[A-Z]\b"
)


def codes(x: str) -> str:
    plain = rf"regexp_replace({x}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', 'q', 'g')"
    found = f"regexp_extract_all({plain}, '{_CODES}')"
    return rf"list_distinct(list_transform({found}, lambda t: upper(regexp_replace(t, '[\s-]+', '', 'g'))))"


def words(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))"


def toks(x: str) -> str:
    return f"list_concat({words(x)}, list_transform({codes(x)}, lambda t: lower(t)))"


def bm25(docs: str, queries: str, n: int) -> str:
    """CTEs from `docs` (kb, doc_id, document) and `queries` (kb, query_id, text) to `lexical`."""
    return f"""
doc_tokens as (select kb, doc_id, unnest({toks('document')}) token from {docs}),
postings as (select kb, doc_id, token, count(*) tf from doc_tokens group by 1, 2, 3),
doc_lens as (select d.kb, d.doc_id, coalesce(l.n, 0) doc_len from {docs} d
  left join (select kb, doc_id, count(*) n from doc_tokens group by 1, 2) l using (kb, doc_id)),
stats as (select kb, count(*) n_docs, avg(doc_len) avg_len from doc_lens group by 1),
dfs as (select kb, token, count(*) df from postings group by 1, 2),
raws as (select kb, token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) raw from dfs join stats using (kb)),
terms as (select kb, token, df, case when raw < 0 then 0.25 * avg(raw) over (partition by kb) else raw end idf from raws),
asked as (select kb, query_id, token, count(*) qtf from (select kb, query_id, unnest({toks('text')}) token from {queries}) group by 1, 2, 3),
scores as (
  select kb, query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 9) score
  from asked join terms using (kb, token) join postings using (kb, token) join doc_lens using (kb, doc_id) join stats using (kb) group by 1, 2, 3),
lexical as (
  select kb, query_id, doc_id, score, rank from (
    select *, row_number() over (partition by kb, query_id order by score desc, doc_id) rank from scores where score > 0)
  where rank <= {n})
"""


VECTOR_DOCS = """
vector_docs as (
  select 'k' || lpad(cast(vec_id as varchar), 9, '0') doc_id, vec_id, label,
    case when label % 3 = 0 then 'table' else 'text_chunk' end as type, embedding from embeddings)
"""

_DISTANCE = (
    "list_sum(list_transform(range(1, len(q.embedding) + 1), "
    "lambda i: (q.embedding[i]::double - d.embedding[i]::double) * (q.embedding[i]::double - d.embedding[i]::double)))"
)


def nearest(queries: str, docs: str, k: int, where: str = "true") -> str:
    return f"""select query_id, doc_id, distance, seq from (
      select *, row_number() over (partition by query_id order by distance, doc_id) seq from (
        select q.query_id, d.doc_id, {_DISTANCE} distance from {queries} q, {docs} d where {where})) where seq <= {k}"""


def nearest_in_base(k: int, where: str = "true") -> str:
    return f"""select kb, query_id, doc_id, distance, seq from (
      select *, row_number() over (partition by kb, query_id order by distance, doc_id) seq from (
        select q.kb, q.query_id, d.doc_id, {_DISTANCE} distance from kb_queries q join kb d on q.kb = d.kb and {where})) where seq <= {k}"""


def text_vector(x: str) -> str:
    digits = f"(md5({x}) || md5('x' || {x}))"
    return f"list_transform(range(1, 65), lambda i: ((strpos('0123456789abcdef', substr({digits}, i, 1)) - 8.5) / 40.0)::float)"


PASSAGES = "passages as (select 'kb' || b kb, item_id query_id, text from benchmark, range(3) r(b))"

KB = f"""
{PASSAGES},
kb_docs as (
  select 'kb' || (d.doc_id % 3) kb, 'k' || lpad(cast(d.doc_id // 3 as varchar), 9, '0') doc_id, d.text, d.source, n_chars,
    case when coalesce(label, d.doc_id // 3) % 3 = 0 then 'table' else 'text_chunk' end as type,
    coalesce(embedding, {text_vector('d.text')}) embedding
  from documents d left join embeddings e on d.doc_id = e.vec_id),
kb as (
  select kb, doc_id, type, embedding, text document,
    case when type = 'table' then 'Table ' || (n_chars % 150) else '' end table_name,
    case when type = 'table' then '' else 'chunk_p' || (n_chars % 50) || '_idx' || n_chars end chunk_id,
    case when type = 'table' then '' else source end title, cast(n_chars % 50 as integer) page_idx
  from kb_docs),
kb_queries as (
  select kb, query_id, text, coalesce(embedding, {text_vector('text')}) embedding from passages left join embeddings e on e.vec_id = query_id)
"""


def chain(k: int = 3) -> str:
    """CTEs of the whole chain up to ranked channels; k is the number of final slots."""
    return f"""
{KB},
{bm25('kb', 'kb_queries', 10)},
pool as (
  select kb, query_id, 'narrow' channel, doc_id, distance, 0 list_no, seq from ({nearest_in_base(4 * k)})
  union all select kb, query_id, 'narrow', doc_id, distance, 1, seq from ({nearest_in_base(50, "d.type = 'table'")})
  union all select kb, query_id, 'wide', doc_id, distance, 0, seq from ({nearest_in_base(160, "d.type = 'text_chunk'")})
  union all select kb, query_id, 'wide', doc_id, null, 1, rank from lexical join kb using (kb, doc_id) where type = 'text_chunk'),
keyed as (
  select p.*, type, table_name, chunk_id, title, page_idx,
    case when type = 'table' then table_name when chunk_id <> '' then chunk_id else title end as key
  from pool p join kb using (kb, doc_id)),
deduped as (
  select * from (select *, row_number() over (partition by kb, query_id, channel, key order by list_no, seq) rn from keyed) where rn = 1),
sized as (
  select *, count(*) filter (where channel = 'narrow') over (partition by kb, query_id) n_narrow from deduped),
pairs as (
  select * from (select *, row_number() over (partition by kb, query_id, key order by case when channel = 'narrow' then 0 else 1 end, list_no, seq) pn
    from sized where n_narrow > {k}) where pn = 1),
pair_scores as (
  select kb, query_id, key, round(0.0 - coalesce(distance, max(distance) over (partition by kb, query_id)), 9) rerank_score from pairs),
scored as (
  select s.*, p.rerank_score, case when len(qc) > 0 then len(list_intersect(qc, dc)) / len(qc) else 0.0 end code_score
  from sized s left join pair_scores p using (kb, query_id, key)
  join (select kb, query_id, {codes('text')} qc from kb_queries) using (kb, query_id)
  join (select kb, doc_id, {codes('document')} dc from kb) using (kb, doc_id)),
normed as (
  select *, (rerank_score - avg(rerank_score) over g) / case when stddev_pop(rerank_score) over g = 0 then 1.0
      else stddev_pop(rerank_score) over g end raw_norm,
    case when channel = 'narrow' then min(list_no * 1000000 + seq) over g else 0 end type_first
  from (select *, case when channel = 'narrow' then type else '*' end grp from scored where rerank_score is not null)
  window g as (partition by kb, query_id, channel, grp)),
ranked as (
  select *, row_number() over (partition by kb, query_id, channel order by norm_score desc, type_first,
      case when channel = 'narrow' then rerank_score else 0.0 end desc, list_no, seq) rank
  from (select *, round(raw_norm + code_score, 9) norm_score from normed)),
floor_stats as (
  select kb, query_id, count(*) n, min(case when type = 'table' then rank end) best from ranked where channel = 'narrow' group by 1, 2),
floor_more as (
  select f.kb, f.query_id, n, best, max(case when r.rank = best then norm_score end) best_score,
    list_extract(list_sort(list(norm_score)), cast(floor(n / 2) as integer) + 1) median
  from floor_stats f join ranked r using (kb, query_id) where channel = 'narrow' group by 1, 2, 3, 4),
floored as (
  select r.*, case when coalesce(n > {k} and best > {k} and best_score >= median, false) then
      case when rank = best then {k} when rank >= {k} and rank < best then rank + 1 else rank end else rank end floor_rank
  from ranked r join floor_more using (kb, query_id) where channel = 'narrow'),
final_tables as (
  select *, row_number() over (partition by kb, query_id order by floor_rank) slot from floored where type = 'table'),
has_wide as (select distinct kb, query_id from ranked where channel = 'wide'),
final_texts as (
  select kb, query_id, channel, doc_id, type, key, norm_score, row_number() over (partition by kb, query_id order by r) slot from (
    select kb, query_id, channel, doc_id, type, key, norm_score, rank r from ranked where channel = 'wide'
    union all select kb, query_id, channel, doc_id, type, key, norm_score, floor_rank from floored
      where type = 'text_chunk' and (kb, query_id) not in (select (kb, query_id) from has_wide))),
final as (
  select kb, query_id, channel, doc_id, type, key, norm_score, row_number() over (partition by kb, query_id order by half, slot) final_rank
  from (select kb, query_id, channel, doc_id, type, key, norm_score, slot, 0 half from final_tables where slot <= {k}
        union all select kb, query_id, channel, doc_id, type, key, norm_score, slot, 1 from final_texts where slot <= {k})),
mixed as (
  select n.kb, n.query_id, coalesce(w.doc_id, n.doc_id) doc_id, coalesce(w.channel, n.channel) channel, floor_rank final_rank
  from (select *, case when type = 'text_chunk' then sum(case when type = 'text_chunk' then 1 else 0 end)
          over (partition by kb, query_id order by floor_rank) end turn from floored where floor_rank <= {k}) n
  left join (select * from ranked where channel = 'wide') w on w.kb = n.kb and w.query_id = n.query_id and w.rank = n.turn),
fallback as (
  select kb, query_id, doc_id, distance, final_rank from (
    select *, row_number() over (partition by kb, query_id order by distance nulls last, list_no, seq) final_rank
    from deduped where channel = 'narrow') where final_rank <= {k}),
evidence as (
  select kb, query_id, string_agg(case when f.type = 'table' then '[TABLE] ' || table_name || {NL} || {NL} || document
      else '[TEXT] ' || title || {NL} || {NL} || '[SECTION] Root > ' || title || {NL} || {NL} || '[CONTENT]' || {NL} || document end,
      {NL} || {NL} || repeat('=', 60) || {NL} || {NL} order by final_rank) context, count(*) n_blocks
  from final f join kb using (kb, doc_id) group by kb, query_id)
"""


CORPUS = f"""{PASSAGES}, corpus as (select 'kb' || (doc_id % 3) kb, doc_id // 3 doc_id, text document, source from documents),
  {bm25('corpus', 'passages', 10)}"""
_ALL = "vector_queries as (select vec_id query_id, embedding from embeddings)"

_WINDOW_FREE_KB = rf"""
kb_rows as (
  select 'orders' kb, 'table_p' || k || '_idx' || k doc_id, 'table' as type, display_name || {NL} || serialized document,
    table_name, '' chunk_id, '' section_path
  from serialized join notes using (table_id))
"""

ORACLES = {
    "kb_documents": f"""with {cells('value')}, {VALUE_FACTS}, {DOCUMENTS}, {_WINDOW_FREE_KB}, {BLOCKS}, block_body as (select 1),
        {BODY.replace('body as (', 'text_body as (', 1).replace('from body b', 'from text_body b').replace('from body)', 'from text_body)')}, {SECTIONS}, {CHUNKS}
        select kb, doc_id, type, document, table_name, chunk_id, section_path from kb_rows
        union all
        select standard_id, chunk_id, 'text_chunk', case when array_to_string(section_path, ' > ') <> title
            then array_to_string(section_path, ' > ') || {NL} else '' end || title || {NL} || content,
          '', chunk_id, array_to_string(section_path, ' > ') from chunks""",
    "kb_catalog": f"""with {KB} select kb, count(*) filter (where type = 'table') tables,
        count(distinct case when type = 'text_chunk' then chunk_id end) chunks, count(*) total, kb collection from kb group by 1""",
    "stored_kb": f"""with {KB} select kb, doc_id, type, table_name, document from kb where type = 'text_chunk'
        union all select 'second', doc_id, type, table_name, document from kb""",
    "stream_kb_refresh": f"with {KB} select kb, doc_id, type, table_name, document from kb",
    "attach_questions": rf"""with asked as (select doc_id, i, {strip(r"regexp_replace(ln, '^[-*0123456789.) ]+', '')")} q from (
          select doc_id, i, {strip('list_extract(ls, i)')} ln from (
            select doc_id, ls, unnest(range(1, len(ls) + 1)) i
            from (select doc_id, string_split(replace(text, '. ', '? ' || {NL} || '- '), {NL}) ls from documents)))),
        good as (select doc_id, q, row_number() over (partition by doc_id order by i) rn from asked where length(q) >= 15 and q like '%?%')
        select 'main' kb, doc_id chunk_id, rn - 1 question_no, q question from good where rn <= 2""",
    "chunks_to_do": rf"""with {BLOCKS}, {BODY}, {SECTIONS}, {CHUNKS},
        asked as (select standard_id, chunk_id, {strip(r"regexp_replace(ln, '^[-*0123456789.) ]+', '')")} q from (
          select standard_id, chunk_id, {strip('list_extract(ls, i)')} ln from (
            select standard_id, chunk_id, ls, unnest(range(1, len(ls) + 1)) i
            from (select standard_id, chunk_id, string_split(replace(content, '. ', '? ' || {NL} || '- '), {NL}) ls from chunks where length(content) % 3 < 2)))),
        done as (select distinct standard_id, chunk_id from asked where length(q) >= 15 and q like '%?%')
        select standard_id kb, chunk_id, length(content) n_chars from chunks anti join done using (standard_id, chunk_id)""",
    "lexical_index": f"""with {CORPUS} select kb, doc_id, token, tf, doc_len, df, round(idf, 6) idf
        from postings p join doc_lens using (kb, doc_id) join terms using (kb, token)""",
    "tokens": f"""select item_id query_id, array_to_string({toks('text')}, ' ') tokens, len({codes('text')}) n_codes from benchmark
        union all select -1 - doc_id, array_to_string({words('text')}, ' '), len({codes('text')}) from documents""",
    "bm25_topk": f"with {CORPUS} select kb, query_id, doc_id, score, rank from lexical",
    "code_overlap": f"""with c as (select doc_id, {codes('text')} c, source from documents),
        pairs as (select doc_id, c, lag(c) over w q, row_number() over w rn from c window w as (partition by source order by doc_id))
        select doc_id, round(case when len(q) > 0 then len(list_intersect(q, c)) / len(q) else 0.0 end, 6) code_score from pairs where rn > 1""",
    "vector_topk": f"with {VECTOR_DOCS}, {_ALL} select query_id, doc_id, round(distance, 6) distance, seq from ({nearest('vector_queries', 'vector_docs', 12)})",
    "vector_topk_by_type": f"""with {VECTOR_DOCS}, {_ALL}
        select query_id, doc_id, round(distance, 6) distance, seq from ({nearest('vector_queries', 'vector_docs', 50, "d.type = 'table'")})""",
    "candidate_pool": f"with {chain()} select kb, query_id, channel, list_no, doc_id, round(distance, 6) distance, seq from pool",
    "dedupe_candidates": f"with {chain()} select kb, query_id, channel, doc_id, key, list_no, seq from deduped",
    "rerank": f"with {chain()} select kb, query_id, channel, key, doc_id, round(rerank_score, 6) rerank_score from scored",
    "znorm_by_modality": f"with {chain()} select kb, query_id, channel, doc_id, round(raw_norm, 6) norm_score from normed",
    "fuse_code_bonus": f"with {chain()} select kb, query_id, channel, doc_id, norm_score, rank from ranked",
    "table_floor": f"with {chain()} select kb, query_id, doc_id, rank before_rank, floor_rank rank from floored",
    "split_topk": f"with {chain()} select kb, query_id, channel, doc_id, type, final_rank from final",
    "mixed_slot_fill": f"with {chain()} select kb, query_id, channel, doc_id, final_rank from mixed",
    "distance_fallback": f"with {chain()} select kb, query_id, doc_id, round(distance, 6) distance, final_rank from fallback",
    "format_context": f"with {chain()} select kb, query_id, n_blocks, context from evidence",
    "retrieve": f"with {chain()} select kb, query_id, doc_id, type, key, norm_score, final_rank from final",
}


def _letters(text: str, letters: str) -> str:
    return "[" + ", ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in letters) + "]"


ORACLES["embed"] = f"""with {ROUTED} select 'kb' || (doc_id % 3) kb, doc_id // 3 doc_id, route, array_to_string(
      case when route = 'english' then {_letters('text', 'abcdefgh')} else {_letters('text', 'éçğışöüa')} end, ',') as vector
    from routed join documents using (doc_id)"""
