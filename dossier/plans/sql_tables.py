"""Independent SQL for the table queries (DuckDB dialect), used only to check results."""

from __future__ import annotations

from dossier.plans.sql_text import BLOCKS, NL, strip

REPEATED = rf"""
repeated_texts as (
  select standard_id, lower({strip('text')}) t, count(distinct page_idx) n_pages from blocks
  where length({strip('text')}) >= 5 group by 1, 2 having count(distinct page_idx) >= 5)
"""

RAW_CELLS = rf"""
raw_rows as (
  select standard_id, block_idx, ri, string_split(list_extract(rs, ri), ' ') cs
  from (select *, unnest(range(1, len(rs) + 1)) ri
        from (select standard_id, block_idx, string_split(regexp_replace(line, '[<>&]', '', 'g'), '. ') rs
              from blocks where type = 'table'))),
raw_cells as (
  select standard_id, block_idx, ri, ci - 1 ci, {strip('list_extract(cs, ci)')} as text
  from (select *, unnest(range(1, len(cs) + 1)) ci from raw_rows)),
full_rows as (
  select standard_id, block_idx, ri, row_number() over (partition by standard_id, block_idx order by ri) - 1 row_idx
  from raw_cells group by 1, 2, 3 having max(length(text)) > 0),
block_cells as (
  select standard_id, block_idx, row_idx, ci col_idx, text from raw_cells join full_rows using (standard_id, block_idx, ri))
"""

QUALITY = rf"""
counted as (
  select standard_id, block_idx, count(*) n_cells, count(*) filter (where text <> '') n_filled from raw_cells group by 1, 2),
quality as (
  select b.standard_id, b.block_idx table_idx, b.table_name, b.page_idx, length(b.table_body) html_len, n_cells, n_filled,
    n_filled / n_cells fill_rate,
    case when length(b.table_body) < 100 then 'html_too_short' when n_filled / n_cells < 0.30 then 'low_fill'
         when r.t is not null then 'caption_boilerplate' end reject_reason
  from blocks b join counted using (standard_id, block_idx)
  left join repeated_texts r on r.standard_id = b.standard_id and r.t = lower(b.table_name)
  where b.type = 'table')
"""

CONTEXT = rf"""
quiet as (
  select b.standard_id, b.block_idx, b.type, coalesce({strip('b.text')}, '') as text, b.text_level,
    list_filter(list_transform(b.list_items, lambda x: {strip('x')}), lambda x: x <> '') items
  from blocks b left join repeated_texts r on r.standard_id = b.standard_id and r.t = lower(coalesce({strip('b.text')}, ''))
  where b.type not in ('header', 'footer', 'page_number') and r.t is null),
seg as (
  select *, sum(case when type = 'table' then 1 else 0 end) over (partition by standard_id order by block_idx) s from quiet),
level_best as (
  select standard_id, s, text_level, max(block_idx) block_idx, arg_max(text, block_idx) title
  from seg where type = 'text' and text <> '' and text_level is not null group by 1, 2, 3),
level_ranked as (
  select *, row_number() over (partition by standard_id, s order by block_idx desc) rn from level_best),
before as (
  select t.standard_id, t.block_idx table_idx,
    coalesce(string_agg(l.text_level || ':' || l.title, '|' order by l.rn), '') hierarchy
  from seg t left join level_ranked l on l.standard_id = t.standard_id and l.s = t.s - 1 and l.rn <= 3
  where t.type = 'table' group by 1, 2),
flags as (
  select *, type = 'text' and regexp_replace(lower(text), ':+$', '') in ('note', 'notes') notes_word,
    type = 'list' and len(items) > 0 has_items,
    type = 'text' and (lower(text) like '%legend%' or lower(text) like 'x=%' or lower(text) like '%mixing permitted%') legendish,
    type = 'text' and (coalesce(text_level <= 2, false) or regexp_matches(text, '^\d+\.\d+')) heading
  from seg where s > 0 and type <> 'table'),
noted as (
  select *, coalesce(max(case when notes_word or has_items then 1 end) over (
      partition by standard_id, s order by block_idx rows between unbounded preceding and 1 preceding), 0) = 1 in_notes
  from flags),
stopped as (
  select *, coalesce(max(case when heading and not notes_word and not (legendish and not in_notes) then 1 end) over (
      partition by standard_id, s order by block_idx), 0) = 1 past
  from noted),
after as (
  select standard_id, s,
    arg_max(text, block_idx) filter (where legendish and not in_notes and not past) legend,
    string_agg(case when has_items then array_to_string(items, '|') else text end, '|' order by block_idx)
      filter (where not past and (has_items or (type = 'text' and in_notes and not notes_word and text <> ''))) notes,
    string_agg(text, '|' order by block_idx) filter (where not past and type = 'page_footnote' and text <> '') footnotes
  from stopped group by 1, 2),
trailing_of as (
  select t.standard_id, t.block_idx table_idx, coalesce(a.legend, '') legend, coalesce(a.notes, '') notes,
    coalesce(a.footnotes, '') footnotes
  from seg t left join after a on a.standard_id = t.standard_id and a.s = t.s where t.type = 'table')
"""

_HEADS = "['Urgent Orders', 'High Orders', 'Medium Orders', 'Plain Orders', 'low orders']"

_STYLES = {
    "value": r"""case when c is null then '' when c % 3 = 0 then c || '$^{1}$' when c % 5 = 0 then '$\geq ' || c || '^{2}$'
        when c % 7 = 0 then c || ' [9]' else cast(c as varchar) end""",
    "binary": "case when c is null then '' when c % 7 = 0 then 'see [1]' when c > 1 then 'X' else '' end",
    "status": """case when c is null then '' when c % 5 = 0 then 'Note 1' when c % 2 = 0 then 'Qualified'
        else 'Partially Qualified' end""",
    "key_value": """case when c is null then '' when c % 4 = 0 then rl || '; 1.' || c when c % 3 = 0 then c || ' [1]'
        else cast(c as varchar) end""",
}
# What cleaning makes of the cell texts above.
_CLEAN = {
    **_STYLES,
    "value": """case when c is null then '' when c % 3 = 0 then c || '[1]' when c % 5 = 0 then '≥ ' || c || '^(2)'
        when c % 7 = 0 then c || ' [9]' else cast(c as varchar) end""",
}


def cells(style: str) -> str:
    """Long-form body cells of one style with raw and clean text, and the row and column labels."""
    return rf"""
counts as (
  select n_name table_id, strftime(o_orderdate, '%Y.%m') rl, cast(substr(o_orderpriority, 1, 1) as integer) p, count(*) c
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3),
row_labels as (
  select table_id, rl, row_number() over (partition by table_id order by rl) row_idx from (select distinct table_id, rl from counts)),
slots as (select table_id, rl, row_idx, p from row_labels cross join (select unnest(range(1, 6)) p)),
body as (
  select table_id, row_idx, p col_idx, rl, '1.' || p cl, list_extract({_HEADS}, p) head, c,
    {_STYLES[style]} raw, {_CLEAN[style]} as text
  from slots left join counts using (table_id, rl, p)),
notes as (
  select n_name table_id, n_nationkey k,
    case when n_nationkey % 3 = 0 then 'Table_page' || n_nationkey else 'Orders of ' || n_name end table_name,
    case when n_nationkey % 2 = 0 then 'Legend: X = orders of ' || n_name || ' seen; else none' else '' end legend,
    'counted in ' || n_name foot1, 'by month' foot2
  from nation),
resolved as (
  select *, replace(replace(text, '[1]', '(' || foot1 || ')'), '[2]', '(' || foot2 || ')') resolved
  from body join notes using (table_id))
"""


VALUE_FACTS = f"""
value_facts as (
  select table_id, 0 row_idx, 0 col_idx, 'Hazard Class (HC) combination matrix — resulting value for each pair:' fact
  from (select distinct table_id from body)
  union all
  select table_id, row_idx, col_idx, 'HC ' || rl || ' + HC ' || cl || ' → ' || resolved || '.' from resolved where text <> '')
"""

BINARY_FACTS = """
meanings as (
  select table_id, case when legend = '' then 'permitted (marked X)' else 'orders of ' || table_id || ' seen' end yes,
    case when legend = '' then 'not permitted (unmarked)' else 'orders of ' || table_id || ' NOT seen' end no
  from notes),
binary_facts as (
  select table_id, 0 row_idx, 0 col_idx, 'Hazard Class — row with column (X = ' || yes || '):' fact
  from (select distinct table_id from body) join meanings using (table_id)
  union all
  select table_id, row_idx, col_idx, rl || ' with ' || cl || ': ' ||
    case when text = 'X' then yes when text = '' then no else resolved end || '.'
  from resolved join meanings using (table_id))
"""

KEY_VALUE_FACTS = rf"""
pairs as (
  select table_id, row_idx, 0 col_idx, 'Month ' || rl || ' ' fact_part, true is_label, rl, resolved from resolved where false
  union all
  select table_id, row_idx, col_idx,
    head || ': ' || case when c % 4 = 0 and col_idx < 5 then
        list_extract(['UO', 'HO', 'MO', 'PO'], col_idx) || ' ' || rl || ' (' || head || ' ' || rl || '); ' ||
        list_extract(['UO', 'HO', 'MO', 'PO'], col_idx) || ' 1.' || c || ' (' || head || ' 1.' || c || ')'
      when c % 4 = 0 then head || ' ' || rl || '; ' || head || ' 1.' || c
      else resolved end, false, rl, resolved
  from resolved where text <> ''
  union all
  select table_id, row_idx, 0, 'Month: Month ' || rl, true, rl, '' from row_labels),
key_value_facts as (
  select table_id, row_idx, 0 col_idx, string_agg(fact_part, '; ' order by col_idx) || '.' fact from pairs group by 1, 2)
"""

DOCUMENTS = rf"""
contents as (select table_id, string_agg(fact, {NL} order by row_idx, col_idx) content from value_facts group by 1),
documents_of as (
  select n.table_id,
    case when k % 3 = 0 then 'Table (p.' || k || ')' || case when k % 5 <> 0 then ': Far' else '' end else table_name end display_name,
    k % 5 <> 0 sectioned, legend, content, k, foot1, foot2
  from notes n left join contents using (table_id)),
serialized as (
  select table_id, display_name,
    display_name || case when sectioned then {NL} || 'Section: Near ' || table_id || ' > Far' else '' end
    || case when legend <> '' then {NL} || legend else '' end
    || coalesce({NL} || {NL} || content, '')
    || case when k % 4 = 0 then {NL} || {NL} || 'Notes:' || {NL} || '- first note' || {NL} || '- second note' else '' end
    || {NL} || {NL} || 'Footnotes:' || {NL} || '- $^{{1}}$ ' || foot1 || {NL} || '- 2 ' || foot2 serialized
  from documents_of)
"""

VARIANT_ROWS = rf"""
first_rows as (
  select standard_id, block_idx, row_idx, string_agg(text, ' | ' order by col_idx) line
  from block_cells where row_idx < 4 group by 1, 2, 3),
row_texts as (
  select standard_id, block_idx, string_agg(line, {NL} order by row_idx) rows, max(case when row_idx = 0 then line end) head
  from first_rows group by 1, 2),
plain as (
  select standard_id, block_idx, string_agg(text, ' ' order by ri, ci) t from raw_cells where text <> '' group by 1, 2),
variant_base as (
  select b.standard_id || '#' || b.block_idx table_id,
    case when n % 2 = 0 and {strip("string_split(line, ' ')[1]")} <> '' then {strip("string_split(line, ' ')[1]")}
      else 'Table (p.' || page_idx || ')' end cap,
    p.t, r.rows, r.head
  from blocks b left join plain p using (standard_id, block_idx) left join row_texts r using (standard_id, block_idx)
  where b.type = 'table'),
variants as (
  select table_id, 'A' as method, 'caption_only' as name, cap as document from variant_base
  union all select table_id, 'B', 'caption_plus_headers', cap || case when head <> '' then {NL} || head else '' end from variant_base
  union all select table_id, 'C', 'html_stripped', cap || {NL} || coalesce(t, '') from variant_base
  union all select table_id, 'D', 'caption_first3rows', cap || coalesce({NL} || rows, '') from variant_base
  union all select table_id, 'F', 'full_text_stripped', cap || {NL} || coalesce(t, '') from variant_base)
"""

_B = f"with {BLOCKS}, {REPEATED}"

ORACLES = {
    "table_cells": f"with {BLOCKS}, {RAW_CELLS} select standard_id, block_idx table_idx, cast(row_idx as integer) row_idx, cast(col_idx as integer) col_idx, text from block_cells",
    "grid_shape": f"""with {BLOCKS}, {RAW_CELLS} select standard_id, block_idx table_idx, max(row_idx) + 1 n_rows, max(col_idx) + 1 n_cols,
        count(*) n_cells, round(avg(case when text <> '' then 1 else 0 end), 6) fill_rate from block_cells group by 1, 2""",
    "table_quality": f"""{_B}, {RAW_CELLS}, {QUALITY}
        select standard_id, table_idx, table_name, page_idx, html_len, n_cells, n_filled, round(fill_rate, 6) fill_rate, reject_reason from quality""",
    "heading_context": f"{_B}, {CONTEXT} select standard_id, table_idx, hierarchy from before",
    "trailing_context": f"{_B}, {CONTEXT} select standard_id, table_idx, legend, notes, footnotes from trailing_of",
    "table_units": f"""{_B}, {RAW_CELLS}, {QUALITY}, {CONTEXT}
        select q.standard_id, q.table_idx, q.table_name, q.page_idx, hierarchy, legend, notes, footnotes, '' reject_reason
        from quality q join before using (standard_id, table_idx) join trailing_of using (standard_id, table_idx) where reject_reason is null
        union all select standard_id, table_idx, table_name, page_idx, null, null, null, null, reject_reason
        from quality where reject_reason is not null""",
    "resolve_footnotes": f"""with {cells('value')}
        select table_id, row_idx, col_idx, text, resolved, case when text like '%[%' then 1 else 0 end n_marks,
          case when text like '%[9]%' then 1 else 0 end n_unresolved from resolved
        union all select table_id, row_idx, 0, rl, rl, 0, 0 from row_labels
        union all select distinct table_id, 0, p, '1.' || p, '1.' || p, 0, 0 from slots
        union all select distinct table_id, 0, 0, 'Hazard Class', 'Hazard Class', 0, 0 from row_labels""",
    "classify_tables": " union all ".join(
        f"""select * from (with {cells(style)}
        select '{style}/' || table_id table_id, max(row_idx) + 1 n_rows, 6 n_cols,
          round(avg(case when upper(text) in ('X', '') then 1.0 else 0.0 end), 6) x_share,
          case when avg(case when upper(text) in ('X', '') then 1.0 else 0.0 end) >= 0.7 then 'binary_matrix'
            when '{style}' = 'key_value' then 'key_value' else 'value_matrix' end kind
        from body group by table_id)"""
        for style in ("value", "binary", "key_value")
    ),
    "value_matrix_facts": f"with {cells('value')}, {VALUE_FACTS} select table_id, row_idx, col_idx, fact from value_facts",
    "binary_matrix_facts": f"with {cells('binary')}, {BINARY_FACTS} select table_id, row_idx, col_idx, fact from binary_facts",
    "key_value_facts": f"with {cells('key_value')}, {KEY_VALUE_FACTS} select table_id, row_idx, col_idx, fact from key_value_facts",
    "table_documents": f"with {cells('value')}, {VALUE_FACTS}, {DOCUMENTS} select table_id, display_name, serialized from serialized",
    "serialization_variants": f"with {BLOCKS}, {RAW_CELLS}, {VARIANT_ROWS} select table_id, method, name, document from variants",
}
