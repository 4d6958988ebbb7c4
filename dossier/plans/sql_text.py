"""Independent SQL for the text queries (DuckDB dialect), used only to check results."""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    collapsed = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    return f"lower({strip(collapsed)})"


NL = "chr(10)"

# The same blocks as inputs.blocks, with plain windows over each standard.
BLOCKS = rf"""
doc_lines as (
  select source standard_id, doc_id, i - 1 line_no, list_extract(string_split(text, {NL}), i) line
  from (select source, doc_id, text, unnest(range(1, len(string_split(text, {NL})) + 1)) i from documents)),
numbered as (
  select standard_id, cast(dense_rank() over (partition by standard_id order by doc_id) - 1 as integer) page_idx,
    row_number() over (partition by standard_id order by doc_id, line_no) - 1 block_idx, line, length(line) n,
    case when length(line) = 0 then null when line_no = 0 and length(line) < 120 then 1
         when length(line) < 40 then 2 + length(line) % 3 end text_level
  from doc_lines),
typed as (
  select *, case when text_level is not null then 'text' when n % 19 = 5 then 'table' when n % 17 = 3 then 'header'
    when n % 13 = 4 then 'page_footnote' when n % 11 = 2 then 'list' else 'text' end as type from numbered),
blocks as (
  select standard_id, page_idx, block_idx, type, text_level, line, n,
    case when type = 'table' then null when type = 'text' and text_level is null and n % 23 = 1 then 'Notes:'
         when type = 'text' and text_level is null and n % 29 = 2 then 'Legend: X = ' || line else line end as text,
    case when type in ('list', 'page_footnote') then string_split(line, ', ') else [] end as list_items,
    case when type = 'table' then '<table><tr><td>' ||
      replace(replace(regexp_replace(line, '[<>&]', '', 'g'), '. ', '</td></tr><tr><td>'), ' ', '</td><td>')
      || '</td></tr></table>' end as table_body,
    case when type = 'table' and n % 2 = 0 then {strip("string_split(line, ' ')[1]")}
         when type = 'table' then 'Table_page' || page_idx end as table_name
  from typed)
"""

BODY = rf"""
body as (
  select *, case type when 'text' then {strip("coalesce(text, '')")}
    else array_to_string(list_filter(list_concat([{strip("coalesce(text, '')")}],
           list_transform(list_items, lambda x: {strip('x')})), lambda x: x <> ''), {NL}) end as content
  from blocks where type in ('text', 'list', 'page_footnote')),
body_lines as (
  select standard_id, block_idx, page_idx, {norm('l')} line
  from (select standard_id, block_idx, page_idx, unnest(string_split(content, {NL})) l from body)),
repeated as (
  select standard_id, line, count(distinct page_idx) n_pages from body_lines where line <> '' group by 1, 2
  having count(distinct page_idx) >= 5),
repeated_of as (select standard_id, list(line) lines from repeated group by 1),
stripped as (
  select b.*, r.lines dropped,
    case when r.lines is null then content else
      {strip(f"array_to_string(list_filter(string_split(content, {NL}), lambda x: not list_contains(r.lines, {norm('x')})), {NL})")}
    end as kept
  from body b left join repeated_of r using (standard_id))
"""

SECTIONS = rf"""
marked as (
  select standard_id, block_idx, page_idx, text_level, kept, {strip("coalesce(text, '')")} title,
    type = 'text' and coalesce(text_level in (1, 2, 3, 4), false) and {strip("coalesce(text, '')")} <> '' is_heading,
    coalesce(list_contains(dropped, {norm("coalesce(text, '')")}), false) is_repeated
  from stripped),
usable as (
  select standard_id, block_idx, page_idx, is_heading, text_level, title,
    case when is_heading then title else kept end content
  from marked where not (is_heading and is_repeated) and case when is_heading then title else kept end <> ''),
opened as (
  select *, not is_heading and row_number() over w = 1 opens
  from usable window w as (partition by standard_id order by block_idx)),
started as (
  select standard_id, block_idx, page_idx, content, is_heading or opens is_start,
    case when opens then 1 else text_level end lvl, case when opens then 'Preamble' else title end title
  from opened),
starts as (
  select *, row_number() over (partition by standard_id order by block_idx) i from started where is_start),
depths as (
  select *, i + least(0, min(lvl - i) over (partition by standard_id order by block_idx)) depth from starts),
stacked as (
  select *, last_value(case when depth = 1 then title end ignore nulls) over w t1,
    last_value(case when depth = 2 then title end ignore nulls) over w t2,
    last_value(case when depth = 3 then title end ignore nulls) over w t3,
    last_value(case when depth = 4 then title end ignore nulls) over w t4
  from depths window w as (partition by standard_id order by block_idx rows between unbounded preceding and current row)),
sections as (
  select standard_id, block_idx start_idx, page_idx, title,
    list_slice([t1, t2, t3, t4], 1, depth) section_path from stacked),
placed as (
  select *, max(case when is_start then block_idx end) over (partition by standard_id order by block_idx) start_idx
  from started)
"""

CHUNKS = rf"""
chunks as (
  select standard_id, 'chunk_p' || page_idx || '_idx' || start_idx chunk_id, start_idx, page_idx, title, section_path, content
  from (select standard_id, start_idx, {strip(f"string_agg(content, {NL} order by block_idx)")} content
        from placed where start_idx is not null group by 1, 2)
  join sections using (standard_id, start_idx) where length(content) >= 30)
"""

_EN = ("the and of to in for is are be as that with this or by an from at which "
       "shall not on all any such where when").split()
_TR = ("ve bir bu için ile olan da de en çok veya göre gibi ancak ise her daha olarak "
       "madde edilir yapılır şekilde durumda ya").split()


def _words(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


ROUTED = f"""
low as (select doc_id, lang, lower(text) t from documents),
counted as (
  select doc_id, lang, regexp_extract_all(t, '[a-zçğıöşü]+') w,
    length(t) - length(translate(t, 'ığş', '')) tr_letters from low),
rates as (
  select doc_id, lang, len(w) n_words, tr_letters,
    case when len(w) > 0 then len(list_filter(w, lambda x: list_contains({_words(_EN)}, x))) / len(w) else 0.0 end en_rate,
    case when len(w) > 0 then len(list_filter(w, lambda x: list_contains({_words(_TR)}, x))) / len(w) else 0.0 end tr_rate
  from counted),
routed as (
  select *, case when n_words >= 30 and (tr_letters >= 5 or tr_rate > en_rate or en_rate < 0.04)
    then 'multilingual' else 'english' end route from rates)
"""

ITEMS = rf"""
report_lines as (
  select conv_id report_id, turn * 1000000 + i - 1 line_no,
    regexp_replace(list_extract(string_split(t, {NL}), i), '\s+$', '') line
  from (select conv_id, turn, t, unnest(range(1, len(string_split(t, {NL})) + 1)) i
        from (select conv_id, turn, (turn + 1) || '. ' || text t from conversations))),
item_marks as (
  select *, regexp_matches(line, '^\d{{1,3}}\.\s+') starts from report_lines),
item_parts as (
  select *, max(case when starts then line_no end) over (partition by report_id order by line_no) item_line,
    case when starts then {strip(r"regexp_extract(line, '^\d{1,3}\.\s+(.*)', 1)")} else {strip('line')} end part
  from item_marks),
items as (
  select report_id, item_line,
    cast(max(case when starts then regexp_extract(line, '^(\d{{1,3}})\.', 1) end) as integer) item_no,
    {strip("string_agg(part, ' ' order by line_no) filter (where starts or part <> '')")} as text
  from item_parts where item_line is not null group by 1, 2)
"""

ORACLES = {
    "read_blocks": f"with {BLOCKS} select standard_id, block_idx, page_idx, type, text, text_level, table_body from blocks",
    "shard_quarantine": f"""with {BLOCKS},
        shards as (select standard_id, cast(page_idx // 20 as bigint) shard, count(*) n, cast(substr(standard_id, 4) as int) % 5 kind from blocks group by all),
        said as (select standard_id, shard, n, case when kind = 1 and shard = 0 then 'not JSON' when kind = 2 and shard > 0 then 'no list of blocks'
          when kind = 3 and shard = 0 then 'block without fields' end reason from shards)
        select standard_id, shard, case when reason is null then n end n_blocks, reason, count(reason) over (partition by standard_id) = 0 as standard_read from said""",
    "read_whole_standards": f"""with {BLOCKS}, last_page as (select standard_id, max(page_idx) p from blocks group by 1)
        select standard_id, block_idx, page_idx, type, text, text_level, table_body from blocks join last_page using (standard_id)
        where cast(substr(standard_id, 4) as int) % 5 in (0, 4) or cast(substr(standard_id, 4) as int) % 5 = 2 and p < 20""",
    "block_text": f"with {BLOCKS}, {BODY} select standard_id, block_idx, type, content from body",
    "repeated_lines": f"with {BLOCKS}, {BODY} select standard_id, line, n_pages from repeated",
    "strip_repeated_lines": f"with {BLOCKS}, {BODY} select standard_id, block_idx, kept as content from stripped",
    "repeated_blocks": f"""with {BLOCKS} select standard_id, lower({strip('text')}) as text, count(distinct page_idx) n_pages
        from blocks where length({strip('text')}) >= 5 group by 1, 2 having count(distinct page_idx) >= 5""",
    "section_paths": f"""with {BLOCKS}, {BODY}, {SECTIONS}
        select standard_id, p.block_idx, start_idx, s.title, array_to_string(section_path, ' > ') section_path
        from placed p join sections s using (standard_id, start_idx)""",
    "section_chunks": f"""with {BLOCKS}, {BODY}, {SECTIONS}, {CHUNKS}
        select standard_id, chunk_id, title, array_to_string(section_path, ' > ') section_path, content, page_idx from chunks""",
    "route_language": f"""with {ROUTED} select doc_id, n_words, round(en_rate, 6) en_rate, round(tr_rate, 6) tr_rate, tr_letters, route from routed""",
    "route_counts": f"with {ROUTED} select route, lang, count(*) n_docs from routed group by 1, 2",
    "numbered_items": f"with {ITEMS} select report_id, item_line, item_no, text from items where text <> ''",
}

ORACLES["pack_windows"] = f"""with recursive {BLOCKS}, {BODY}, {SECTIONS}, {CHUNKS},
    cut_lines as (select standard_id, chunk_id, content, string_split(content, {NL}) ls from chunks),
    packed as (
      select standard_id, chunk_id, ls, 1 i, ls[1] cur, 0 w from cut_lines where length(content) > 400
      union all
      select standard_id, chunk_id, ls, i + 1,
        case when length(cur) > 0 and length(cur) + 1 + length(ls[i + 1]) <= 400 then cur || {NL} || ls[i + 1] else ls[i + 1] end,
        case when length(cur) > 0 and length(cur) + 1 + length(ls[i + 1]) > 400 then w + 1 else w end
      from packed where i < len(ls)),
    ended as (
      select standard_id, chunk_id, w window_no, arg_max(cur, i) as window_text, max(i) = any_value(len(ls)) as is_last from packed group by 1, 2, 3),
    windows as (
      select standard_id, chunk_id, window_no, window_text from ended where not (is_last and {strip('window_text')} = '')
      union all select standard_id, chunk_id, 0, content from cut_lines where length(content) <= 400)
    select standard_id, chunk_id, case when count(*) over (partition by standard_id, chunk_id) = 1 then chunk_id
        else chunk_id || '__w' || window_no end doc_id, window_no, window_text as "window" from windows"""
