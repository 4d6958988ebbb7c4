"""Independent SQL for evaluation queries (DuckDB dialect), used only to check results."""

from __future__ import annotations

from dossier.plans.sql_audit import RUNS
from dossier.plans.sql_retrieval import CORPUS, chain
from dossier.plans.sql_tables import RAW_CELLS, VARIANT_ROWS
from dossier.plans.sql_text import BLOCKS, BODY, CHUNKS, NL, SECTIONS, strip

_LEXICAL = f"""
{CORPUS},
gold as (select b.kb, b.query_id, doc_id, source grp from passages b join corpus d on b.kb = d.kb and contains(d.document, b.text)),
found as (
  select g.kb, g.query_id, 'chunk_p0_idx' || g.doc_id as label, g.grp, min(l.rank) rank
  from gold g left join lexical l on l.kb = g.kb and l.query_id = g.query_id and l.doc_id = g.doc_id group by 1, 2, 3, 4)
"""

_METRICS = """round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) hr1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) hr3,
  round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) hr5, round(avg(coalesce(1.0 / rank, 0.0)), 6) mrr, count(*) n"""

# Scenarios on the vector base: half of the labels are chunks, half tables (with rules for some).
_SCEN = f"""
{chain(5)},
scen as (
  select q.kb, q.query_id, 'own' grp, case when kb.type = 'table' then
      case when length(q.text) % 2 = 0 then 'Rule ' || table_name else table_name end else chunk_id end as label
  from kb_queries q join kb on kb.kb = q.kb and kb.doc_id = 'k' || lpad(cast(q.query_id as varchar), 9, '0')),
shown as (
  select f.kb, f.query_id, f.type, kb.table_name, kb.chunk_id, kb.page_idx, f.final_rank,
    row_number() over (partition by f.kb, f.query_id, f.type order by f.final_rank) rank
  from final f join kb using (kb, doc_id)),
hits as (
  select s.kb, s.query_id, s.label, s.grp, m.rank,
    case when s.label like 'chunk_%' then m.chunk_id = s.label
      when s.label like 'Rule Table 1%' then (starts_with(m.table_name, 'Table 1') and not contains(m.table_name, '11')) or m.page_idx = 7
      else starts_with(m.table_name, s.label) end hit_chunk,
    case when s.label like 'chunk_%' then m.page_idx = cast(regexp_extract(s.label, '^chunk_p(\\d+)_idx', 1) as integer)
      when s.label like 'Rule Table 1%' then (starts_with(m.table_name, 'Table 1') and not contains(m.table_name, '11')) or m.page_idx = 7
      else starts_with(m.table_name, s.label) end hit_page
  from scen s left join shown m on m.kb = s.kb and m.query_id = s.query_id
    and m.type = case when s.label like 'chunk_%' then 'text_chunk' else 'table' end),
gold_ranks as (
  select kb, query_id, label, grp, min(case when hit_chunk then rank end) rank_chunk, min(case when hit_page then rank end) rank_page
  from hits group by 1, 2, 3, 4)
"""

_SUITE = f"""
suite as (
  select run, match_mode, {_METRICS} from (
    select 'exact' run, 'chunk' match_mode, rank_chunk rank from gold_ranks
    union all select 'page', 'page', rank_page from gold_ranks
    union all select 'loose', 'page', case when rank_page > 2 then rank_page - 1 else rank_page end from gold_ranks) group by 1, 2)
"""

_EXPECTED = "expected_items as (select l.doc_id item_no, case when quality = 1 then 'COMPLIANT' else 'NON_COMPLIANT' end expected, source grp from labels l join documents d using (doc_id) where toxic = 0)"

_SCORE = """sum(case when e.expected is not null then 1 else 0 end) total,
  sum(case when e.expected is not null and r.verdict = e.expected then 1 else 0 end) correct,
  sum(case when e.expected is not null and r.verdict <> e.expected then 1 else 0 end) wrong,
  sum(case when e.expected is null then 1 else 0 end) skipped"""

_OLD_NEW = """
old_run as (select item_no, verdict, expected from runs where model = 'small'),
new_run as (select item_no, verdict, expected from runs where model = 'large' and grp <> 'src3')
"""


def _card(policy: str) -> str:
    where = "where r.verdict <> 'NOT_EVALUATED'" if policy == "exclude" else ""
    return f"""with {RUNS}, {_EXPECTED}, joined as (
          select r.model run, case when e.expected is not null then e.grp end grp, e.expected, r.verdict
          from runs r left join expected_items e using (item_no) {where}),
        cards as (
          select run, 'all' as scope, null grp, {_SCORE.replace('e.expected', 'expected').replace('r.verdict', 'verdict')} from joined group by 1
          union all
          select run, 'group', grp, {_SCORE.replace('e.expected', 'expected').replace('r.verdict', 'verdict')} from joined group by 1, 3)
        select run, scope, grp, cast(total as bigint) total, cast(correct as bigint) correct, cast(wrong as bigint) wrong,
          cast(skipped as bigint) skipped, round(case when total > 0 then 100.0 * correct / total else 0.0 end, 6) accuracy
        from cards where scope = 'all' or total > 0"""


_OLD_CHUNKS = f"""
{BLOCKS}, {BODY}, {SECTIONS}, {CHUNKS},
hosted_chunks as (
  select standard_id kb, chunk_id, start_idx, content, contains(title, ',') gone,
    last_value(case when not contains(title, ',') then chunk_id end ignore nulls) over (partition by standard_id order by start_idx) host from chunks),
new_chunks as (
  select kb, host chunk_id, min(start_idx) start_idx, string_agg(content, {NL} order by start_idx) content
  from hosted_chunks where host is not null and (not gone or length(kb) = 4) group by 1, 2),
old_chunks as (select standard_id kb, chunk_id, start_idx, content,
    list_filter(list_transform(string_split(content, {NL}), lambda x: {strip('x')}), lambda x: length(x) >= 20) probes from chunks),
lost as (select kb, chunk_id, start_idx, probes, case when len(probes) > 1 then list_slice(probes, 2, 4) else list_slice(probes, 1, 3) end proof
  from old_chunks anti join new_chunks using (kb, chunk_id)),
hosted as (
  select l.kb, l.chunk_id, proof, arg_max(n.chunk_id, n.start_idx) host_id, arg_max(n.content, n.start_idx) host_text
  from lost l left join new_chunks n on n.kb = l.kb and n.start_idx <= l.start_idx group by 1, 2, 3),
remapped as (
  select kb, chunk_id, host_id, case when host_id is null then 'no_host'
    when len(proof) > 0 and len(list_filter(proof, lambda p: not contains(host_text, p))) = 0 then 'ok' else 'not_verified' end status
  from hosted)
"""

def _letters(text: str) -> str:
    return "[" + ", ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


_METHODS = f"""
{BLOCKS}, {RAW_CELLS}, {VARIANT_ROWS},
own_words as (select table_id, {_letters("coalesce(t, '')")} q from variant_base),
method_docs as (select method, table_id, {_letters('document')} e from variants),
near as (
  select method, query_id, table_id, row_number() over (partition by method, query_id order by distance, table_id) rank from (
    select d.method, w.table_id query_id, d.table_id,
      list_sum(list_transform(range(1, 27), lambda i: ((q[i] - e[i]) * (q[i] - e[i]))::double)) distance
    from method_docs d, own_words w)),
method_ranks as (
  select method, w.table_id query_id, n.rank from (select distinct method from variants) m cross join own_words w
  left join near n using (method) where n.query_id = w.table_id and n.table_id = w.table_id)
"""

ORACLES = {
    "label_scenarios": """select doc_id item_no, case when length(text) % 3 = 0 then 'chunk_p1_idx' || doc_id else 'T' || source end as label,
        case when length(text) % 2 = 0 then 'Section ' || lang else 'T' || source end grp from documents""",
    "read_scenarios": """select doc_id::int item_no, case when length(text) % 3 = 0 then 'chunk_p1_idx' || doc_id else 'T' || source end as label,
        case when length(text) % 2 = 0 then 'Section ' || lang else 'T' || source end grp, length(text) n_chars from documents""",
    "lexical_gold_rank": f"with {_LEXICAL} select kb, query_id, label, grp, rank from found",
    "gold_rank": f"with {_SCEN} select kb, query_id, label, grp, rank_chunk rank, 'chunk' as mode from gold_ranks union all select kb, query_id, label, grp, rank_page, 'page' from gold_ranks",
    "retrieval_metrics": f"""with {_LEXICAL} select 'all' as scope, null grp, {_METRICS} from found
        union all select 'group', grp, {_METRICS} from found group by grp""",
    "eval_suite": f"with {_SCEN}, {_SUITE} select * from suite",
    "regression_guard": f"""with {_SCEN}, {_SUITE}, base as (select run, hr3 + case run when 'exact' then 0.03 when 'page' then -0.02 else 0.0 end hr3 from suite)
        select run, round(b.hr3, 6) as before, round(s.hr3, 6) as now, run in ('exact', 'page') guarded,
          case when run in ('exact', 'page') then case when s.hr3 + 0.01 + 1e-9 < b.hr3 then 'regression' else 'ok' end
            when s.hr3 > b.hr3 + 1e-9 then 'up' when s.hr3 + 1e-9 < b.hr3 then 'down' else 'same' end status
        from suite s join base b using (run)""",
    "regression_history": f"""with {_SCEN}, {_SUITE}, bases as (
          select run, against, hr3 + change hr3 from suite, (values ('before day 3', -0.04), ('release', 0.0), ('release before day 3', 0.05)) c(against, change))
        select against, run, round(b.hr3, 6) as before, round(s.hr3, 6) as now, run in ('exact', 'page') guarded,
          case when run in ('exact', 'page') then case when s.hr3 + 0.01 + 1e-9 < b.hr3 then 'regression' else 'ok' end
            when s.hr3 > b.hr3 + 1e-9 then 'up' when s.hr3 + 1e-9 < b.hr3 then 'down' else 'same' end status
        from suite s join bases b using (run)""",
    "verdict_scorecard": _card("exclude"),
    "verdict_scorecard_strict": _card("wrong"),
    "verdict_errors": f"""with {RUNS}, {_EXPECTED} select run, item_no, grp, expected, predicted from (
          select model run, item_no, e.grp, e.expected, verdict predicted, row_number() over (partition by model order by item_no) rn
          from runs r join expected_items e using (item_no) where verdict <> e.expected) where rn <= 10""",
    "verdict_confusion": f"""with {RUNS}, labels_of as (select distinct model, expected as label from runs union select distinct model, verdict from runs)
        select l.model run, l.label, count(*) filter (where expected = l.label and verdict = l.label) tp,
          count(*) filter (where expected = l.label and verdict <> l.label) fn,
          count(*) filter (where verdict = l.label and expected <> l.label) fp
        from labels_of l join runs r on r.model = l.model group by 1, 2""",
    "class_recall": f"""with {RUNS}, wanted as (select unnest(['COMPLIANT', 'NON_COMPLIANT', 'UNSEEN']) as label)
        select m.model run, w.label, round(coalesce(100.0 * avg(case when verdict = expected then 1.0 else 0.0 end) filter (where expected = w.label), 0.0), 6) recall
        from model_list m cross join wanted w join runs r on r.model = m.model group by 1, 2""",
    "model_ladder": f"""with {RUNS} select m.model, m.provider, cast(m.params_b as double) params_b, count(*) n,
          round(100.0 * avg(case when verdict = expected then 1.0 else 0.0 end), 6) accuracy,
          round(100.0 * avg(case when verdict = expected then 1.0 else 0.0 end) filter (where expected = 'COMPLIANT'), 6) recall_compliant,
          round(100.0 * avg(case when verdict = expected then 1.0 else 0.0 end) filter (where expected = 'NON_COMPLIANT'), 6) recall_violation,
          round(avg(elapsed_s), 6) avg_s
        from model_list m join runs r using (model) group by 1, 2, 3""",
    "accuracy_by_group": f"""with {RUNS} select grp, {', '.join(f"round(coalesce(100.0 * avg(case when verdict = expected then 1.0 else 0.0 end) filter (where model = '{m}'), 0.0), 6) {m}" for m in ('small', 'medium', 'large'))}
        from runs group by 1""",
    "verdicts_by_model": f"""with {RUNS} select verdict, {', '.join(f"count(*) filter (where model = '{m}') {m}" for m in ('small', 'medium', 'large'))} from runs group by 1""",
    "compare_runs": f"""with {RUNS}, {_OLD_NEW}, b as (
          select o.item_no io, n.item_no i_n, o.verdict ov, o.expected oe, n.verdict nv, n.expected ne
          from old_run o full join new_run n on o.item_no = n.item_no)
        select count(*) filter (where io is not null and i_n is not null) n_common,
          count(*) filter (where io is not null and i_n is not null and ov <> 'NOT_EVALUATED') old_n,
          count(*) filter (where io is not null and i_n is not null and ov = oe) old_correct,
          count(*) filter (where io is not null and i_n is not null and nv <> 'NOT_EVALUATED') new_n,
          count(*) filter (where io is not null and i_n is not null and nv = ne) new_correct,
          count(*) filter (where nv <> 'NOT_EVALUATED') new_all_n, count(*) filter (where nv = ne) new_all_correct,
          count(*) filter (where io is not null and ov <> oe and nv = ne) n_fixed, count(*) filter (where ov = oe and nv <> ne) n_broken
        from b""",
    "changed_items": f"""with {RUNS}, {_OLD_NEW} select item_no, case when n.verdict = n.expected then 'fixed' else 'broken' end change
        from old_run o join new_run n using (item_no) where (o.verdict = o.expected) <> (n.verdict = n.expected)""",
    "missing_gold": f"with {_OLD_CHUNKS} select kb, chunk_id from lost",
    "remap_gold": f"with {_OLD_CHUNKS} select kb, chunk_id, host_id, status from remapped",
    "apply_remap": f"""with {_OLD_CHUNKS}, f as (select kb, count(*) filter (where status <> 'ok') failed from remapped group by 1)
        select o.kb, o.chunk_id old_id, case when failed = 0 and host_id is not null then host_id else o.chunk_id end chunk_id
        from old_chunks o left join remapped r using (kb, chunk_id) left join f using (kb)""",
    "failure_attribution": f"""with {chain(5)}, gold_tables as (
          select q.kb, q.query_id, 'Table ' || (d.n_chars % 150) gold_table, length(q.text) n from kb_queries q join documents d on d.doc_id = q.query_id),
        flags as (
          select query_id, exists (select 1 from final f join kb using (kb, doc_id) where f.kb = g.kb and f.query_id = g.query_id and f.type = 'table' and kb.table_name = gold_table) evidence_found,
            n % 3 <> 0 correct from gold_tables g)
        select evidence_found, correct, count(*) n, case when correct then 'correct' when not correct and evidence_found then 'model_wrong'
          when not correct and not evidence_found then 'evidence_missing' else 'all' end cause
        from flags group by cube (evidence_found, correct)""",
    "latency_profile": f"""with {RUNS} select model, count(*) n, round(avg(elapsed_s), 6) avg_s, round(sum(elapsed_s), 6) total_s,
          round(median(elapsed_s), 6) median_s from runs group by 1""",
    "stage_latency": """with s as (select unnest(['chunk', 'index', 'total']) stage, unnest([round(n_chars / 700.0, 2), round(n_chars / 300.0, 2), round(n_chars / 150.0, 2)]) x from documents)
        select stage, count(*) n, round(avg(x), 6) avg_s, round(sum(x), 6) total_s, round(median(x), 6) median_s from s group by 1""",
    "serialization_ablation": f"""with {_METHODS}, scored as (select method, {_METRICS} from method_ranks group by 1)
        select *, row_number() over (order by hr3 desc, mrr desc, method) = 1 is_best from scored""",
}
