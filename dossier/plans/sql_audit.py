"""Independent SQL for audit queries (DuckDB dialect), used only to check results."""

from __future__ import annotations

from dossier.plans.sql_retrieval import chain
from dossier.plans.sql_text import NL, strip

# The same stand-in replies as inputs.verdict_runs / catalog_audit.
RUNS = """
model_list as (select * from (values ('small', 3, 3.0, 'local'), ('medium', 5, 17.0, 'cloud'), ('large', 9, 120.0, 'cloud'))
  m(model, k, params_b, provider)),
runs as (
  select m.model, l.doc_id item_no, d.source grp, d.text,
    case when quality = 1 then 'COMPLIANT' else 'NON_COMPLIANT' end expected,
    case when n_chars % 17 = 0 then 'NOT_EVALUATED'
      when n_chars % m.k = 0 then case when quality = 1 then 'NON_COMPLIANT' else 'COMPLIANT' end
      else case when quality = 1 then 'COMPLIANT' else 'NON_COMPLIANT' end end verdict,
    (n_chars % 1000) / 100.0 elapsed_s, d.n_chars
  from labels l join documents d using (doc_id) cross join model_list m)
"""

_REPLIES = f"""
replies as (
  select model, item_no, grp, verdict,
    case when verdict = 'NOT_EVALUATED' and n_chars % 2 = 0 then '  ' when verdict = 'NOT_EVALUATED' then ' no idea '
      else 'Verdict : ' || lower(verdict) || {NL} || 'REASONING: source ' || grp || {NL} || ' end ' end reply
  from runs)
"""

def _requests(cap: int | None) -> str:
    """Whole contexts, or cut to `cap` characters."""
    shown, was_cut = "context", "false"
    if cap:
        shown = f"case when length(context) > {cap} then substr(context, 1, {cap}) || {NL} || '…[truncated]' else context end"
        was_cut = f"coalesce(length(context) > {cap}, false)"
    return f"""
requests as (
  select kb, query_id, text, {shown} context, {was_cut} was_cut from passages left join evidence e using (kb, query_id))
"""


_REQUESTS = _requests(None)

_CACHED = """
call_keys as (
  select m.model, r.kb, r.query_id, sha256(m.model || chr(0) || left(sha256('check the rules'), 12) || chr(0) || r.text || chr(0) || coalesce(context, '')) cache_key,
    context, length(r.text) n, substr(r.text, 1, 1) < 'N' early
  from requests r cross join model_list m),
stored as (
  select cache_key, case when n % 3 = 0 then 'COMPLIANT' when n % 3 = 1 then 'NON_COMPLIANT' else 'NOT_EVALUATED' end verdict
  from call_keys where early)
"""

ORACLES = {
    "audit_requests": f"""with {chain()}, {_REQUESTS}
        select kb, query_id, was_cut, 'ITEM: ' || text || {NL} || {NL} || 'CONTEXT:' || {NL} || context request from requests""",
    "audit_requests_cut": f"""with {chain()}, {_requests(3000)}
        select kb, query_id, was_cut, 'ITEM: ' || text || {NL} || {NL} || 'CONTEXT:' || {NL} || context request from requests""",
    "request_stats": f"""with {chain()}, {_REQUESTS}, texts as (
          select was_cut, 'ITEM: ' || text || {NL} || {NL} || 'CONTEXT:' || {NL} || context request from requests)
        select count(*) n_items, count(request) n_requests, cast(sum(was_cut::int) as bigint) n_cut,
          round(avg(length(request)), 6) avg_chars, max(length(request)) max_chars from texts""",
    "parse_responses": f"""with {RUNS}, {_REPLIES}
        select model, item_no, verdict, case when {strip('reply')} = '' then 'The model gave an empty reply.'
          when verdict = 'NOT_EVALUATED' then 'no idea' else 'source ' || grp || {NL} || ' end' end reasoning from replies""",
    "verdict_counts": f"with {RUNS} select model, verdict, count(*) n from runs group by 1, 2",
    "reuse_verdicts": f"""with {RUNS}, {chain()}, {_REQUESTS}, {_CACHED}
        select k.model, kb, query_id, k.cache_key, s.verdict, s.verdict is not null cached
        from call_keys k left join (select distinct * from stored where verdict <> 'NOT_EVALUATED') s using (cache_key)""",
    "verdict_store": f"""with {RUNS}, {chain()}, {_REQUESTS}, {_CACHED}, kept as (
          select *, early and n % 2 = 0 as second, n % 3 < 2 as first from call_keys)
        select model, kb, query_id, cache_key,
          case when second then 'COMPLIANT' when n % 3 = 0 then 'COMPLIANT' when first then 'NON_COMPLIANT' end verdict,
          case when second then 'second' when first then 'first' end reasoning, not second and not first and context is not null as to_do from kept""",
    "audit_results": f"""with {chain()}, picked as (
          select f.*, case when f.type = 'table' then table_name else title end source, kb.page_idx
          from final f join kb using (kb, doc_id) join passages p using (kb, query_id) where not contains(p.text, chr(10))),
        listed as (select kb, query_id, string_agg(source || '@' || page_idx, '|' order by final_rank) sources from picked group by 1, 2)
        select kb, query_id, case when sources is null or substr(text, 1, 1) >= 'N' then 'NOT_EVALUATED'
            when length(text) % 2 = 0 then 'COMPLIANT' else 'NON_COMPLIANT' end verdict,
          case when sources is null then 'No related rule was found in the knowledge base.'
            when substr(text, 1, 1) >= 'N' then 'The model gave an empty reply.' else 'because' end reasoning,
          coalesce(sources, '') sources
        from passages left join listed using (kb, query_id)""",
    "audit_summary": f"""with {RUNS}, c as (
          select model, count(*) n_items, count(*) filter (where verdict = 'COMPLIANT') n_compliant,
            count(*) filter (where verdict = 'NON_COMPLIANT') n_violation, count(*) filter (where verdict = 'NOT_EVALUATED') n_not_evaluated
          from runs group by 1)
        select *, cast(round_even(100.0 * n_compliant / (n_compliant + n_violation), 0) as double) compliance_rate,
          round(100.0 * n_compliant / n_items, 6) pct_compliant, round(100.0 * n_violation / n_items, 6) pct_violation,
          round(100.0 * n_not_evaluated / n_items, 6) pct_not_evaluated, n_not_evaluated > 0 degraded from c""",
    "call_rate_breaches": """with timed as (
          select event_id call_id, event_type provider, epoch_us(ts) us,
            lag(epoch_us(ts), 5) over (partition by event_type order by ts, event_id) before from events)
        select call_id, provider, round(7200.0 - (us - before) / 1000000.0 + 0.5, 6) wait_s from timed where us - before <= 7200000000""",
}

ORACLES["export_audit"] = ORACLES["audit_results"]
