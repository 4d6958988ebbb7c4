"""Audit queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.config import AuditConfig, RetrievalConfig
from dossier.functions.lineage import checkpoint_folder, cut
from dossier.operators import audit as au
from dossier.operators import retrieval as rt
from dossier.plans import inputs
from dossier.plans.retrieve import attach_evidence, retrieve
from dossier.sources.kb import export_audit as write_audit
from dossier.sources.stored_results import read_verdicts, store_verdicts

# Requests carry the whole context. `audit_requests_cut` checks the cut that a model with a short context needs.
SHORT = AuditConfig(context_char_cap=3000)
PROMPT = "check the rules"


def _items(spark, sf):
    return inputs.passages(spark, sf).select("kb", "query_id", "text")


def _matches(spark, sf):
    docs = inputs.written_kb(spark, sf)
    return attach_evidence(retrieve(inputs.kb_queries(spark, sf), docs, inputs.nearness_scorer, RetrievalConfig()), docs)


def _requests(spark, sf, cfg=AuditConfig()):
    return au.audit_requests(_items(spark, sf), rt.format_context(_matches(spark, sf)), cfg)


def audit_requests(spark, sf):
    return _requests(spark, sf).select("kb", "query_id", "was_cut", "request")


def audit_requests_cut(spark, sf):
    return _requests(spark, sf, SHORT).select("kb", "query_id", "was_cut", "request")


def request_stats(spark, sf):
    return au.request_stats(_requests(spark, sf)).withColumn("avg_chars", F.round("avg_chars", 6))


def _replies(spark, sf):
    runs = inputs.verdict_runs(spark, sf)
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("item_no"), "n_chars")
    given = F.concat(F.lit("Verdict : "), F.lower("verdict"), F.lit("\nREASONING: source "), F.col("grp"), F.lit("\n end "))
    none = F.when(F.col("n_chars") % 2 == 0, "  ").otherwise(" no idea ")
    return runs.join(docs, "item_no").withColumn(
        "reply", F.when(F.col("verdict") == "NOT_EVALUATED", none).otherwise(given)
    ).drop("verdict")


def parse_responses(spark, sf):
    return au.parse_responses(_replies(spark, sf)).select("model", "item_no", "verdict", "reasoning")


def verdict_counts(spark, sf):
    return au.verdict_counts(au.parse_responses(_replies(spark, sf)), "model")


def reuse_verdicts(spark, sf):
    each_model = F.explode(F.array(*[F.lit(m) for m, _, _, _ in inputs.MODELS]))
    requests = _requests(spark, sf).withColumn("model", each_model)
    prompt = au.prompt_hash(PROMPT)
    n = F.length("text") % 3
    requests = cut(requests)
    keyed = requests.filter(F.substring("text", 1, 1) < "N").select(
        au.cache_key(F.col("model"), prompt, F.col("text"), F.coalesce("context", F.lit(""))).alias("cache_key"),
        F.when(n == 0, "COMPLIANT").when(n == 1, "NON_COMPLIANT").otherwise("NOT_EVALUATED").alias("verdict"),
        F.lit("stored").alias("reasoning"),
    ).distinct()
    return au.reuse_verdicts(requests, keyed, prompt).select("model", "kb", "query_id", "cache_key", "verdict", "cached")


def verdict_store(spark, sf):
    """Two runs of the same requests: replies are stored, later ones win, errors never count; what is left to ask."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/verdicts-{uuid.uuid4().hex}"
    each_model = F.explode(F.array(*[F.lit(m) for m, _, _, _ in inputs.MODELS]))
    prompt = au.prompt_hash(PROMPT)
    requests = cut(_requests(spark, sf).withColumn("model", each_model))
    key = au.cache_key(F.col("model"), prompt, F.col("text"), F.coalesce("context", F.lit("")))
    n = F.length("text")
    verdict = F.when(n % 3 == 0, "COMPLIANT").when(n % 3 == 1, "NON_COMPLIANT").otherwise("NOT_EVALUATED")
    replies = requests.select(key.alias("cache_key"), verdict.alias("verdict"), F.lit("first").alias("reasoning"), F.timestamp_seconds(F.lit(1000)).alias("stored_at"), "text")
    later = replies.filter(F.substring("text", 1, 1) < "N").withColumns({
        "verdict": F.when(F.length("text") % 2 == 0, "COMPLIANT").otherwise("NOT_EVALUATED"), "reasoning": F.lit("second"),
        "stored_at": F.timestamp_seconds(F.lit(2000)),
    })
    for run in (later, replies, later):  # out of order, and one merge twice
        store_verdicts(run.drop("text"), path)
    reused = au.reuse_verdicts(requests, read_verdicts(spark, path), prompt)
    to_do = au.requests_to_do(reused).select("model", "kb", "query_id").withColumn("to_do", F.lit(True))
    return reused.join(to_do, ["model", "kb", "query_id"], "left").select(
        "model", "kb", "query_id", "cache_key", "verdict", "reasoning", F.coalesce("to_do", F.lit(False)).alias("to_do")
    )


def _results(spark, sf):
    n = F.length("text")
    items = _items(spark, sf)
    matches = cut(_matches(spark, sf)).join(items.filter(~F.contains("text", F.lit("\n"))).select("kb", "query_id"), ["kb", "query_id"], "left_semi")
    replied = items.filter(F.substring("text", 1, 1) < "N").select(
        "kb", "query_id", F.when(n % 2 == 0, "COMPLIANT").otherwise("NON_COMPLIANT").alias("verdict"), F.lit("because").alias("reasoning")
    )
    return au.audit_results(items, matches, rt.format_context(matches), replied)


def _listed(results):
    shown = F.transform("sources", lambda s: F.concat_ws("@", s["name"], s["page_idx"].cast("string")))
    return results.select("kb", "query_id", "verdict", "reasoning", F.array_join(shown, "|").alias("sources"))


def audit_results(spark, sf):
    return _listed(_results(spark, sf))


def export_audit(spark, sf):
    """Results written as JSON lines and read back."""
    results, path = _results(spark, sf), f"{checkpoint_folder(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    write_audit(results, path)
    return _listed(spark.read.schema(results.schema).json(path))


def audit_summary(spark, sf):
    out = au.audit_summary(inputs.verdict_runs(spark, sf), "model")
    return out.withColumns({c: F.round(c, 6) for c in ("pct_compliant", "pct_violation", "pct_not_evaluated")})


def call_rate_breaches(spark, sf):
    calls = inputs.table(spark, sf, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("provider"), "ts")
    out = au.call_rate_breaches(calls, AuditConfig(window_seconds=7200))
    return out.select("call_id", "provider", F.round("wait_s", 6).alias("wait_s"))


QUERIES = {
    f.__name__: f
    for f in (audit_requests, audit_requests_cut, request_stats, parse_responses, verdict_counts, reuse_verdicts, verdict_store, audit_results, export_audit,
              audit_summary, call_rate_breaches)
}
