"""Audit of many items: requests, replies, reuse of verdicts, results, summaries, call pacing."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.config import AuditConfig
from dossier.functions.text import strip

QUERY = ["kb", "query_id"]
EMPTY_REPLY = "The model gave an empty reply."
NO_EVIDENCE = "No related rule was found in the knowledge base."


def audit_requests(items: DataFrame, context: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """One request per item; a context over `cfg.context_char_cap` (None: no limit) is cut and marked.

    `items`: kb, query_id, text. `context`: kb, query_id, context. Items without evidence keep a null
    request.
    """
    cap = cfg.context_char_cap
    if cap is None:
        long, shown = F.lit(False), F.col("context")
    else:
        long = F.length("context") > cap
        shown = F.when(long, F.concat(F.substring("context", 1, cap), F.lit(cfg.cut_marker))).otherwise(F.col("context"))
    return items.join(context.select(*QUERY, "context"), QUERY, "left").select(
        *QUERY,
        "text",
        shown.alias("context"),
        F.coalesce(long, F.lit(False)).alias("was_cut"),
        F.concat(F.lit("ITEM: "), F.col("text"), F.lit("\n\nCONTEXT:\n"), shown).alias("request"),
    )


def request_stats(requests: DataFrame) -> DataFrame:
    """Number and size of the requests."""
    return requests.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count("request").alias("n_requests"),
        F.sum(F.col("was_cut").cast("int")).alias("n_cut"),
        F.avg(F.length("request")).alias("avg_chars"),
        F.max(F.length("request")).alias("max_chars"),
    )


def parse_responses(
    responses: DataFrame, cfg: AuditConfig = AuditConfig(), unparsed: str | None = None
) -> DataFrame:
    """Verdict and reasoning of each reply; `unparsed` is the verdict of an unreadable one."""
    reply = F.coalesce("reply", F.lit(""))
    labels = "|".join(re.escape(v) for v in sorted(cfg.verdicts, key=len, reverse=True))
    found = F.upper(F.regexp_extract(reply, rf"(?iU)VERDICT\s*:\s*({labels})", 1))
    reason = strip(F.regexp_extract(reply, r"(?isU)REASONING\s*:\s*(.+)", 1))
    has_reason = reply.rlike(r"(?isU)REASONING\s*:\s*.+")
    blank = F.length(strip(reply)) == 0
    return responses.withColumns({
        "verdict": F.when(blank, cfg.error).when(found.isin(*cfg.verdicts), found).otherwise(unparsed or cfg.error),
        "reasoning": F.when(blank, EMPTY_REPLY).when(has_reason, reason).otherwise(strip(reply)),
    })


def verdict_counts(parsed: DataFrame, *by: str) -> DataFrame:
    return parsed.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))


def prompt_hash(prompt: str) -> str:
    """Short hash of the instruction text; a changed prompt makes old verdicts unusable."""
    return hashlib.sha256(prompt.encode("utf-8")).hexdigest()[:12]


def cache_key(label: Column, prompt_id: str, item: Column, context: Column) -> Column:
    zero = F.lit("\u0000")
    return F.sha2(F.concat(label, zero, F.lit(prompt_id), zero, item, zero, context), 256)


def reuse_verdicts(
    requests: DataFrame, cache: DataFrame, prompt_id: str, cfg: AuditConfig = AuditConfig()
) -> DataFrame:
    """Requests with the stored verdict where there is one (`cached`), else null.

    `requests`: model, kb, query_id, text, context. `cache`: cache_key, verdict, reasoning; error
    states are never taken from it.
    """
    keyed = requests.withColumn(
        "cache_key", cache_key(F.col("model"), prompt_id, F.col("text"), F.coalesce("context", F.lit("")))
    )
    usable = cache.filter(F.col("verdict") != cfg.error).select("cache_key", "verdict", "reasoning")
    return keyed.join(usable, "cache_key", "left").withColumn("cached", F.col("verdict").isNotNull())


def requests_to_do(reused: DataFrame) -> DataFrame:
    """Requests that still need a model call; items without evidence need none."""
    return reused.filter(~F.col("cached") & F.col("context").isNotNull())


def source_struct() -> Column:
    """What an auditor is shown of one piece of evidence."""
    table = F.col("type") == "table"
    only_table = lambda c: F.when(table, F.coalesce(F.col(c), F.lit(""))).otherwise(F.lit(""))
    return F.struct(
        F.when(table, F.col("table_name")).otherwise(F.coalesce("title", "chunk_id", F.lit("?"))).alias("name"),
        F.when(table, "table").otherwise("text_chunk").alias("type"),
        F.coalesce("page_idx", F.lit(-1)).alias("page_idx"),
        only_table("html").alias("html"),
        only_table("notes").alias("notes"),
        only_table("legend").alias("legend"),
        only_table("img_path").alias("img_path"),
    )


def audit_results(
    items: DataFrame, matches: DataFrame, contexts: DataFrame, verdicts: DataFrame, cfg: AuditConfig = AuditConfig()
) -> DataFrame:
    """Item, verdict, reasoning, ordered sources and context.

    An item without evidence, or without any reply, is in the error state. The sources of an
    item are its ranked evidence (at most 2k rows).
    """
    sources = (
        matches.select(*QUERY, "final_rank", source_struct().alias("s"))
        .groupBy(*QUERY)
        .agg(F.sort_array(F.collect_list(F.struct("final_rank", "s"))).alias("r"))
        .select(*QUERY, F.transform("r", lambda x: x["s"]).alias("sources"))
    )
    none = F.array().cast(sources.schema["sources"].dataType)
    seen = F.col("sources").isNotNull()
    return (
        items.join(sources, QUERY, "left")
        .join(contexts.select(*QUERY, "context"), QUERY, "left")
        .join(verdicts.select(*QUERY, "verdict", "reasoning"), QUERY, "left")
        .select(
            *[F.col(c) for c in items.columns],
            F.when(seen, F.coalesce("verdict", F.lit(cfg.error))).otherwise(cfg.error).alias("verdict"),
            F.when(seen, F.coalesce("reasoning", F.lit(EMPTY_REPLY))).otherwise(NO_EVIDENCE).alias("reasoning"),
            F.coalesce("sources", none).alias("sources"),
            F.coalesce("context", F.lit("")).alias("context"),
        )
    )


def audit_summary(results: DataFrame, *by: str, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Counts, compliance rate over evaluated items, shares over all, degraded flag."""
    n_of = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    counted = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        n_of(cfg.compliant).alias("n_compliant"),
        n_of(cfg.violation).alias("n_violation"),
        n_of(cfg.error).alias("n_not_evaluated"),
    )
    done = F.col("n_compliant") + F.col("n_violation")
    share = lambda c: F.when(F.col("n_items") > 0, 100.0 * F.col(c) / F.col("n_items")).otherwise(0.0)
    return counted.withColumns({
        "compliance_rate": F.when(done > 0, F.bround(100.0 * F.col("n_compliant") / done)).otherwise(0.0),
        "pct_compliant": share("n_compliant"),
        "pct_violation": share("n_violation"),
        "pct_not_evaluated": share("n_not_evaluated"),
        "degraded": F.col("n_not_evaluated") > 0,
    })


def call_rate_breaches(calls: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Calls made although their provider's window was full, and the wait that was due.

    `calls`: call_id, provider, ts. Time is cut into buckets of one window; each call is also
    shown to the next bucket, so a busy provider is spread over its buckets and every frame
    still sees the whole window before a call.
    """
    width = cfg.window_seconds * 1_000_000
    limit = cfg.calls_per_window
    if calls.schema["ts"].dataType.typeName() == "timestamp_ntz":
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        micros = F.unix_micros("ts")
    timed = calls.withColumn("us", micros).withColumn("own", F.floor(F.col("us") / width).cast("long"))
    shown = timed.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = Window.partitionBy("provider", "bucket").orderBy("us", "call_id")
    ahead = F.col("us") - F.lag("us", limit).over(w)
    return (
        shown.withColumn("gap_us", ahead)
        .filter((F.col("bucket") == F.col("own")) & (F.col("gap_us") <= width))
        .select(
            "call_id",
            "provider",
            "ts",
            (F.lit(float(cfg.window_seconds)) - F.col("gap_us") / 1e6 + cfg.wait_margin_seconds).alias("wait_s"),
        )
    )
