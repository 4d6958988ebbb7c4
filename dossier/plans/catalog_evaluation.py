"""Evaluation queries over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from dossier.config import RetrievalConfig
from dossier.functions.lineage import checkpoint_folder, cut
from dossier.functions.scan import Running, running_values
from dossier.functions.text import word_tokens
from dossier.operators import evaluate as ev
from dossier.operators import index as ix
from dossier.operators import retrieval as rt
from dossier.operators import tables as tb
from dossier.operators import text as tx
from dossier.operators import vectors as vx
from dossier.plans import inputs
from dossier.plans.catalog_tables import variant_tables
from dossier.plans.retrieve import attach_evidence, retrieve
from dossier.sources.scenarios import label_scenarios as with_labels
from dossier.sources.scenarios import read_scenarios as scenario_files
from dossier.sources.stored_results import baseline, record_metrics

K5 = RetrievalConfig(top_k=5)
NAMES = [m for m, _, _, _ in inputs.MODELS]


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _scenario_rows(spark, sf):
    n = F.length("text")
    return inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_no"), "text",
        F.concat(F.lit("T"), "source").alias("table"),
        F.when(n % 2 == 0, F.concat(F.lit("Section "), "lang")).otherwise("").alias("section"),
        F.when(n % 3 == 0, F.concat(F.lit("chunk_p1_idx"), F.col("doc_id").cast("string"))).alias("chunk_id"),
    )


def label_scenarios(spark, sf):
    return with_labels(_scenario_rows(spark, sf).drop("text")).select("item_no", "label", "grp")


def read_scenarios(spark, sf):
    """The same scenarios written as JSON lists of up to fifty, item numbers of some as text, and read back."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/scenarios-{uuid.uuid4().hex}"
    number = F.col("item_no").cast("string")
    one = F.struct(F.when(F.col("item_no") % 2 == 0, F.concat(F.lit("0"), number)).otherwise(number).alias("item_no"), "text", "table", "section", "chunk_id")
    lists = _scenario_rows(spark, sf).groupBy(F.expr("item_no div 50").alias("no")).agg(F.to_json(F.collect_list(one)).alias("value"))
    lists.repartition("no").write.partitionBy("no").text(path)
    read = scenario_files(spark, path, "*.txt")
    return read.select("item_no", "label", "grp", F.length("text").alias("n_chars"))


def _lexical_ranks(spark, sf):
    """Rank of every document that contains a passage verbatim; passages in no document are left out.

    Verbatim containment is found through the index: a document can only contain a passage if
    it holds the passage's rarest word, so no passage is compared with every document.
    """
    docs, asked = inputs.corpus(spark, sf), inputs.passages(spark, sf)
    index = ix.lexical_index(docs)
    top = rt.bm25_topk(asked, index, 10)
    words = asked.select("kb", "query_id", F.explode_outer(F.array_distinct(_inner_words(F.col("text")))).alias("token"))
    rarest = tx.first_per_key(
        words.join(index.terms.select("kb", "token", "df"), ["kb", "token"]), ["kb", "query_id"], [F.col("df"), F.col("token")]
    ).select("kb", "query_id", "token")
    near = index.postings.join(rarest, ["kb", "token"]).select("kb", "query_id", "doc_id")
    texts = docs.select("kb", "doc_id", F.col("source").alias("grp"), "document")
    gold = near.join(asked, ["kb", "query_id"]).join(texts, ["kb", "doc_id"]).filter(F.contains("document", F.col("text")))
    scen = cut(gold.select("kb", "query_id", "grp", F.concat(F.lit("chunk_p0_idx"), F.col("doc_id").cast("string")).alias("label")))
    matches = top.select(
        "kb", "query_id", F.lit("text_chunk").alias("type"), F.lit("").alias("table_name"), F.lit("").alias("display_name"),
        F.concat(F.lit("chunk_p0_idx"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit(0).alias("page_idx"),
        F.col("rank").alias("final_rank"),
    )
    return ev.gold_rank(matches, scen)


def _inner_words(c):
    """Words wholly inside a passage: the first and last may be cut in the middle of a word."""
    w = word_tokens(c)
    return F.when(F.size(w) > 2, F.slice(w, F.lit(2), F.size(w) - 2)).otherwise(w)


def lexical_gold_rank(spark, sf):
    return _lexical_ranks(spark, sf)


def retrieval_metrics(spark, sf):
    return _round(ev.retrieval_metrics(_lexical_ranks(spark, sf)), "hr1", "hr3", "hr5", "mrr")


def _scenarios(spark, sf):
    own = inputs.kb(spark, sf).select("kb", "doc_id", "type", "table_name", "chunk_id")
    asked = inputs.kb_queries(spark, sf).withColumn("doc_id", F.concat(F.lit("k"), F.lpad(F.col("query_id").cast("string"), 9, "0")))
    named = F.when(F.length("text") % 2 == 0, F.concat(F.lit("Rule "), "table_name")).otherwise(F.col("table_name"))
    return asked.join(own, ["kb", "doc_id"]).select(
        "kb", "query_id", F.when(F.col("type") == "table", named).otherwise(F.col("chunk_id")).alias("label"), F.lit("own").alias("grp")
    )


def _rules(scen):
    """One rule pair for each table label that starts with `Rule Table 1`."""
    labels = scen.filter(F.col("label").startswith("Rule Table 1")).select("label").distinct()
    none = lambda t: F.lit(None).cast(t)
    pair = F.array(
        F.struct(F.lit("Table 1").alias("starts_with"), none("string").alias("contains"), F.array(F.lit("11")).alias("excludes"),
                 none("string").alias("display_name"), none("int").alias("page_idx")),
        F.struct(none("string").alias("starts_with"), none("string").alias("contains"), none("array<string>").alias("excludes"),
                 none("string").alias("display_name"), F.lit(7).alias("page_idx")),
    )
    return labels.select("label", F.inline(pair))


def _matches5(spark, sf):
    docs = inputs.written_kb(spark, sf)
    return attach_evidence(retrieve(inputs.kb_queries(spark, sf), docs, inputs.nearness_scorer, K5), docs)


def _both_modes(spark, sf):
    matches, scen = cut(_matches5(spark, sf).drop("content", "serialized", "html")), _scenarios(spark, sf)
    rules = _rules(scen)
    return {m: ev.gold_rank(matches, scen, m, rules) for m in ("chunk", "page")}


def gold_rank(spark, sf):
    both = _both_modes(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("mode", F.lit(m)) for m, df in both.items()])


def _suite(spark, sf):
    both = _both_modes(spark, sf)
    tag = lambda df, run, mode: df.withColumns({"run": F.lit(run), "match_mode": F.lit(mode)})
    loose = both["page"].withColumn("rank", F.when(F.col("rank") > 2, F.col("rank") - 1).otherwise(F.col("rank")))
    runs = tag(both["chunk"], "exact", "chunk").unionByName(tag(both["page"], "page", "page")).unionByName(tag(loose, "loose", "page"))
    return ev.eval_suite(runs)


def eval_suite(spark, sf):
    return _round(_suite(spark, sf), "hr1", "hr3", "hr5", "mrr")


def regression_guard(spark, sf):
    now = cut(eval_suite(spark, sf))
    shift = F.when(F.col("run") == "exact", 0.03).when(F.col("run") == "page", -0.02).otherwise(0.0)
    base = now.withColumn("hr3", F.col("hr3") + shift)
    return _round(ev.regression_guard(now, base, ["exact", "page"], 0.01), "before", "now")


def regression_history(spark, sf):
    """The suite against its log: the latest snapshot before a day, and the latest of a release."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    now = cut(eval_suite(spark, sf))
    day = lambda n: F.timestamp_seconds(F.lit(86_400 * n))
    for tag, taken, change in (("release", 1, 0.05), ("trial", 2, -0.04), ("release", 3, 0.0), ("trial", 5, 0.5)):
        record_metrics(now.withColumn("hr3", F.col("hr3") + change), path, tag, day(taken))
    choices = {"before day 3": {"before": day(3)}, "release": {"tag": "release"}, "release before day 3": {"before": day(3), "tag": "release"}, "none": {"before": day(1)}}
    guards = [
        ev.regression_guard(now, baseline(spark, path, **choice), ["exact", "page"], 0.01).withColumn("against", F.lit(name))
        for name, choice in choices.items()
    ]
    return _round(reduce(lambda a, b: a.unionByName(b), guards), "before", "now")


def _runs(spark, sf):
    return inputs.verdict_runs(spark, sf)


def _expected(spark, sf):
    labels = inputs.table(spark, sf, "labels").filter("toxic = 0")
    docs = inputs.table(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"))
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("item_no"), F.when(F.col("quality") == 1, "COMPLIANT").otherwise("NON_COMPLIANT").alias("expected"), "grp"
    )


def _results(spark, sf):
    return _runs(spark, sf).select(F.col("model").alias("run"), "item_no", "verdict")


def verdict_scorecard(spark, sf):
    return _round(ev.verdict_scorecard(_results(spark, sf), _expected(spark, sf), "exclude"), "accuracy")


def verdict_scorecard_strict(spark, sf):
    return _round(ev.verdict_scorecard(_results(spark, sf), _expected(spark, sf)), "accuracy")


def verdict_errors(spark, sf):
    return ev.verdict_errors(_results(spark, sf), _expected(spark, sf))


def verdict_confusion(spark, sf):
    return ev.verdict_confusion(_runs(spark, sf).withColumnRenamed("model", "run"))


def class_recall(spark, sf):
    return _round(ev.class_recall(_runs(spark, sf).withColumnRenamed("model", "run"), ["COMPLIANT", "NON_COMPLIANT", "UNSEEN"]), "recall")


def model_ladder(spark, sf):
    out = ev.model_ladder(_runs(spark, sf), inputs.models(spark).drop("k"))
    return _round(out, "accuracy", "recall_compliant", "recall_violation", "avg_s")


def accuracy_by_group(spark, sf):
    return _round(ev.accuracy_by_group(_runs(spark, sf), NAMES), *NAMES)


def verdicts_by_model(spark, sf):
    return ev.verdicts_by_model(_runs(spark, sf), NAMES)


def _old_new(spark, sf):
    runs = _runs(spark, sf)
    return runs.filter("model = 'small'"), runs.filter("model = 'large' and grp <> 'src3'")


def compare_runs(spark, sf):
    return ev.compare_runs(*_old_new(spark, sf))


def changed_items(spark, sf):
    return ev.changed_items(*_old_new(spark, sf))


def _chunk_versions(spark, sf):
    """Chunks, and a new version without those whose title has a comma.

    In bases with a name of four letters their text moved to the chunk before them, in the
    others it is gone: labels are found again, not verified, or without a host.
    """
    chunks = tx.section_chunks(inputs.blocks(spark, sf)).withColumnRenamed("standard_id", "kb")
    chunks = cut(chunks.select("kb", "chunk_id", "title", "content", "start_idx"))
    stays = ~F.contains("title", F.lit(","))
    hosted = running_values(chunks, ["kb"], "start_idx", [Running("host", "last", F.when(stays, F.col("chunk_id")))])
    moved = hosted.filter(stays | (F.length("kb") == 4)).filter(F.col("host").isNotNull())
    texts = F.sort_array(F.collect_list(F.struct("start_idx", "content")))
    new = moved.groupBy("kb", F.col("host").alias("chunk_id")).agg(F.array_join(F.transform(texts, lambda x: x["content"]), "\n").alias("content"))
    return chunks, cut(new)


def missing_gold(spark, sf):
    return ev.missing_gold(*_chunk_versions(spark, sf))


def remap_gold(spark, sf):
    old, new = _chunk_versions(spark, sf)
    return ev.remap_gold(old.select("kb", "chunk_id"), old, new)


def apply_remap(spark, sf):
    old, new = _chunk_versions(spark, sf)
    remap = cut(ev.remap_gold(old.select("kb", "chunk_id"), old, new))
    return ev.apply_remap(old.select("kb", "chunk_id", F.col("chunk_id").alias("old_id")), remap)


def failure_attribution(spark, sf):
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "n_chars")
    n = F.length("text")
    results = inputs.kb_queries(spark, sf).join(docs, "query_id").select(
        "kb", "query_id", F.concat(F.lit("Table "), (F.col("n_chars") % 150).cast("string")).alias("gold_table"),
        F.when(n % 3 != 0, "COMPLIANT").otherwise("NON_COMPLIANT").alias("verdict"), F.lit("COMPLIANT").alias("expected"),
    )
    return ev.failure_attribution(_matches5(spark, sf), results)


def latency_profile(spark, sf):
    return _round(ev.latency_profile(_runs(spark, sf)), "avg_s", "total_s", "median_s")


def stage_latency(spark, sf):
    n = F.col("n_chars")
    meta = inputs.table(spark, sf, "documents").select(
        F.create_map(F.lit("chunk"), n / 700.0, F.lit("index"), n / 300.0, F.lit("total"), n / 150.0).alias("timings")
    )
    return _round(ev.stage_latency(meta), "avg_s", "total_s", "median_s")


def _letter_counts(c):
    """A deterministic stand-in encoder: similar texts have similar counts."""
    return F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("float") for x in "abcdefghijklmnopqrstuvwxyz"])


def _ablation(spark, sf, keep):
    """Which text of a table is found best by the table's own words: each method is a base of all tables."""
    tables = variant_tables(spark, sf)
    variants = tb.serialization_variants(tables).filter(keep)
    # written as vectors: texts are longer, and would be counted again by each reader
    docs = cut(variants.select(F.col("method").alias("kb"), F.col("table_id").alias("doc_id"), _letter_counts(F.col("document")).alias("embedding")))
    words = tables.select("table_id", _letter_counts(tb.stripped_html(F.col("html"))).alias("embedding"))
    asked = docs.select("kb", F.col("doc_id").alias("table_id")).join(words, "table_id")
    ranks = vx.own_ranks(asked.select("kb", F.col("table_id").alias("query_id"), F.col("table_id").alias("own"), "embedding"), docs)
    return _round(ev.serialization_ablation(ranks.withColumnRenamed("kb", "method")), "hr1", "hr3", "hr5", "mrr")


def serialization_ablation(spark, sf):
    """The five texts that SQL can make, by ranks however far down."""
    return _ablation(spark, sf, "method <> 'E'")


def serialization_ablation_full(spark, sf):
    """All six texts, the serializer's own (E) among them."""
    return _ablation(spark, sf, "true")


QUERIES = {
    f.__name__: f
    for f in (label_scenarios, read_scenarios, lexical_gold_rank, gold_rank, retrieval_metrics, eval_suite, regression_guard, regression_history, verdict_scorecard,
              verdict_scorecard_strict, verdict_errors, verdict_confusion, class_recall, model_ladder, accuracy_by_group,
              verdicts_by_model, compare_runs, changed_items, missing_gold, remap_gold, apply_remap, failure_attribution,
              latency_profile, stage_latency, serialization_ablation, serialization_ablation_full)
}
