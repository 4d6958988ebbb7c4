"""Evaluation of retrieval and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.config import SPAN_ROWS, AuditConfig
from dossier.functions.scan import Running, running_values
from dossier.functions.text import split_lines, strip
from dossier.operators.text import first_per_key

EPS = 1e-9
RULE_SCHEMA = (
    "label string, starts_with string, contains string, excludes array<string>, display_name string, page_idx int"
)
_CHUNK_PAGE = r"^chunk_p(\d+)_idx"


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


# --- retrieval -------------------------------------------------------------------------


def gold_rank(matches: DataFrame, scenarios: DataFrame, mode: str = "chunk", rules: DataFrame | None = None) -> DataFrame:
    """Rank of the first hit of each scenario inside the gold label's own modality.

    `matches`: kb, query_id, type, table_name, display_name, chunk_id, page_idx, final_rank.
    `scenarios`: kb, query_id, label, grp (kb may be missing in both: one base). `rules` (RULE_SCHEMA): any row of a label whose given
    conditions all hold is a hit; a label without rules is a name prefix. A scenario without a
    hit has a null rank.
    """
    label = F.col("label")
    query = [c for c in ("kb", "query_id") if c in scenarios.columns]
    is_chunk = label.startswith("chunk_")
    typed = scenarios.withColumn("type", F.when(is_chunk, "text_chunk").otherwise("table"))
    rows = matches.join(typed.select(*query, "label", "type"), [*query, "type"])
    w = Window.partitionBy(*query, "label").orderBy("final_rank")
    rows = rows.withColumn("rank", F.row_number().over(w))
    if mode == "page":
        chunk_hit = F.regexp_extract(label, _CHUNK_PAGE, 1).try_cast("int") == F.col("page_idx")
    else:
        chunk_hit = F.col("chunk_id") == label
    table_hit = F.col("table_name").startswith(label)
    if rules is not None:
        # A rule list is written by hand: its size does not follow the data.
        given = rules.select("label", F.struct(*[c for c in rules.columns if c != "label"]).alias("r"))
        grouped = given.groupBy("label").agg(F.collect_list("r").alias("rules"))
        rows = rows.join(grouped, "label", "left")
        name = F.col("table_name")
        yes = F.lit(True)

        def holds(r: Column) -> Column:
            return (
                F.when(r["starts_with"].isNotNull(), name.startswith(r["starts_with"])).otherwise(yes)
                & F.when(r["contains"].isNotNull(), F.contains(name, r["contains"])).otherwise(yes)
                & F.when(r["excludes"].isNotNull(), ~F.exists(r["excludes"], lambda x: F.contains(name, x))).otherwise(yes)
                & F.when(r["display_name"].isNotNull(), F.col("display_name") == r["display_name"]).otherwise(yes)
                & F.when(r["page_idx"].isNotNull(), F.col("page_idx") == r["page_idx"]).otherwise(yes)
            )

        table_hit = F.when(F.col("rules").isNotNull(), F.exists("rules", holds)).otherwise(table_hit)
    hit = F.when(is_chunk, chunk_hit).otherwise(table_hit)
    first = rows.groupBy(*query, "label").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))
    return scenarios.join(first, [*query, "label"], "left").select(*query, "label", "grp", "rank")


def _metric_columns(ks: Sequence[int]) -> list[Column]:
    return [
        *[F.avg(_flag(F.col("rank") <= k).cast("double")).alias(f"hr{k}") for k in ks],
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.count(F.lit(1)).alias("n"),
    ]


def retrieval_metrics(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Hit rates, MRR and n: one row over all (scope `all`) and one per group."""
    return (
        ranks.rollup("grp")
        .agg(*_metric_columns(ks), F.grouping("grp").alias("__all"))
        .withColumn("scope", F.when(F.col("__all") == 1, "all").otherwise("group"))
        .select("scope", "grp", *[f"hr{k}" for k in ks], "mrr", "n")
    )


def eval_suite(runs: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """The same metrics for several runs at once (`runs`: run, match_mode, query_id, rank)."""
    return runs.groupBy("run", "match_mode").agg(*_metric_columns(ks))


def regression_guard(
    current: DataFrame, base: DataFrame, guard_runs: Sequence[str], tolerance: float = 0.0, metric: str = "hr3"
) -> DataFrame:
    """Compare runs with a baseline: guard runs pass or fail, others are up, down or same."""
    both = current.select("run", F.col(metric).alias("now")).join(
        base.select("run", F.col(metric).alias("before")), "run"
    )
    guarded = F.col("run").isin(*guard_runs)
    failed = F.col("now") + tolerance + EPS < F.col("before")
    status = (
        F.when(guarded & failed, "regression")
        .when(guarded, "ok")
        .when(F.col("now") > F.col("before") + EPS, "up")
        .when(F.col("now") + EPS < F.col("before"), "down")
        .otherwise("same")
    )
    return both.select("run", "before", "now", guarded.alias("guarded"), status.alias("status"))


def guard_passes(guard: DataFrame) -> DataFrame:
    """One row: whether every guard run passed."""
    return guard.agg(F.coalesce(F.bool_and(F.col("status") != "regression"), F.lit(True)).alias("passed"))


# --- verdicts --------------------------------------------------------------------------


def _policy(results: DataFrame, error_policy: str, cfg: AuditConfig) -> DataFrame:
    """`wrong` counts error states as wrong, `exclude` leaves them out of the metrics."""
    if error_policy == "wrong":
        return results
    return results.filter(F.col("verdict") != cfg.error)


def verdict_scorecard(
    results: DataFrame, expected: DataFrame, error_policy: str = "wrong", cfg: AuditConfig = AuditConfig()
) -> DataFrame:
    """Correct, wrong, accuracy per run: overall and by group; items without a label are skipped.

    `results`: run, item_no, verdict. `expected`: item_no, expected, grp.
    """
    joined = _policy(results, error_policy, cfg).join(
        expected.select("item_no", "expected", "grp"), "item_no", "left"
    )
    known = F.col("expected").isNotNull()
    right = _flag(F.col("verdict") == F.col("expected"))
    groups = F.when(known, F.col("grp"))
    return (
        joined.withColumn("grp", groups)
        .groupingSets([["run"], ["run", "grp"]], "run", "grp")
        .agg(
            F.grouping("grp").alias("__all"),
            F.sum(F.when(known, 1).otherwise(0)).alias("total"),
            F.sum(F.when(known, right).otherwise(0)).alias("correct"),
            F.sum(F.when(known, 1 - right).otherwise(0)).alias("wrong"),
            F.sum(F.when(known, 0).otherwise(1)).alias("skipped"),
        )
        .filter((F.col("__all") == 1) | (F.col("total") > 0))
        .select(
            "run",
            F.when(F.col("__all") == 1, "all").otherwise("group").alias("scope"),
            "grp", "total", "correct", "wrong", "skipped",
            F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"),
        )
    )


def verdict_errors(results: DataFrame, expected: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` wrong items of each run (a report list)."""
    wrong = results.join(expected, "item_no").filter(F.col("verdict") != F.col("expected"))
    return first_per_key(
        wrong.select("run", "item_no", "grp", "expected", F.col("verdict").alias("predicted")), ["run"], [F.col("item_no")], n
    )


def verdict_confusion(results: DataFrame) -> DataFrame:
    """True positives, misses and false alarms of every label (`results`: run, expected, verdict)."""
    cells = results.groupBy("run", "expected", "verdict").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("expected") == F.col("verdict")
    sides = cells.select(
        "run",
        F.explode(F.array(
            F.struct(F.col("expected").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                     F.when(same, 0).otherwise(F.col("n")).alias("fn"), F.lit(0).cast("long").alias("fp")),
            F.struct(F.col("verdict").alias("label"), F.lit(0).cast("long").alias("tp"),
                     F.lit(0).cast("long").alias("fn"), F.when(same, 0).otherwise(F.col("n")).alias("fp")),
        )).alias("s"),
    )
    return sides.groupBy("run", F.col("s.label").alias("label")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.fn").alias("fn"), F.sum("s.fp").alias("fp")
    ).filter("tp + fn + fp > 0")


def class_recall(results: DataFrame, labels: Sequence[str] = AuditConfig().verdicts) -> DataFrame:
    """Share (%) of each expected label that was found; 0 where the label is absent."""
    right = _flag(F.col("verdict") == F.col("expected")).cast("double")
    found = results.groupBy("run", F.col("expected").alias("label")).agg((100.0 * F.avg(right)).alias("recall"))
    names = F.explode(F.array(*[F.lit(v) for v in labels])).alias("label")
    return results.select("run").distinct().select("run", names).join(found, ["run", "label"], "left").fillna(
        0.0, ["recall"]
    )


def model_ladder(results: DataFrame, models: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Accuracy, recall per label and latency of every model, smallest model first.

    `results`: model, expected, verdict, elapsed_s. `models`: model, params_b, provider.
    """
    right = _flag(F.col("verdict") == F.col("expected")).cast("double")
    recall = lambda v: 100.0 * F.coalesce(F.avg(F.when(F.col("expected") == v, right)), F.lit(0.0))
    scored = results.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.avg(right)).alias("accuracy"),
        recall(cfg.compliant).alias("recall_compliant"),
        recall(cfg.violation).alias("recall_violation"),
        F.avg("elapsed_s").alias("avg_s"),
    )
    return models.join(scored, "model").orderBy("params_b", "model")


def accuracy_by_group(results: DataFrame, model_names: Sequence[str]) -> DataFrame:
    """Group by model accuracy table (%)."""
    right = _flag(F.col("verdict") == F.col("expected")).cast("double")
    return results.groupBy("grp").pivot("model", list(model_names)).agg(100.0 * F.avg(right)).fillna(0.0)


def verdicts_by_model(results: DataFrame, model_names: Sequence[str]) -> DataFrame:
    """Verdict by model count table."""
    return results.groupBy("verdict").pivot("model", list(model_names)).agg(F.count(F.lit(1))).fillna(0)


def compare_runs(old: DataFrame, new: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """One row: accuracy of two runs over evaluated items, and how many items changed side.

    Both: item_no, verdict, expected.
    """
    name = lambda df, side: df.select(
        "item_no", F.col("verdict").alias(f"{side}_v"), F.col("expected").alias(f"{side}_e")
    )
    both = name(old, "o").join(name(new, "n"), "item_no", "full_outer")
    common = F.col("o_v").isNotNull() & F.col("n_v").isNotNull()
    done = lambda s: F.coalesce(F.col(f"{s}_v").isin(*cfg.verdicts), F.lit(False))
    right = lambda s: F.coalesce(F.col(f"{s}_v") == F.col(f"{s}_e"), F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(
        count(common).alias("n_common"),
        count(common & done("o")).alias("old_n"),
        count(common & done("o") & right("o")).alias("old_correct"),
        count(common & done("n")).alias("new_n"),
        count(common & done("n") & right("n")).alias("new_correct"),
        count(done("n")).alias("new_all_n"),
        count(done("n") & right("n")).alias("new_all_correct"),
        count(common & ~right("o") & right("n")).alias("n_fixed"),
        count(common & right("o") & ~right("n")).alias("n_broken"),
    )


def changed_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items that were fixed or broken between two runs, one row each."""
    both = old.select("item_no", (F.col("verdict") == F.col("expected")).alias("was")).join(
        new.select("item_no", (F.col("verdict") == F.col("expected")).alias("now")), "item_no"
    )
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return both.filter(was != now).select("item_no", F.when(now, "fixed").otherwise("broken").alias("change"))


# --- gold labels -----------------------------------------------------------------------


def missing_gold(scenarios: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold chunk ids that no longer exist."""
    gold = scenarios.filter(F.length(F.coalesce("chunk_id", F.lit(""))) > 0).select("kb", "chunk_id").distinct()
    return gold.join(chunks.select("kb", "chunk_id"), ["kb", "chunk_id"], "left_anti")


def _start(chunk_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(chunk_id, r"idx(\d+)$", 1).try_cast("long"), F.lit(-1).cast("long"))


def remap_gold(scenarios: DataFrame, old: DataFrame, new: DataFrame, span: int = SPAN_ROWS) -> DataFrame:
    """Where each lost gold chunk went: the new chunk that covers its start, if its text is there.

    All inputs have kb and chunk_id, chunks also content. Result: kb, chunk_id, host_id, status
    (`ok`, `not_in_old`, `no_host`, `not_verified`). The host is found by one ordered pass over
    new starts and lost starts, not by comparing them pairwise.
    """
    lost = missing_gold(scenarios, new)
    marks = new.select("kb", _start(F.col("chunk_id")).alias("idx"), F.col("chunk_id").alias("host"), F.lit(None).cast("string").alias("lost_id"))
    asked = lost.select("kb", _start(F.col("chunk_id")).alias("idx"), F.lit(None).cast("string").alias("host"), F.col("chunk_id").alias("lost_id"))
    # at one position a new start comes before the question asked there
    line = marks.unionByName(asked).withColumn("pos", F.col("idx") * 2 + F.when(F.col("lost_id").isNull(), 0).otherwise(1))
    found = running_values(line, ["kb"], "pos", [Running("host_id", "last", F.col("host"))], span)
    hosts = found.filter(F.col("lost_id").isNotNull()).select("kb", F.col("lost_id").alias("chunk_id"), "host_id")
    probes = F.filter(F.transform(split_lines(F.col("content")), strip), lambda ln: F.length(ln) >= 20)
    proof = F.when(F.size(probes) > 1, F.slice(probes, F.lit(2), F.lit(3))).otherwise(F.slice(probes, 1, 3))
    checked = hosts.join(
        old.select("kb", "chunk_id", proof.alias("proof")), ["kb", "chunk_id"], "left"
    ).join(
        new.select("kb", F.col("chunk_id").alias("host_id"), F.col("content").alias("host_text")), ["kb", "host_id"], "left"
    )
    there = (F.size("proof") > 0) & F.forall("proof", lambda p: F.contains(F.col("host_text"), p))
    status = (
        F.when(F.col("proof").isNull(), "not_in_old")
        .when(F.col("host_id").isNull(), "no_host")
        .when(there, "ok")
        .otherwise("not_verified")
    )
    return checked.select("kb", "chunk_id", "host_id", status.alias("status"))


def apply_remap(scenarios: DataFrame, remap: DataFrame) -> DataFrame:
    """Scenarios with new gold ids; one label that could not be verified leaves its base unchanged."""
    failed = remap.groupBy("kb").agg(F.max(F.col("status") != "ok").alias("failed"))
    moves = remap.join(failed.filter(~F.col("failed")), "kb").select("kb", "chunk_id", "host_id")
    moved = scenarios.join(moves, ["kb", "chunk_id"], "left")
    return moved.withColumn("chunk_id", F.coalesce("host_id", "chunk_id")).select(*scenarios.columns)


# --- attribution, latency, ablation ----------------------------------------------------


def failure_attribution(matches: DataFrame, results: DataFrame) -> DataFrame:
    """Were wrong verdicts missing their evidence, or wrong with it? All margins included.

    `matches`: kb, query_id, type, table_name. `results`: kb, query_id, gold_table, verdict,
    expected (kb may be missing in both: one base).
    """
    query = [c for c in ("kb", "query_id") if c in results.columns]
    gold = results.select(*query, F.col("gold_table").alias("table_name"))
    seen = (
        matches.filter(F.col("type") == "table").join(gold, [*query, "table_name"], "left_semi")
        .select(*query).distinct().withColumn("__hit", F.lit(True))
    )
    flagged = results.join(seen, query, "left").select(
        F.coalesce("__hit", F.lit(False)).alias("evidence_found"),
        F.coalesce(F.col("verdict") == F.col("expected"), F.lit(False)).alias("correct"),
    )
    cause = (
        F.when(F.col("correct"), "correct")
        .when(~F.col("correct") & F.col("evidence_found"), "model_wrong")
        .when(~F.col("correct") & ~F.col("evidence_found"), "evidence_missing")
        .otherwise("all")
    )
    return flagged.cube("evidence_found", "correct").agg(F.count(F.lit(1)).alias("n")).withColumn("cause", cause)


def latency_profile(results: DataFrame, by: str = "model", seconds: str = "elapsed_s") -> DataFrame:
    """Average, total and exact median of seconds (kept to 1/100 s) for each model or stage.

    Equal values are counted before the median is taken, so its state grows with the number of
    different hundredths of a second, not with the rows.
    """
    rounded = results.select(by, F.round(seconds, 2).alias("s")).filter(F.col("s").isNotNull())
    counted = rounded.groupBy(by, "s").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy(by).agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("avg_s"),
        F.sum(F.col("s") * F.col("c")).alias("total_s"),
        F.percentile("s", 0.5, F.col("c")).alias("median_s"),
    )


def stage_latency(meta: DataFrame) -> DataFrame:
    """Latency profile of the build stages (`meta`: timings map<string,double>)."""
    return latency_profile(meta.select(F.explode("timings").alias("stage", "elapsed_s")), "stage")


def serialization_ablation(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Metrics of each table text method and which is best by HR@3 (`ranks`: method, rank)."""
    scored = ranks.groupBy("method").agg(*_metric_columns(ks))
    # one row per method (six): a plain window over the result is enough
    best = Window.orderBy(F.desc("hr3"), F.desc("mrr"), "method")
    return scored.withColumn("is_best", F.row_number().over(best) == 1)
