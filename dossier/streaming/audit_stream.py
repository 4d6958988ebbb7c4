"""Streams: report lines to evidence, call rates, refreshed knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.config import RetrievalConfig
from dossier.functions.lineage import cut
from dossier.operators.index import LexicalIndex
from dossier.operators.retrieval import Scorer
from dossier.operators.text import numbered_items
from dossier.plans.retrieve import retrieve
from dossier.sources.kb import write_kb

REPORT_LINE_SCHEMA = "report_id string, line_no long, line string"


def stream_call_rate(calls: DataFrame, lateness: str = "2 minutes", width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Calls per provider in sliding windows; calls later than `lateness` are dropped.

    State is one counter per open window and provider, partially aggregated before the shuffle.
    """
    return (
        calls.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width, slide), "provider")
        .agg(F.count(F.lit(1)).alias("n_calls"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "provider", "n_calls")
    )


def stream_audit_items(
    spark: SparkSession, lines_path: str, out_path: str, checkpoint: str, kb: DataFrame, encode, kb_name: str,
    scorer: Scorer | None = None, cfg: RetrievalConfig = RetrievalConfig(), index: LexicalIndex | None = None,
) -> StreamingQuery:
    """Evidence for the items of reports that arrive as JSON-lines files, one report per file.

    Ranking needs whole result lists, so every micro-batch runs the batch chain. Each batch
    writes its own folder: a repeated batch replaces itself. Pass a stored `index`: without one
    every batch indexes the whole base again.
    `encode`: DataFrame (.., text) -> the same with `embedding`.
    """

    def audit(batch: DataFrame, batch_id: int) -> None:
        items = numbered_items(batch)
        queries = cut(encode(items.select(
            F.lit(kb_name).alias("kb"),
            F.concat_ws("#", "report_id", F.col("item_line").cast("string")).alias("query_id"),
            "report_id", "item_no", "text",
        )))
        ranked = retrieve(queries, kb, scorer, cfg, index)
        ranked.join(queries.select("kb", "query_id", "report_id", "item_no"), ["kb", "query_id"]).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}"
        )

    return (
        spark.readStream.schema(REPORT_LINE_SCHEMA).json(lines_path)
        .writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_kb_refresh(docs: DataFrame, kb_path: str, checkpoint: str) -> StreamingQuery:
    """Replace the knowledge bases whose documents arrive; others are not touched.

    A micro-batch must hold whole bases. Overwriting by partition makes a repeated batch
    harmless.
    """
    return (
        docs.writeStream.foreachBatch(lambda batch, _: write_kb(batch, kb_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
