"""Stored knowledge bases and audit results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.lineage import shuffles_let_go
from dossier.functions.text import safe_kb_name

TYPES = ["table", "text_chunk"]


def write_kb(docs: DataFrame, path: str) -> None:
    """Replace the documents of exactly the knowledge bases found in `docs`.

    Partitions (kb, type) present in the data are overwritten. A base that no longer has one
    of the types gets an empty marker row there, so nothing of its old version stays behind.
    Rebalancing splits a large base over many files and joins small ones; what it moves is let go of once the files are there.
    """
    kinds = F.explode(F.array(*[F.lit(t) for t in TYPES]))
    marks = docs.select("kb").distinct().select("kb", kinds.alias("type"))
    full = docs.unionByName(marks, allowMissingColumns=True)
    with shuffles_let_go(docs.sparkSession):
        (
            full.hint("rebalance", "kb", "type")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            .partitionBy("kb", "type").parquet(path)
        )


def read_kb(spark: SparkSession, path: str, type_: str | None = None, kb: str | None = None) -> DataFrame:
    """Stored documents; a filter on base or type reads only those folders."""
    docs = spark.read.parquet(path).filter(F.col("doc_id").isNotNull())
    if kb is not None:
        docs = docs.filter(F.col("kb") == kb)
    return docs if type_ is None else docs.filter(F.col("type") == type_)


def kb_catalog(docs: DataFrame) -> DataFrame:
    """One row per knowledge base: safe name and counts.

    Chunks are counted as different chunk ids, documents as index rows.
    """
    chunk = F.when(F.col("type") == "text_chunk", F.col("chunk_id"))
    return docs.groupBy("kb").agg(
        F.sum(F.when(F.col("type") == "table", 1).otherwise(0)).alias("tables"),
        F.countDistinct(chunk).alias("chunks"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("collection", F.when(F.length(safe_kb_name(F.col("kb"))) > 0, safe_kb_name(F.col("kb"))).otherwise("knowledge_base"))


def export_audit(results: DataFrame, path: str) -> None:
    """Audit results with their nested sources as JSON lines."""
    results.write.mode("overwrite").json(path)
