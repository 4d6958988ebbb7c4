"""Queries that let the given tables arrive in steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions.lineage import checkpoint_folder, cut
from dossier.plans import inputs
from dossier.sources import kb_versions as kv
from dossier.streaming import report_items as ri


def _folder(spark, name):
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_numbered_items(spark, sf):
    """Items of all reports, whose lines arrive in three parts: the stream starts anew for each, its state goes on."""
    root = _folder(spark, "reports")
    part = F.pmod(F.xxhash64("report_id"), F.lit(3)) + F.col("line_no") / 700_000  # a report's lines come in order, split anywhere
    lines = cut(inputs.report_lines(spark, sf).select(
        F.col("report_id").cast("string").alias("report_id"), "line_no", "line",
        F.when(part < 3, 0).when(part < 6, 1).otherwise(2).alias("step"),
    ))
    end = spark.range(1).select(F.lit("").alias("report_id"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line"), F.lit(1000).alias("step"))
    for step in (0, 1, 2, 1000):  # the last has one line of a later day: all reports before it are done
        arrived = lines.unionByName(end).filter(F.col("step") == step)
        arrived.select("report_id", "line_no", "line", F.timestamp_seconds(F.col("step") * 300 + 1).alias("ts")).write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema(ri.LINE_SCHEMA).json(f"{root}/in")
        with ri.rocksdb_state(spark):
            query = (
                ri.stream_report_items(stream, lateness="10 seconds", idle="1 hour").writeStream.outputMode("append").format("parquet")
                .option("path", f"{root}/items").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            )
        query.awaitTermination()
    items = spark.read.schema("report_id string, item_line long, item_no int, text string").parquet(f"{root}/items")
    return items.withColumn("report_id", F.col("report_id").cast("long"))


def staged_kb_refresh(spark, sf):
    """Three bases, refreshed in batches: one whole in two batches (the second repeated), one short of a part, one not at all."""
    root = _folder(spark, "bases")
    docs = cut(inputs.kb(spark, sf).select("kb", "doc_id", "type", "document"))
    size = docs.groupBy("kb").agg(F.count(F.lit(1)).alias("n_docs"))
    kv.announce(size.withColumn("version", F.lit(1)), root)
    kv.announce(size.withColumn("version", F.lit(2)), root)
    kv.stage(docs.withColumn("version", F.lit(1)), root, 0)
    kv.publish(spark, root)
    again = docs.filter("kb in ('kb0', 'kb1')").withColumns({"version": F.lit(2), "document": F.reverse("document")})
    odd = F.pmod(F.substring("doc_id", 2, 9).cast("long"), F.lit(2)) == 1
    kv.stage(again.filter(~odd), root, 1)
    kv.publish(spark, root)
    for _ in range(2):
        kv.stage(again.filter(odd & (F.col("kb") == "kb0")), root, 2)
        kv.publish(spark, root)
    return kv.read_current(spark, root).select("kb", "doc_id", "type", "version", "document")


QUERIES = {f.__name__: f for f in (stream_numbered_items, staged_kb_refresh)}
