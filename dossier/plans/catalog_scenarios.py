"""Scenario-generation and streaming queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions.lineage import checkpoint_folder
from dossier.operators import scenarios as sc
from dossier.plans import inputs
from dossier.streaming.audit_stream import stream_call_rate


def matrix_claims(spark, sf):
    return sc.matrix_claims(inputs.cells(spark, sf, "status"))


def _limits(spark, sf):
    """Order counts as limits: every kind of rule over all tables."""
    counts = inputs.order_counts(spark, sf)
    c = F.col("c").cast("string")
    kinds = ["max_count", "min_distance", "min_clearance", "max_length", "factor", "threshold"]
    key = F.replace("rl", F.lit("."), F.lit("")).cast("int")
    limit = (
        F.when(key % 4 == 0, F.concat(F.lit("> "), c, F.lit(",5 m"))).when(key % 4 == 1, F.concat(c, F.lit(".000 m")))
        .when(key % 4 == 2, F.concat(F.lit("> "), c, F.lit(".25"))).otherwise(F.when(F.col("c") % 2 == 0, F.concat(c, F.lit(" m"))).otherwise("none"))
    )
    size = (
        F.when(key % 3 == 0, F.concat(c, F.lit(".1- "), c, F.lit("0"))).when(key % 3 == 1, F.concat(c, F.lit(",5'den az")))
        .otherwise(F.concat(F.lit("1.00"), c))
    )
    return counts.select(
        "table_id", (key * 10 + F.col("p").cast("int")).alias("row_idx"), F.concat(F.lit("item "), "rl").alias("subject"),
        size.alias("range_text"), limit.alias("limit_text"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"),
    )


def threshold_claims(spark, sf):
    claims = sc.threshold_claims(_limits(spark, sf))
    return claims.select("table_id", "row_idx", "kind", F.round("measure", 6).alias("measure"), F.round("value", 6).alias("value"), "expected", "text")


REGIMES = ["alpha", "beta", "gamma", "delta", "epsilon"]


def _titles(spark, sf):
    """A table per nation of customers' order months (groups) with titles in five regimes."""
    return inputs.cells(spark, sf, "status").withColumn(
        "text",
        F.when(F.col("col_idx") == 0, F.col("text")).when(F.col("text") == "Qualified", F.concat(F.lit("t  "), F.col("col_idx").cast("string"), F.lit("&#1;")))
        .when(F.col("text") == "Note 1", "Nil (x)").otherwise(F.col("text")),
    )


def equivalence_pairs(spark, sf):
    return sc.equivalence_pairs(sc.equivalence_rows(_titles(spark, sf), REGIMES), 100)


def balanced_sample(spark, sf):
    return sc.balanced_sample(matrix_claims(spark, sf), 25).select("table_id", "text", "expected")


def bridging_claims(spark, sf):
    """Each two neighbouring columns are a table of their own: qualification and bridging of its tasks."""
    pair = F.explode(F.sequence(F.lit(1), F.lit(len(REGIMES) - 1))).alias("pair")
    cells = inputs.cells(spark, sf, "status").select("*", pair).filter("col_idx = 0 or col_idx - pair in (0, 1)")
    return sc.bridging_claims(cells.select(
        F.concat_ws("/", "table_id", "pair").alias("table_id"), "row_idx",
        F.when(F.col("col_idx") == 0, 0).otherwise(F.col("col_idx") - F.col("pair") + 1).alias("col_idx"), "text",
    ))


def stream_calls(spark, sf):
    """The sliding call counts of the whole event file, run as a stream until it is used up.

    Every micro-batch adds a small file of changed counters; the last state of each is read.
    """
    root = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    calls = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("provider"))
    counted = stream_call_rate(calls, "2 hours", "6 hours", "2 hours")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/{batch_id}")

    query = (
        counted.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out")
    return out.groupBy("window_start", "provider").agg(F.max_by("n_calls", "batch").alias("n_calls")).select(
        F.unix_seconds("window_start").alias("window_start_s"), "provider", "n_calls"
    )


QUERIES = {
    f.__name__: f
    for f in (matrix_claims, threshold_claims, equivalence_pairs, balanced_sample, bridging_claims)
}
QUERIES["stream_call_rate"] = stream_calls
