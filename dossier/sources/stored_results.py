"""Results that outlast a run: a store of verdicts by request key, a log of metric snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.config import AuditConfig
from dossier.functions.lineage import cut
from dossier.functions.sizes import written_side

VERDICTS = "cache_key string, verdict string, reasoning string, stored_at timestamp"
PREFIX_CHARS = 2  # of a key, which names its folder: 256 folders


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, verdict, reasoning, stored_at: one row per key, what `reuse_verdicts` takes as its cache."""
    return _stored(spark, path, VERDICTS + ", prefix string").drop("prefix")


def store_verdicts(replies: DataFrame, path: str, cfg: AuditConfig = AuditConfig()) -> None:
    """Merge replies (cache_key, verdict, reasoning, stored_at) into the store: the latest of a key wins.

    Error states are never stored, and don't displace a verdict. Of replies at the same time the last by verdict and
    reasoning stays, so a repeated merge changes nothing. Only folders of keys that arrive are read and replaced.
    """
    spark = replies.sparkSession
    prefix = F.substring("cache_key", 1, PREFIX_CHARS).alias("prefix")
    good = replies.filter((F.col("verdict") != cfg.error) & F.col("cache_key").isNotNull())
    new = cut(good.select("cache_key", "verdict", "reasoning", "stored_at", prefix))
    touched = written_side(new.select("prefix").distinct())  # at most 16 ** PREFIX_CHARS rows
    old = _stored(spark, path, VERDICTS + ", prefix string").join(touched, "prefix", "left_semi")
    latest = F.max(F.struct("stored_at", "verdict", "reasoning")).alias("last")
    merged = new.unionByName(old).groupBy("cache_key", "prefix").agg(latest)
    rows = cut(merged.select("cache_key", "last.verdict", "last.reasoning", "last.stored_at", "prefix"))
    # What is replaced has been read to its end: the merged rows are a table of their own by now.
    rows.hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


def record_metrics(metrics: DataFrame, path: str, tag: str, taken_at) -> None:
    """Add a snapshot of `eval_suite` rows to the log; `taken_at` is a datetime or a timestamp column."""
    at = taken_at if not hasattr(taken_at, "isoformat") else F.lit(taken_at)
    metrics.withColumns({"tag": F.lit(tag), "taken_at": at.cast("timestamp")}).coalesce(1).write.mode("append").parquet(path)


def baseline(spark: SparkSession, path: str, before=None, tag: str | None = None) -> DataFrame:
    """The latest snapshot, whole: of those taken before a time (exclusive), with a tag, or both. None fits: no rows.

    Of two snapshots taken at the same time the one with the greater tag counts.
    """
    log = spark.read.parquet(path)
    if before is not None:
        log = log.filter(F.col("taken_at") < (F.lit(before) if hasattr(before, "isoformat") else before))
    if tag is not None:
        log = log.filter(F.col("tag") == tag)
    last = log.agg(F.max(F.struct("taken_at", "tag")).alias("last")).select("last.taken_at", "last.tag")
    return log.join(F.broadcast(last), ["taken_at", "tag"])  # one row
