"""Versions of stored knowledge bases: staged batch by batch, switched at once when they are whole.

Below a root: `manifest` (kb, version, n_docs: how many documents a version has when it is whole), `docs` (documents in
folders by base, version, type and batch) and `current` (kb, version: one row for each switch, the highest version counts).
A batch writes its own folders only, so a repeated batch replaces itself. A version becomes current with one row in one new
file, after its documents are there in full: readers see the whole old or the whole new version, whatever fails between.
Versions grow with each refresh; old folders stay until the store's owner removes them, so running readers keep theirs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dossier.functions.sizes import broadcast_if, is_small, written_side

MANIFEST = "kb string, version long, n_docs long"
CURRENT = "kb string, version long"
FOLDERS = ["kb", "version", "type", "batch"]


def announce(manifest: DataFrame, root: str) -> None:
    """Add (kb, version, n_docs) of versions to come, before or after their documents."""
    manifest.selectExpr("kb", "cast(version as long) version", "cast(n_docs as long) n_docs").coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Stored rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _documents(spark: SparkSession, root: str) -> DataFrame:
    """All staged documents. Spark guesses the types of folder names; a base may be called 007."""
    names = {"kb": "string", "version": "bigint", "type": "string", "batch": "bigint"}
    guessed = spark.read.parquet(f"{root}/docs").schema
    schema = ", ".join(f"`{f.name}` {names.get(f.name, f.dataType.simpleString())}" for f in guessed)
    return spark.read.schema(schema).parquet(f"{root}/docs")


def stage(batch: DataFrame, root: str, batch_id: int) -> None:
    """Write documents (kb, version, type, ...) of one batch to folders of their own; a repeated batch replaces them."""
    docs = batch.withColumns({"version": F.col("version").cast("long"), "batch": F.lit(batch_id).cast("long")})
    docs.hint("rebalance", *FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(f"{root}/docs")


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    """kb, version of the version that readers get."""
    return _read(spark, f"{root}/current", CURRENT).groupBy("kb").agg(F.max("version").alias("version"))


def publish(spark: SparkSession, root: str) -> DataFrame:
    """Make whole versions current, those above a base's current one; returns kb, version of the switched bases.

    Only folder names are read of the documents. All bases that are whole now switch with the same file.
    """
    expected = _read(spark, f"{root}/manifest", MANIFEST).groupBy("kb", "version").agg(F.max("n_docs").alias("n_docs"))
    now = current_versions(spark, root).withColumnRenamed("version", "now")
    open_ = written_side(expected.join(now, "kb", "left").filter(F.col("now").isNull() | (F.col("version") > F.col("now"))))
    staged = _documents(spark, root).select("kb", "version").join(open_.select("kb", "version"), ["kb", "version"], "left_semi")
    counts = staged.groupBy("kb", "version").agg(F.count(F.lit(1)).alias("n"))
    whole = open_.join(counts, ["kb", "version"], "left").filter(F.coalesce("n", F.lit(0)) == F.col("n_docs"))
    switched = written_side(whole.groupBy("kb").agg(F.max("version").alias("version")))
    if switched.limit(1).count():
        switched.coalesce(1).write.mode("append").parquet(f"{root}/current")
    return switched


def read_current(spark: SparkSession, root: str, kb: str | None = None, type_: str | None = None) -> DataFrame:
    """Documents of the current versions; folders of other versions, bases and types are not read."""
    docs, now = _documents(spark, root), current_versions(spark, root)
    if kb is not None:
        docs, now = docs.filter(F.col("kb") == kb), now.filter(F.col("kb") == kb)
    if type_ is not None:
        docs = docs.filter(F.col("type") == type_)
    # Spark prunes folders by a side that it broadcasts and that has a filter; this one keeps every row.
    return docs.join(broadcast_if(is_small(now), now.filter(F.col("version") >= -(1 << 62))), ["kb", "version"], "left_semi").drop("batch")


def stream_staged_refresh(docs: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Stage a stream of documents (kb, version, type, ...) and switch bases as they become whole."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        stage(batch, root, batch_id)
        publish(batch.sparkSession, root)

    return docs.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
