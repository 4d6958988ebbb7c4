"""Text queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions.lineage import checkpoint_folder
from dossier.operators import text as tx
from dossier.plans import inputs
from dossier.sources.blocks import BLOCK, placed_blocks, read_shards
from dossier.sources.blocks import read_blocks as shard_files


def _path(df):
    return df.withColumn("section_path", F.array_join("section_path", " > "))


def _write_shards(spark, sf, shape=None):
    """The blocks as shards of 20 pages, a numbered folder each in the folder of its standard.

    `shape` makes a file's text from standard_id, shard and value, the JSON list of its blocks.
    """
    folder = f"{checkpoint_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    names = [f.name for f in BLOCK.fields]
    shards = (
        inputs.blocks(spark, sf).withColumn("shard", F.expr("page_idx div 20"))
        .groupBy("standard_id", "shard")
        .agg(F.sort_array(F.collect_list(F.struct("block_idx", F.struct(*names).alias("b")))).alias("rows"))
    )
    values = shards.select("standard_id", "shard", F.to_json(F.transform("rows", lambda r: r["b"])).alias("value"))
    shaped = values if shape is None else values.withColumn("value", shape)
    spread = shaped.repartition("standard_id", "shard").withColumn("shard", F.format_string("%012d", "shard"))
    spread.write.partitionBy("standard_id", "shard").text(folder)
    return folder


def read_blocks(spark, sf):
    """Blocks written as shards and read back in order."""
    read = shard_files(spark, _write_shards(spark, sf), "*.txt", folders=True).withColumn("standard_id", F.substring_index("standard_id", "=", -1))
    return read.select("standard_id", "block_idx", "page_idx", "type", "text", "text_level", "table_body")


def _damaged_shards(spark, sf):
    """Shards of every shape: wrapped in two ways, cut off, without a list, with a block that has no fields."""
    kind = F.pmod(F.substring("standard_id", 4, 9).cast("int"), F.lit(5))
    first = F.col("shard") == 0
    value = F.col("value")
    shape = (
        F.when((kind == 0) & first, F.concat(F.lit('{"content_list":'), value, F.lit("}")))
        .when((kind == 0), F.concat(F.lit('{"data":{"content_list":'), value, F.lit("}}")))
        .when((kind == 1) & first, F.substr(value, F.lit(1), F.length(value) - 9))
        .when((kind == 2) & ~first, F.concat(F.lit('{"pages":'), value, F.lit("}")))
        .when((kind == 3) & first, F.lit('[{"type":"text","text":"a"},"lost"]'))
        .otherwise(value)
    )
    shards = read_shards(spark, _write_shards(spark, sf, shape), "*.txt", folders=True, ranges=False)
    return shards.withColumn("standard_id", F.substring_index("standard_id", "=", -1))


def shard_quarantine(spark, sf):
    """Every shard file: how many blocks it gives, or why it gives none, and whether its standard is read."""
    shards = _damaged_shards(spark, sf)
    whole = shards.groupBy("standard_id").agg((F.count("reason") == 0).alias("standard_read"))
    return shards.join(whole, "standard_id").select(
        "standard_id", F.substring_index("shard", "=", -1).cast("long").alias("shard"), F.when(F.col("reason").isNull(), F.size("blocks")).alias("n_blocks"),
        "reason", "standard_read",
    )


def read_whole_standards(spark, sf):
    """Blocks of the standards whose shards can all be read, numbered as if nothing had happened."""
    return placed_blocks(_damaged_shards(spark, sf), "leave_out").select("standard_id", "block_idx", "page_idx", "type", "text", "text_level", "table_body")


def block_text(spark, sf):
    return tx.block_text(inputs.blocks(spark, sf)).select("standard_id", "block_idx", "type", "content")


def repeated_lines(spark, sf):
    return tx.repeated_lines(inputs.blocks(spark, sf))


def strip_repeated_lines(spark, sf):
    b = inputs.blocks(spark, sf)
    return tx.strip_repeated_lines(b, tx.repeated_lines(b)).select("standard_id", "block_idx", "content")


def repeated_blocks(spark, sf):
    return tx.repeated_blocks(inputs.blocks(spark, sf))


def section_paths(spark, sf):
    return _path(tx.section_paths(inputs.blocks(spark, sf)))


def section_chunks(spark, sf):
    return _path(tx.section_chunks(inputs.blocks(spark, sf))).drop("start_idx", "type")


def pack_windows(spark, sf):
    chunks = tx.section_chunks(inputs.blocks(spark, sf))
    return tx.pack_windows(chunks, 400).select("standard_id", "chunk_id", "doc_id", "window_no", "window")


def _routed(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return tx.route_language(docs, sample_chars=None).drop("text")


def route_language(spark, sf):
    return _routed(spark, sf).select(
        "doc_id", "n_words", F.round("en_rate", 6).alias("en_rate"), F.round("tr_rate", 6).alias("tr_rate"), "tr_letters", "route"
    )


def route_counts(spark, sf):
    return tx.route_counts(_routed(spark, sf), "lang")


def numbered_items(spark, sf):
    return tx.numbered_items(inputs.report_lines(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (read_blocks, shard_quarantine, read_whole_standards, block_text, repeated_lines, strip_repeated_lines, repeated_blocks, section_paths, section_chunks,
              pack_windows, route_language, route_counts, numbered_items)
}
