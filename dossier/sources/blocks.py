"""Parsed page blocks from shard files, and shard files that cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_level", T.IntegerType()),
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("list_items", _STRINGS),
    T.StructField("table_body", T.StringType()),
    T.StructField("table_caption", _STRINGS),
    T.StructField("table_footnote", _STRINGS),
    T.StructField("img_path", T.StringType()),
])
# Where parsers put the list of blocks.
_LIST_PATHS = ("$", "$.content_list", "$.data.content_list")
PATTERN = "pages_*_content_list.json"


def _field(block: Column, name: str, kind: T.DataType) -> Column:
    """A field of a block whatever its shape has drifted to: numbers as text, a lone string for a list of one."""
    value = F.try_variant_get(block, f"$.{name}", kind.simpleString())
    if isinstance(kind, T.ArrayType):
        lone = F.try_variant_get(block, f"$.{name}", "string")
        # A list that is no list of strings is told by its bracket: it stays out, a plain text becomes a list of one.
        value = F.coalesce(value, F.when(~F.startswith(lone, F.lit("[")) & ~F.startswith(lone, F.lit("{")), F.array(lone)))
    return value.alias(name)


def read_shards(spark: SparkSession, path: str, pattern: str = PATTERN, folders: bool = False, ranges: bool = True) -> DataFrame:
    """standard_id, shard, file, first_page, blocks, reason of every shard file below `path`.

    reason is null for a good shard; else it says what is wrong with the file (then blocks is null): `not JSON` (also a
    file that ends too early or isn't UTF-8), `no list of blocks`, `block without fields`; or, with `ranges`, `pages missing
    before`, where the page numbers in file names leave a gap to the shard before (Spark skips empty files: only this tells
    them). With `folders` each shard file has a folder of its own below its standard's, and these are ordered by their names.
    """
    place = r"([^/]+)/[^/]+/[^/]+$" if folders else r"([^/]+)/[^/]+$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(
        F.regexp_extract("path", place, 1).alias("standard_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$" if folders else r"([^/]+)$", 1).alias("shard"),
        F.col("path").alias("file"), F.try_parse_json(F.try_validate_utf8(F.col("content").cast("string"))).alias("v"),
    )
    found = files.withColumn("list", F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in _LIST_PATHS]))
    fields = F.exists("list", lambda x: F.schema_of_variant(x).startswith("OBJECT") == F.lit(False))
    reason = (
        F.when(F.col("v").isNull(), "not JSON").when(F.col("list").isNull(), "no list of blocks")
        .when(F.coalesce(fields, F.lit(False)), "block without fields")
    )
    read = found.withColumn("reason", reason).select(
        "standard_id", "shard", "file", "reason",
        F.when(F.col("reason").isNull(), F.transform("list", lambda x: F.struct(*[_field(x, f.name, f.dataType) for f in BLOCK.fields]))).alias("blocks"),
    )
    first, last = (F.regexp_extract("shard", r"^pages_(\d+)-(\d+)", g).try_cast("int") for g in (1, 2))
    read = read.withColumn("first_page", F.coalesce(first - 1, F.lit(0)))
    if not ranges:
        return read
    # One narrow row for each file is ordered: their blocks stay where they are.
    order = Window.partitionBy("standard_id").orderBy("shard")
    gaps = read.select("standard_id", "shard", first.alias("a"), F.lag(last, 1, 0).over(order).alias("z")).filter("a > z + 1")
    gaps = gaps.select("standard_id", "shard", F.lit("pages missing before").alias("gap"))
    return read.join(gaps, ["standard_id", "shard"], "left").withColumn("reason", F.coalesce("reason", "gap")).drop("gap")


def bad_shards(shards: DataFrame) -> DataFrame:
    """standard_id, shard, file, reason of the files that keep their standards from being read."""
    return shards.filter(F.col("reason").isNotNull()).select("standard_id", "shard", "file", "reason")


def placed_blocks(shards: DataFrame, on_bad: str = "fail") -> DataFrame:
    """Blocks of `read_shards` in document order.

    A shard file is one bounded row (some tens of pages) and becomes its blocks in place. The position of a block is its
    place in the shard plus the sizes of the shards before it: only one (standard, shard, size) row per file is ever
    ordered, never the blocks. A bad shard would shift all blocks behind it, so its standard is never read in part:
    `fail` ends the job with the name of the file, `leave_out` leaves out all of the standard (see `bad_shards`).
    """
    if on_bad not in ("fail", "leave_out"):
        raise ValueError(f"on_bad is fail or leave_out, not {on_bad}")
    by_standard = Window.partitionBy("standard_id")
    before = by_standard.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.raise_error(F.concat(F.lit("shard "), F.col("file"), F.lit(": "), F.col("reason"))).cast("int")
    n = F.size("blocks")
    size = F.when(F.col("reason").isNotNull(), stop).otherwise(n) if on_bad == "fail" else n
    sizes = shards.select("standard_id", "shard", size.alias("n"), F.col("reason").isNotNull().alias("bad"))
    starts = sizes.select(
        "standard_id", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.max("bad").over(by_standard).alias("bad")
    ).filter(~F.col("bad"))
    return shards.join(starts, ["standard_id", "shard"]).select(
        "standard_id", "start", "first_page", F.posexplode_outer("blocks").alias("pos", "b")
    ).filter(F.col("pos").isNotNull()).select(
        "standard_id",
        (F.col("start") + F.col("pos")).cast("long").alias("block_idx"),
        (F.col("b.page_idx") + F.col("first_page")).alias("page_idx"),
        *[F.col(f"b.{f.name}") for f in BLOCK.fields if f.name != "page_idx"],
    )


def read_blocks(
    spark: SparkSession, path: str, pattern: str = PATTERN, folders: bool = False, on_bad: str = "fail", ranges: bool = True
) -> DataFrame:
    """Blocks of every standard below `path` (one folder per standard) in document order; see `read_shards`, `placed_blocks`."""
    return placed_blocks(read_shards(spark, path, pattern, folders, ranges), on_bad)
