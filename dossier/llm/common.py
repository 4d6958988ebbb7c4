"""What several operators of this package share: reading, tables written once, Arrow tasks, words, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# The two word patterns of the contracts, as byte classes. Space and \x09-\x0D part plain words; for
# alphanumeric words everything in ASCII but digits and letters parts them. A-Z become a-z in both.
_UPPER = {b: b + 32 for b in range(65, 91)}
LOWER = bytes(_UPPER.get(b, b) for b in range(256))
ALNUM = bytes(
    _UPPER.get(b, b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one for this session where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read again: survives lost executors, ends the lineage.
    Rows are stored apart by the columns `by`."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fields(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], Iterable[dict[str, list]]]], rows: int = 512
) -> DataFrame:
    """mapInArrow with small column slices: `make()` runs once in each task and gives the function of a slice.

    The function takes {column: list of values} of at most `rows` rows and yields {column: list}, so that Python
    objects of a few rows exist at a time whatever the size of Arrow's batches.
    """
    target = to_arrow_schema(fields(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                given = {n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)}
                for out in step(given):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in target], schema=target
                    )
        for out in getattr(step, "rest", lambda: ())():
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def plain_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def learning_row(folds: int, held_out: int):
    """True where a doc_id is for learning: crc32 of its text is not `held_out` modulo `folds` (null ids never are)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out, F.lit(False))


def held_out_row(folds: int, held_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the links (a, b) of longs: node, comp (smallest node reachable).

    Alternates two steps until nothing changes: every larger neighbour of a node links to the smallest node around it;
    then every smaller neighbour does. Chains shrink by a power each time, a node's links stay linear, and no group
    meets in one task: minima are combined before the shuffle and joined back, where adaptive joins split hot nodes.
    Nodes without a link are left out. Each step is written to the shared folder.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(rounds):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo"), F.col("hi")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        links = cut(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo"))).distinct()
        )
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    )
