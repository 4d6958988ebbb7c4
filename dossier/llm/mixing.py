"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at three times
its source's size, and the excess goes to the others by weight. Point i of the golden-ratio sequence falls into the
cumulative targets and so names the source of slot i; the slots of a source are ranked. A source is one cyclic stream of
its documents in a shuffled order, cut into blocks of equal tokens: the slot of rank r takes block r, lap after lap, and
nothing after the third lap. How much a source gives is the number of points that fall to it, in blocks: the sequence's
low discrepancy keeps that within a few millionths of all words of the target. `first_slot` is the first slot that takes
from a document (null if none does).

No source meets in one task: ranks come from counts per chunk of slots, positions from counts per bucket of documents,
and slots meet documents by block. Null and empty texts have size 0 and take 0. Repeated rows are documents of their own.
A source of size 0 has target 0.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut, map_rows, plain_words, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
POINTS = 1_000_000  # of the schedule, about: a block holds a millionth of all words, and one word at least
CHUNK = 65_536  # slots ranked together
BUCKET_DOCS = 20_000  # documents placed together, about
CELLS = 4096  # of the unit interval, for the join of points and sources
GOLDEN = 0.6180339887498949  # Fixed value: the fractional part of the golden ratio


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every row; the key, an MD5 of id and text, shuffles."""

    def key(doc_id, text):
        digest = hashlib.md5(f"{'' if doc_id is None else doc_id}:".encode())
        digest.update((text or "").encode("utf-8", "surrogatepass"))
        return digest.hexdigest()

    def make():
        def step(given):
            keys = [key(i, t) for i, t in zip(given["doc_id"], given["text"])]
            yield {"doc_id": given["doc_id"], "source": given["source"], "key": keys, "size": [len(plain_words(t)) for t in given["text"]]}

        return step

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return map_rows(wanted, "doc_id long, source string, key string, size long", make, rows=128)


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: no, source, source_size, weight, target. Sources are the only rows gathered."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("no", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("no") % len(WEIGHTS)))
    cap = F.col("source_size") * float(MAX_REPEATS)
    # The level that caps and shares meet at: sources in order of cap by weight are capped while the rest's share is above.
    order = Window.orderBy(F.col("ratio"), F.col("no"))
    everything = Window.partitionBy()
    level = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = level.withColumn("share", left / open_weight).withColumn("free", F.col("ratio") >= F.col("share"))
    first_free = F.min(F.when(F.col("free"), F.struct("ratio", "no", "share"))).over(everything)["share"]
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(first_free, F.lit(float("inf"))))
    return level.withColumn("target", target).select("no", "source", "source_size", "n_docs", "weight", "target")


def schedule(spark: SparkSession, targets: DataFrame, block_words: int, total: int) -> DataFrame:
    """Slots: slot, no (of the source), rank within the source. `targets` has a row per source."""
    n_slots = -(-total // block_words)
    upto = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    ends = targets.where("target > 0").withColumn("hi", F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy()))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("no")), F.lit(0.0)))
    # The last interval is open to the right against rounding. Cells turn the look-up of a point into an equal join.
    ends = ends.withColumn("hi", F.when(F.col("no") == F.max("no").over(Window.partitionBy()), 2.0).otherwise(F.col("hi")))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1))
    ends = ends.select("no", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * GOLDEN, F.lit(1.0)).alias("u"))
    named = (
        slots.withColumn("cell", cell(F.col("u"))).join(ends, "cell").where("u >= lo and u < hi")
        .select("slot", "no", F.expr(f"slot div {CHUNK}").alias("chunk"))
    )
    counts = named.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("inside", inside).join(counts, ["no", "chunk"])
    return ranked.select("slot", "no", (F.col("first") + F.col("inside")).alias("rank"))


def segments(slots: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """What each slot takes of its source's stream: slot, no, block, lo, hi (words of one lap, within a block from its start).

    Rank r takes words [r, r + 1) * block_words of the laps one after the other, up to the end of the third lap.
    """
    b = F.lit(block_words).cast("long")
    ranked = slots.join(targets.select("no", "source_size"), "no").where("source_size > 0")
    taken = ranked.withColumn("a", F.col("rank") * b).withColumn("z", F.least(F.col("a") + b, MAX_REPEATS * F.col("source_size"))).where("a < z")
    lapped = taken.withColumn("lap", F.explode(F.expr("sequence(a div source_size, (z - 1) div source_size)")))
    turn = F.col("lap") * F.col("source_size")
    lapped = lapped.withColumn("lo", F.greatest("a", turn) - turn).withColumn("hi", F.least(F.col("z"), turn + F.col("source_size")) - turn)
    return _by_block(lapped.select("slot", "no", "lo", "hi"), block_words)


def _by_block(spans: DataFrame, block_words: int) -> DataFrame:
    """Spans [lo, hi) cut at the borders of blocks: one row for each `block` that a span touches."""
    b = F.lit(block_words).cast("long")
    each = spans.withColumn("block", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
    return each.withColumns({"lo": F.greatest("lo", F.col("block") * b), "hi": F.least(F.col("hi"), (F.col("block") + 1) * b)})


def place(sized: DataFrame, targets: DataFrame, n_docs: int) -> DataFrame:
    """Documents with their source's row and [start, end) in its stream of words, shuffled by their key."""
    n_buckets = max(16, n_docs // BUCKET_DOCS)
    of = targets.withColumnRenamed("source", "of")
    known = sized.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # The first digits of the hash: buckets in order hold keys in order.
    known = known.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_buckets / (1 << 32)))
    counts = known.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("no", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    upto = Window.partitionBy("no", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ended = known.withColumn("upto", F.sum("size").over(upto)).join(counts, ["no", "bucket"])
    ended = ended.withColumn("end", F.col("first") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    return ended.select("doc_id", "source", "size", "source_size", "target", "no", "start", "end")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot and block_words."""
    spark = docs.sparkSession
    sized = cut(sizes(docs))
    targets = cut(source_targets(sized))
    total, n_docs = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    size = max(1, total // POINTS)
    slots = segments(schedule(spark, targets, size, total), targets, size)
    placed = cut(place(sized, targets, n_docs))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    spans = placed.where("size > 0").select(*columns, "no", "start", F.col("start").alias("lo"), F.col("end").alias("hi"))
    pieces = _by_block(spans, size).withColumnsRenamed({"lo": "from", "hi": "to"})
    shared = F.greatest(F.lit(0), F.least("hi", "to") - F.greatest("lo", "from"))
    met = pieces.join(slots, ["no", "block"], "left").withColumn("words", F.when(F.col("slot").isNull(), 0).otherwise(shared))
    some = met.groupBy(*columns, "no", "start").agg(
        F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot")
    )
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    result = [*columns, "taken", "first_slot"]
    return some.select(*result).union(none.select(*result)).withColumn("block_words", F.lit(size).cast("long"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
  md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) k from documents),
per as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 no from s group by 1),
w as (select *, [5.0::double, 2.0, 1.0][no % 3 + 1] weight, 3.0::double * source_size cap from per),
l as (select *, cap / weight ratio, (sum(source_size) over () - coalesce(sum(cap) over before, 0))
    / (sum(weight) over () - coalesce(sum(weight) over before, 0)) share
  from w window before as (order by cap / weight, no rows between unbounded preceding and 1 preceding)),
t as (select *, least(cap, weight * (select share from l where ratio >= share order by ratio, no limit 1)) target from l),
size_of as (select sum(size)::bigint total, greatest(1, sum(size)::bigint // 1000000) b from s),
ends as (select no, sum(target) over (order by no) / sum(target) over () hi, no = max(no) over () is_last from t where target > 0),
spans as (select no, coalesce(lag(hi) over (order by no), 0.0) lo, case when is_last then 2.0 else hi end hi from ends),
points as (select i slot, ((i + 1) * 0.6180339887498949::double) % 1.0::double u from size_of, range((total + b - 1) // b) r(i)),
ranked as (select slot, no, row_number() over (partition by no order by slot) - 1 rank from points join spans on u >= lo and u < hi),
given as (select no, count(*) n_slots from ranked group by 1),
g as (select t.no, t.source, source_size, target, b, least(coalesce(n_slots, 0) * b, 3 * source_size) words from size_of, t left join given using (no)),
p as (select s.*, g.no, g.source_size, target, b, words, sum(size) over (partition by s.source order by k, doc_id, size rows unbounded preceding) upto
  from s join g on s.source is not distinct from g.source)
select doc_id, source, size, source_size, target, first.slot as first_slot, b as block_words, (case when source_size = 0 then 0 else words // source_size * size
  + greatest(0, least(upto, words % source_size) - (upto - size)) end)::bigint taken
from p left join ranked first on first.no = p.no and first.rank = (upto - size) // b and size > 0 and upto - size < words
"""
