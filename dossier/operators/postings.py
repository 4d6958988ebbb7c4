"""A stored lexical index, and a search that reads common words only for documents that can still be among the best.

Postings are a table in buckets of whole documents, sorted by token inside a bucket: texts are cut into words once, a
score is complete inside a bucket without moving postings, and row groups without the asked tokens are skipped. The
greatest part that a token adds to any score of its base is stored with it; the search prunes by these bounds and its
answer is exactly that of `retrieval.bm25_topk`. For a base that is asked once over small texts, that plain pass is quicker.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.lineage import cut
from dossier.functions.sizes import broadcast_if, is_small, written_side
from dossier.functions.text import index_tokens
from dossier.operators.index import B, K1, counted_words, term_weights
from dossier.operators.retrieval import QUERY, SCORE_DIGITS, scored_by_document


@dataclass(frozen=True)
class StoredIndex:
    """postings: kb, doc_id, doc_len, token, tf (and doc_order where documents have one); terms: kb, token, df, idf, top; stats: kb, n_docs, avg_len.

    `top` is the greatest tf-and-length part of a score (without the weight of the term) among the token's postings.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: int


DOCS_PER_BUCKET = 50_000
_BUCKETED, _SORTED = ["kb", "doc_id"], ["kb", "token"]


def _stored_postings(postings: DataFrame, folder: str, buckets: int) -> DataFrame:
    """`postings` written to buckets below `folder`, as a table of this session."""
    name = f"postings_{uuid.uuid4().hex}"
    postings.write.mode("overwrite").bucketBy(buckets, *_BUCKETED).sortBy(*_SORTED).option("path", folder).saveAsTable(name)
    return postings.sparkSession.table(name)


def _impact(avg_len: str = "avg_len"):
    """What a posting adds to a score for a weight of one."""
    norm = K1 * (1 - B + B * F.col("doc_len") / F.col(avg_len))
    return F.col("tf") * (K1 + 1) / (F.col("tf") + norm)


def write_postings(docs: DataFrame, folder: str, text: str = "document", docs_per_bucket: int = DOCS_PER_BUCKET) -> StoredIndex:
    """Postings, vocabulary and statistics of each base, stored below `folder`; the number of buckets follows the documents."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(docs.groupBy("kb").agg(F.count(F.lit(1)).alias("n_docs")))
    n = max(least, -(-(sizes.agg(F.sum("n_docs")).first()[0] or 0) // docs_per_bucket))
    ids = ["kb", "doc_id", *[c for c in ("doc_order",) if c in docs.columns]]
    postings = _stored_postings(counted_words(docs, ids, text, n), f"{folder}/postings", n)
    totals = postings.groupBy("kb").agg(F.sum("tf").alias("total"))
    sizes.join(totals, "kb", "left").select(
        "kb", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_len")
    ).write.mode("overwrite").parquet(f"{folder}/stats")
    stats = spark.read.parquet(f"{folder}/stats")
    vocabulary = cut(
        postings.join(written_side(stats.select("kb", "avg_len")), "kb").groupBy("kb", "token")
        .agg(F.count(F.lit(1)).alias("df"), F.max(_impact()).alias("top"))
    )
    weights = term_weights(vocabulary.select("kb", "token", "df"), stats)
    weights.join(vocabulary.select("kb", "token", "top"), ["kb", "token"]).write.mode("overwrite").parquet(f"{folder}/terms")
    spark.range(1).select(F.lit(n).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/layout")
    return StoredIndex(postings, spark.read.parquet(f"{folder}/terms"), stats, n)


def read_postings(spark: SparkSession, folder: str) -> StoredIndex:
    """A stored index; its postings are a table of this session, read by bucket."""
    terms, stats, layout = (spark.read.parquet(f"{folder}/{part}") for part in ("terms", "stats", "layout"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/postings").schema)
    name, buckets = f"postings_{uuid.uuid4().hex}", layout.first()["buckets"]
    spark.sql(
        f"create table {name} ({columns}) using parquet clustered by ({', '.join(_BUCKETED)}) sorted by ({', '.join(_SORTED)}) "
        f"into {buckets} buckets location '{folder}/postings'"
    )
    return StoredIndex(spark.table(name), terms, stats, buckets)


# Rare terms, which set the bar: enough for the wanted documents, more while they stand in no more than this many for each.
BAR_DOCS = 10
TERMS_AT_ONCE = 400_000  # of all queries together, sent to every task
_SLACK = 1e-6  # more than sums in another order may differ


@dataclass(frozen=True)
class _Division:
    """What a search reads: `rare` terms for the bar, `heavy` terms of all documents, `light` ones of documents in play."""

    rare: DataFrame
    leaders: DataFrame
    terms: DataFrame  # all terms with `light`, and with `bar` and `rest` of their query
    small: bool

    @property
    def heavy(self) -> DataFrame:
        return self.terms.filter(~F.col("light"))

    @property
    def light(self) -> DataFrame:
        return self.terms.filter("light")

    def play(self, index: StoredIndex) -> DataFrame:
        """kb, query_id, doc_id, s: documents that can still be among the best."""
        rest = self.terms.groupBy(*QUERY).agg(F.max("bar").alias("bar"), F.max("rest").alias("rest"))
        seen = _parts(index.postings, self.heavy, self.small).groupBy(*QUERY, "doc_id").agg(F.sum("part").alias("s"))
        open_ = F.col("bar").isNull() | (F.col("s") + F.col("rest") >= F.col("bar"))
        return cut(seen.join(broadcast_if(self.small, rest), QUERY).filter(open_).select(*QUERY, "doc_id", "s"))


def _weighted(queries: DataFrame, index: StoredIndex) -> DataFrame:
    """kb, token, query_id, w, avg_len, df and `most`, more than which the term adds to no score."""
    asked = (
        queries.select("kb", "query_id", F.explode_outer(index_tokens(F.col("text"))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("kb", "query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    )
    w = F.col("qtf") * F.col("idf")
    most = F.abs(w) * F.col("top")
    return cut(
        index.terms.join(broadcast_if(is_small(asked), asked), ["kb", "token"])
        .join(broadcast_if(is_small(index.stats), index.stats.select("kb", "avg_len")), "kb")
        .select("kb", "token", "query_id", w.alias("w"), "avg_len", "df", most.alias("most"))
    )


def _parts(postings: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """What each posting adds to the score of its document for each query that asks its token."""
    hits = postings.join(broadcast_if(small, terms.select("kb", "token", "query_id", "w", "avg_len")), ["kb", "token"])
    return hits.withColumn("part", F.col("w") * _impact())


def _of_pairs(index: StoredIndex, pairs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Parts of given documents for the queries they are given with (`pairs`: kb, query_id, doc_id), no others."""
    near = index.postings.join(broadcast_if(is_small(pairs), pairs.select(*QUERY, "doc_id")), ["kb", "doc_id"])
    hits = near.join(broadcast_if(small, terms.select(*QUERY, "token", "w", "avg_len")), [*QUERY, "token"])
    return hits.withColumn("part", F.col("w") * _impact())


def _divided(queries: DataFrame, index: StoredIndex, n: int) -> _Division:
    return _division(_weighted(queries, index), index, n)


def _division(weighted: DataFrame, index: StoredIndex, n: int) -> _Division:
    small = is_small(weighted)
    below = Window.partitionBy(*QUERY).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    counted = weighted.withColumn("below", F.coalesce(F.sum("df").over(below), F.lit(0)))
    rare = counted.filter((F.col("below") < n) | (F.col("below") + F.col("df") <= BAR_DOCS * n))
    first = _parts(index.postings, rare, small).groupBy(*QUERY, "doc_id").agg(F.sum("part").alias("s"))
    best = Window.partitionBy(*QUERY).orderBy(F.desc("s"), "doc_id")
    leaders = cut(first.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= 2 * n).select(*QUERY, "doc_id"))
    # Whole scores of the leaders: the n-th of them is no more than the n-th best of all documents.
    whole = _of_pairs(index, leaders, weighted, small).groupBy(*QUERY, "doc_id").agg(F.sum("part").alias("s"))
    nth = whole.withColumn("k", F.row_number().over(best)).filter(F.col("k") == n)
    bar = nth.select(*QUERY, (F.col("s") - _SLACK).alias("bar"))
    upto = Window.partitionBy(*QUERY).orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.col("w") > 0, F.col("most")).otherwise(0.0)
    terms = cut(weighted.join(bar, QUERY, "left").withColumn(
        "light", F.coalesce((F.col("w") >= 0) & (F.sum(gain).over(upto) < F.col("bar")), F.lit(False))
    ))
    rest = F.sum(F.when(F.col("light"), F.col("most")).otherwise(0.0)).over(Window.partitionBy(*QUERY))
    return _Division(rare, leaders, cut(terms.withColumn("rest", rest)), small)


def _documents_in_reach(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """Postings of documents with a heavy term, where light terms alone have more postings than heavy ones; else all.

    What is light for every query is otherwise read for all documents, which costs less than a second pass over heavy terms.
    """
    sums = terms.groupBy("kb", "token").agg(F.max("df").alias("df"), F.min("light").alias("light")).groupBy("light").agg(F.sum("df").alias("n"))
    n = {r["light"]: r["n"] for r in sums.collect()}
    if n.get(True, 0) <= n.get(False, 0):
        return index.postings
    heavy = terms.filter(~F.col("light")).select("kb", "token").distinct()
    near = written_side(index.postings.join(broadcast_if(is_small(heavy), heavy), ["kb", "token"], "left_semi").select("kb", "doc_id").distinct())
    return index.postings.join(near, ["kb", "doc_id"], "left_semi")


def stored_topk(queries: DataFrame, index: StoredIndex, n: int = 10) -> DataFrame:
    """Best `n` documents (score above 0) of each query over its whole knowledge base: kb, query_id, doc_id, score, rank.

    `queries`: kb, query_id, text. The rarest terms of a query find leading documents; the n-th best whole score of these is
    a bar. Terms that cannot lift a document over the bar even together are light: a document without any other term is
    never scored, and light terms are summed for documents in play only. Terms of negative weight are never light. Ties go by
    doc_id, or by doc_order if the postings carry one.
    """
    weighted = _weighted(queries, index)
    order = [c for c in ("doc_order",) if c in index.postings.columns]
    # a bounded number of terms at once: a query's terms stay together
    parts = max(1, -(-weighted.count() // TERMS_AT_ONCE))
    scored = []
    for part in range(parts):
        some = weighted if parts == 1 else weighted.filter(F.pmod(F.xxhash64(*QUERY), F.lit(parts)) == part)
        terms = _division(some, index, n).terms
        best = scored_by_document(_documents_in_reach(index, terms), terms, order, n)
        scored.append(best.withColumn("score", F.round("score", SCORE_DIGITS)).filter(F.col("score") > 0))
    w = Window.partitionBy(*QUERY).orderBy(F.desc("score"), *order, "doc_id")
    return reduce(DataFrame.unionByName, scored).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def postings_scored(queries: DataFrame, index: StoredIndex, n: int = 10) -> DataFrame:
    """n_matched: postings that hold a term of a query (once for each such query); n_scored: how many `stored_topk` scores."""
    found = _divided(queries, index, n)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    matched = _weighted(queries, index).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_matched"))
    led = _of_pairs(index, found.leaders, _weighted(queries, index), found.small)
    read = (
        count(led).union(count(_parts(index.postings, found.rare, found.small))).union(count(_parts(index.postings, found.heavy, found.small)))
        .union(count(_of_pairs(index, found.play(index), found.light, found.small))).agg(F.sum("n").alias("n_scored"))
    )
    return matched.join(read, F.lit(True))  # one row each
