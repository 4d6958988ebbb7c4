"""A lexical index that is kept up to date: refreshes add segments, nothing is built again.

Below a root, by segment number: `postings` (kb, doc_id, doc_len, token, tf, in folders by segment and base), `dead`
(kb, doc_id: documents whose rows in all earlier segments no longer count), `terms` (kb, token, df, n_tokens) and `sizes`
(kb, n_docs, total), both as differences to what was there before, and `commits` (segment, base_segment: the first that
counts, which a compaction moves). A refresh writes its segment and then one commit row, so readers see the whole old or
the whole new index; a refresh that failed is written over by the next one.

Only documents that change are cut into words, and only bases that change are read. A document is its own key (kb,
doc_id): given twice in one refresh its words are counted together, as in one build.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.lineage import cut
from dossier.functions.sizes import broadcast_if, is_small, written_side
from dossier.functions.text import index_tokens, token_counts
from dossier.operators.index import LexicalIndex, repeated_ids, term_weights

DOC = ["kb", "doc_id"]
COMMIT = "segment long, base_segment long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with folder names typed as the schema says; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _state(spark: SparkSession, root: str) -> tuple[int, int]:
    """(first segment that counts, last committed one); (0, -1) before the first refresh."""
    last = _read(spark, f"{root}/commits", COMMIT).agg(F.max(F.struct("segment", "base_segment")).alias("c")).first()["c"]
    return (last["base_segment"], last["segment"]) if last else (0, -1)


def _ids(spark: SparkSession, root: str) -> str:
    """The type of doc_id, which stored files know."""
    return dict(spark.read.parquet(f"{root}/dead").dtypes)["doc_id"]


def _parts(spark: SparkSession, root: str, name: str, first: int, last: int, id_type: str) -> DataFrame:
    columns = {
        "postings": f"doc_id {id_type}, doc_len int, token string, tf int, segment long, kb string",
        "dead": f"kb string, doc_id {id_type}, segment long",
        "terms": "kb string, token string, df long, n_tokens long, segment long",
        "sizes": "kb string, n_docs long, total long, segment long",
    }
    return _read(spark, f"{root}/{name}", columns[name]).filter(F.col("segment").between(first, last))


def live_postings(spark: SparkSession, root: str, kbs: DataFrame | None = None) -> DataFrame:
    """kb, doc_id, doc_len, token, tf of documents as they are now; with `kbs` only folders of these bases are read."""
    first, last = _state(spark, root)
    id_type = _ids(spark, root)
    rows = _parts(spark, root, "postings", first, last, id_type)
    if kbs is not None:
        rows = rows.join(broadcast_if(is_small(kbs), kbs.filter(F.col("kb").isNotNull() & (F.col("kb") >= ""))), "kb", "left_semi")
    newest = _parts(spark, root, "dead", first, last, id_type).groupBy(*DOC).agg(F.max("segment").alias("upto"))
    small = is_small(newest)
    return (
        rows.join(broadcast_if(small, newest), DOC, "left").filter(F.col("upto").isNull() | (F.col("segment") >= F.col("upto")))
        .select("kb", "doc_id", "doc_len", "token", "tf")
    )


def _tallies(postings: DataFrame, sign: int) -> DataFrame:
    return postings.groupBy("kb", "token").agg((sign * F.count(F.lit(1))).alias("df"), (sign * F.sum("tf")).alias("n_tokens"))


def _commit(spark: SparkSession, root: str, segment: int, base_segment: int) -> None:
    spark.range(1).select(F.lit(segment).cast("long").alias("segment"), F.lit(base_segment).cast("long").alias("base_segment")).coalesce(1).write.mode(
        "append"
    ).parquet(f"{root}/commits")


def _write_segment(root: str, segment: int, **parts: DataFrame) -> None:
    """Write each part to its segment's folder, over what a failed refresh may have left."""
    for name, rows in parts.items():
        if name == "postings":
            rows = rows.hint("rebalance", "kb")
            rows.write.mode("overwrite").partitionBy("kb").parquet(f"{root}/{name}/segment={segment}")
        else:
            rows.write.mode("overwrite").parquet(f"{root}/{name}/segment={segment}")


def refresh_index(spark: SparkSession, root: str, docs: DataFrame, removed: DataFrame | None = None, text: str = "document") -> None:
    """Take in new and changed documents (kb, doc_id, text) and let go of removed ones (kb, doc_id).

    A document both given and removed is given. Documents without words count in the sizes of their base.
    """
    first, last = _state(spark, root)
    segment = last + 1
    toks = docs.select(*DOC, index_tokens(F.col(text)).alias("toks"))
    if repeated_ids(docs):  # texts under one id count together
        counted = toks.select(*DOC, F.explode_outer("toks").alias("token")).groupBy(*DOC, "token").agg(F.count("token").cast("int").alias("tf"))
    else:
        counted = toks.select(*DOC, F.inline_outer(token_counts(F.col("toks")))).withColumn("tf", F.coalesce("tf", F.lit(0)))
    words = cut(counted)
    added = words.groupBy(*DOC).agg(F.sum("tf").cast("int").alias("doc_len"))
    new = words.filter(F.col("token").isNotNull()).join(added, DOC).select("kb", "doc_id", "doc_len", "token", "tf")
    gone = added.select(*DOC) if removed is None else added.select(*DOC).unionByName(removed.select(*DOC)).distinct()
    dead = cut(gone)
    terms, sizes = _tallies(new, 1), added.groupBy("kb").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total"))
    if last >= 0:
        touched = written_side(dead.select("kb").distinct())
        old = live_postings(spark, root, touched).join(broadcast_if(is_small(dead), dead), DOC, "left_semi")
        before = live_documents(spark, root).join(broadcast_if(is_small(dead), dead), DOC, "left_semi")
        lost = before.groupBy("kb").agg((-F.count(F.lit(1))).alias("n_docs"), (-F.coalesce(F.sum("doc_len"), F.lit(0))).alias("total"))
        terms = terms.unionByName(_tallies(old, -1)).groupBy("kb", "token").agg(F.sum("df").alias("df"), F.sum("n_tokens").alias("n_tokens"))
        terms = terms.filter("df <> 0 or n_tokens <> 0")
        sizes = sizes.unionByName(lost).groupBy("kb").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
    _write_segment(root, segment, postings=new, documents=added, dead=dead, terms=cut(terms), sizes=cut(sizes))
    _commit(spark, root, segment, first)


def live_documents(spark: SparkSession, root: str) -> DataFrame:
    """kb, doc_id, doc_len of documents as they are now, also of those without words."""
    first, last = _state(spark, root)
    id_type = _ids(spark, root)
    rows = _read(spark, f"{root}/documents", f"kb string, doc_id {id_type}, doc_len int, segment long").filter(F.col("segment").between(first, last))
    newest = _parts(spark, root, "dead", first, last, id_type).groupBy(*DOC).agg(F.max("segment").alias("upto"))
    return rows.join(newest, DOC, "left").filter(F.col("upto").isNull() | (F.col("segment") >= F.col("upto"))).select(*DOC, "doc_len")


def compact_index(spark: SparkSession, root: str) -> None:
    """Write all that is live as one segment, from which readers start; earlier segments stay until the owner removes them."""
    _, last = _state(spark, root)
    if last < 0:
        return
    postings, documents = cut(live_postings(spark, root)), cut(live_documents(spark, root))
    none = documents.select(*DOC).limit(0)
    sizes = documents.groupBy("kb").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total"))
    _write_segment(root, last + 1, postings=postings, documents=documents, dead=none, terms=_tallies(postings, 1), sizes=sizes)
    _commit(spark, root, last + 1, last + 1)


def open_index(spark: SparkSession, root: str) -> LexicalIndex:
    """The index as of the last commit, for `bm25_topk`: vocabulary and sizes are sums of small differences."""
    first, last = _state(spark, root)
    id_type = _ids(spark, root)
    vocabulary = cut(
        _parts(spark, root, "terms", first, last, id_type).groupBy("kb", "token").agg(F.sum("df").alias("df")).filter("df > 0")
    )
    sizes = _parts(spark, root, "sizes", first, last, id_type).groupBy("kb").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
    stats = cut(sizes.filter("n_docs > 0").select("kb", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_len")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return LexicalIndex(live_postings(spark, root).repartition(n, *DOC), term_weights(vocabulary, stats), stats)
