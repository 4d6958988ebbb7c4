"""Queries over stored indexes of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.config import RetrievalConfig
from dossier.functions.lineage import checkpoint_folder, cut
from dossier.operators import index_store as ix_store
from dossier.operators import postings as po
from dossier.operators import vector_index as vi
from dossier.operators import vectors as vx
from dossier.plans import inputs

K = RetrievalConfig().fetch_k


def _folder(spark, name):
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _queries(spark, sf):
    return inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _vector_index(spark, sf, pools=None):
    """All vectors as a stored index that has measured how many lists a query needs."""
    folder = _folder(spark, "vectors")
    vi.write_vector_index(vi.calibrated(vi.vector_index(inputs.vector_docs(spark, sf)), K, pools=pools), folder)
    return vi.read_vector_index(spark, folder)


def vector_topk_indexed(spark, sf):
    """Neighbours of every vector from all lists of the stored index: the exact answer."""
    found = vi.indexed_topk(_queries(spark, sf), _vector_index(spark, sf), K, probe=vi.ALL_LISTS)
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "seq")


def vector_index_recall(spark, sf):
    """How many of the exact neighbours, of all and of one type, stand in the lists that queries read: all vectors are asked."""
    both = [vx.Pool("all", K), vx.Pool("table", K, "table")]
    index, asked, docs = _vector_index(spark, sf, both), _queries(spark, sf), inputs.vector_docs(spark, sf)
    # written once: both types are read from them
    exact = cut(vx.vector_pools(asked, docs, both).select("query_id", "channel", "doc_id"))
    found = cut(vi.indexed_pools(asked, index, both).select("query_id", "channel", "doc_id"))
    keys = ("query_id", "channel")
    parts = [
        vi.recall(exact.filter(F.col("channel") == p.channel), found.filter(F.col("channel") == p.channel), keys).withColumn("channel", F.lit(p.channel))
        for p in both
    ]
    return parts[0].unionByName(parts[1]).select("channel", "n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


def bm25_topk_stored(spark, sf):
    """The best documents of every passage from a stored index that prunes by what tokens can add."""
    folder = _folder(spark, "postings")
    po.write_postings(inputs.corpus(spark, sf), folder)
    return po.stored_topk(inputs.passages(spark, sf), po.read_postings(spark, folder), 10).select("kb", "query_id", "doc_id", "score", "rank")


def index_after_refreshes(spark, sf):
    """The index of all documents after a first build with mistakes, two refreshes and a compaction."""
    root, docs = _folder(spark, "index"), inputs.corpus(spark, sf).select("kb", "doc_id", "document")
    kind = F.pmod(F.col("doc_id"), F.lit(5))
    wrong = docs.filter(kind == 1).withColumn("document", F.reverse("document"))
    extra = docs.filter(kind == 2).withColumn("doc_id", -1 - F.col("doc_id"))
    ix_store.refresh_index(spark, root, docs.filter(kind > 1).unionByName(wrong).unionByName(extra))
    ix_store.refresh_index(spark, root, docs.filter(kind == 1), extra)
    ix_store.compact_index(spark, root)
    ix_store.refresh_index(spark, root, docs.filter(kind == 0))
    index = ix_store.open_index(spark, root)
    return index.postings.join(index.terms, ["kb", "token"]).select("kb", "doc_id", "token", "tf", "doc_len", "df", F.round("idf", 6).alias("idf"))


QUERIES = {f.__name__: f for f in (vector_topk_indexed, vector_index_recall, bm25_topk_stored, index_after_refreshes)}
