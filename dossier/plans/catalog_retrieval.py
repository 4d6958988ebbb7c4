"""Index and retrieval queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.config import RetrievalConfig, TextConfig
from dossier.functions.lineage import checkpoint_folder, cut
from dossier.functions.scan import Running, running_values
from dossier.functions.text import code_tokens, word_tokens
from dossier.operators import index as ix
from dossier.operators import retrieval as rt
from dossier.operators import tables as tb
from dossier.operators import text as tx
from dossier.operators import vectors as vx
from dossier.plans import inputs
from dossier.plans.build import build_kb, encode_queries
from dossier.plans.retrieve import attach_evidence, candidates, channel_pools, retrieve
from dossier.sources import kb as kb_store
from dossier.streaming.audit_stream import stream_kb_refresh as refresh

CFG = RetrievalConfig()


def r6(c: str):
    return F.round(c, 6).alias(c)


def kb_documents(spark, sf):
    notes = inputs.table_notes(spark, sf)
    docs = tb.table_documents(notes, tb.table_facts(inputs.cells(spark, sf, "value"), notes))
    tables = docs.withColumns({
        "kb": F.lit("orders"), "table_idx": F.col("page_idx"), "html": F.lit(""), "img_path": F.lit(""),
    })
    chunks = tx.section_chunks(inputs.blocks(spark, sf)).withColumnRenamed("standard_id", "kb")
    whole = TextConfig(window_max_chars=0)
    return ix.kb_documents(tables, chunks, cfg=whole).select(
        "kb", "doc_id", "type", "document", "table_name", "chunk_id", "section_path"
    )


def _encode(df, text):
    """A deterministic stand-in for both encoder families."""
    return df.withColumn("embedding", inputs.text_vector(F.concat("route", F.col(text))))


def _built(spark, sf, contents):
    """Bases built from blocks, with windows and questions of every chunk."""
    blocks, cfg = inputs.blocks(spark, sf), TextConfig(window_max_chars=400, questions_per_chunk=2)
    chunks = cut(tx.section_chunks(blocks, cfg.repeat_min_pages, cfg.min_content_chars))
    asked = chunks.select(F.col("standard_id").alias("kb"), "chunk_id", F.replace("content", F.lit(". "), F.lit("? \n- ")).alias("raw"))
    return build_kb(blocks, _encode, asked, cfg, contents=contents, sections=chunks)


def build_knowledge_bases(spark, sf):
    """Every standard as a base: tables, windows and questions with their encoder."""
    return _built(spark, sf, contents=False).select("kb", "doc_id", "type", "chunk_id", "table_name", "synth", "route", "document", F.element_at("embedding", 1).alias("first_number"))


def retrieve_built(spark, sf):
    """All passages, each asked of two of the built bases."""
    docs = _built(spark, sf, contents=True)
    bases = F.explode(F.array(*[F.concat(F.lit("src"), ((F.col("item_id") + i) % 20).cast("string")) for i in (0, 7)]))
    asked = inputs.table(spark, sf, "benchmark").select(bases.alias("kb"), F.col("item_id").alias("query_id"), "text")
    queries = encode_queries(asked, docs, _encode)
    index = ix.lexical_index(docs)
    return retrieve(queries, docs, inputs.nearness_scorer, CFG, index).select("kb", "query_id", "doc_id", "type", "key", "final_rank")


def kb_catalog(spark, sf):
    return kb_store.kb_catalog(inputs.kb(spark, sf))


def _folder(spark):
    return f"{checkpoint_folder(spark).rstrip('/')}/kb-{uuid.uuid4().hex}"


def _stored(spark, folder):
    tables = kb_store.read_kb(spark, folder, "table").select("kb", "doc_id", "type", "table_name", "document")
    return tables.unionByName(kb_store.read_kb(spark, folder, "text_chunk").select("kb", "doc_id", "type", "table_name", "document"))


def stored_kb(spark, sf):
    """Two bases written; then one is replaced by its texts only, the other must stay."""
    folder, docs = _folder(spark), inputs.kb(spark, sf)
    kb_store.write_kb(docs.unionByName(docs.withColumn("kb", F.lit("second"))), folder)
    kb_store.write_kb(docs.filter("type = 'text_chunk'"), folder)
    return _stored(spark, folder)


def stream_kb_refresh(spark, sf):
    """The knowledge base arrives as a stream of files and is stored by base and type."""
    folder = _folder(spark)
    arrived = f"{folder}-in"
    inputs.kb(spark, sf).write.parquet(arrived)
    stream = spark.readStream.schema(spark.read.parquet(arrived).schema).parquet(arrived)
    refresh(stream, folder, f"{folder}-state").awaitTermination()
    return _stored(spark, folder)


def attach_questions(spark, sf):
    raw = F.replace("text", F.lit(". "), F.lit("? \n- "))
    generated = inputs.table(spark, sf, "documents").select(F.lit("main").alias("kb"), F.col("doc_id").alias("chunk_id"), raw.alias("raw"))
    return ix.attach_questions(generated, 2)


def chunks_to_do(spark, sf):
    """A run of question generation that was broken off: chunks without a usable question yet, then those of a second round."""
    chunks = tx.section_chunks(inputs.blocks(spark, sf)).withColumnRenamed("standard_id", "kb")
    raw = F.replace("content", F.lit(". "), F.lit("? \n- "))
    rounds = [F.length("content") % 3 == 0, F.length("content") % 3 == 1]
    left = chunks.select("kb", "chunk_id", "content")
    for part in rounds:
        left = cut(left)
        generated = left.filter(part).select("kb", "chunk_id", raw.alias("raw"))
        left = ix.chunks_to_do(left, ix.attach_questions(generated, 1))
    return left.select("kb", "chunk_id", F.length("content").alias("n_chars"))


def lexical_index(spark, sf):
    index = ix.lexical_index(inputs.corpus(spark, sf))
    return index.postings.join(index.terms, ["kb", "token"]).select("kb", "doc_id", "token", "tf", "doc_len", "df", r6("idf"))


def embed(spark, sf):
    """A deterministic stand-in encoder (letter counts) over all documents, routed by language."""

    def load(route: str):
        import numpy as np

        letters = "abcdefgh" if route == "english" else "éçğışöüa"
        return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], dtype="float32")

    routed = tx.route_language(inputs.corpus(spark, sf), sample_chars=None, text="document")
    vectors = ix.embed(routed, load, "document", "route")
    return vectors.select("kb", "doc_id", "route", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def tokens(spark, sf):
    asked = rt.tokens(inputs.table(spark, sf, "benchmark")).select(
        F.col("item_id").alias("query_id"), F.array_join("index_tokens", " ").alias("tokens"), F.size("code_tokens").alias("n_codes")
    )
    docs = inputs.table(spark, sf, "documents").select(
        (-1 - F.col("doc_id")).alias("query_id"), F.array_join(word_tokens(F.col("text")), " ").alias("tokens"),
        F.size(code_tokens(F.col("text"))).alias("n_codes"),
    )
    return asked.unionByName(docs)


def bm25_topk(spark, sf):
    index = ix.lexical_index(inputs.corpus(spark, sf))
    return rt.bm25_topk(inputs.passages(spark, sf), index, 10).select("kb", "query_id", "doc_id", "score", "rank")


def code_overlap(spark, sf):
    """Codes of each document against the codes of the document before it in its source."""
    coded = inputs.table(spark, sf, "documents").select("doc_id", "source", code_tokens(F.col("text")).alias("doc_codes"))
    asked = coded.select("source", F.col("doc_id").alias("key"), F.col("doc_codes").alias("wanted"))
    pairs = running_values(
        inputs.table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", [Running("before", "prev", F.col("doc_id"))]
    ).filter(F.col("before").isNotNull())
    both = pairs.join(coded, ["source", "doc_id"]).join(asked.withColumnRenamed("key", "before"), ["source", "before"])
    return rt.with_code_overlap(both.withColumnRenamed("wanted", "query_codes")).select("doc_id", r6("code_score"))


def _all_vectors(spark, sf):
    return inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark, sf):
    return vx.vector_topk(_all_vectors(spark, sf), inputs.vector_docs(spark, sf), CFG.fetch_k).select("query_id", "doc_id", r6("distance"), "seq")


def vector_topk_by_type(spark, sf):
    return vx.vector_topk_by_type(_all_vectors(spark, sf), inputs.vector_docs(spark, sf), "table", CFG.table_pool_max).select(
        "query_id", "doc_id", r6("distance"), "seq"
    )


def candidate_pool(spark, sf):
    docs, asked = inputs.written_kb(spark, sf), inputs.kb_queries(spark, sf)
    near = vx.vector_pools(asked, docs, channel_pools(CFG))
    texts = docs.filter("type = 'text_chunk'").select("kb", "doc_id")
    lexical = rt.bm25_topk(asked, ix.lexical_index(docs), CFG.bm25_top_n).join(texts, ["kb", "doc_id"], "left_semi")
    return rt.candidate_pool(near, lexical, CFG.fetch_k, CFG.text_fetch_k).select("kb", "query_id", "channel", "list_no", "doc_id", r6("distance"), "seq")


def _candidates(spark, sf):
    return candidates(inputs.kb_queries(spark, sf), inputs.written_kb(spark, sf), CFG)


def dedupe_candidates(spark, sf):
    return _candidates(spark, sf).select("kb", "query_id", "channel", "doc_id", "key", "list_no", "seq")


def _scored(spark, sf):
    return cut(rt.with_code_overlap(rt.rerank(cut(_candidates(spark, sf)), inputs.nearness_scorer, CFG.top_k)))


def rerank(spark, sf):
    return _scored(spark, sf).select("kb", "query_id", "channel", "key", "doc_id", r6("rerank_score"))


def znorm_by_modality(spark, sf):
    return rt.znorm_by_modality(_scored(spark, sf)).select("kb", "query_id", "channel", "doc_id", r6("norm_score"))


def _ranked(spark, sf):
    return rt.fuse_code_bonus(rt.znorm_by_modality(_scored(spark, sf)))


def fuse_code_bonus(spark, sf):
    return _ranked(spark, sf).select("kb", "query_id", "channel", "doc_id", "norm_score", "rank")


def _floored(ranked):
    return rt.table_floor(ranked.filter("channel = 'narrow'").withColumn("before_rank", F.col("rank")), CFG.top_k)


def table_floor(spark, sf):
    return _floored(_ranked(spark, sf)).select("kb", "query_id", "doc_id", "before_rank", "rank")


def split_topk(spark, sf):
    ranked = _ranked(spark, sf)
    return rt.split_topk(_floored(ranked).drop("before_rank"), ranked.filter("channel = 'wide'"), CFG.top_k).select(
        "kb", "query_id", "channel", "doc_id", "type", "final_rank"
    )


def mixed_slot_fill(spark, sf):
    ranked = _ranked(spark, sf)
    return rt.mixed_slot_fill(_floored(ranked).drop("before_rank"), ranked.filter("channel = 'wide'"), CFG.top_k).select(
        "kb", "query_id", "channel", "doc_id", "final_rank"
    )


def distance_fallback(spark, sf):
    return rt.distance_fallback(_candidates(spark, sf).filter("channel = 'narrow'"), CFG.top_k).select(
        "kb", "query_id", "doc_id", r6("distance"), "final_rank"
    )


def _retrieved(spark, sf, docs):
    return retrieve(inputs.kb_queries(spark, sf), docs, inputs.nearness_scorer, CFG)


def format_context(spark, sf):
    docs = inputs.written_kb(spark, sf)
    return rt.format_context(attach_evidence(_retrieved(spark, sf, docs), docs))


def retrieve_all(spark, sf):
    return _retrieved(spark, sf, inputs.written_kb(spark, sf)).select("kb", "query_id", "doc_id", "type", "key", "norm_score", "final_rank")


QUERIES = {
    f.__name__: f
    for f in (kb_documents, build_knowledge_bases, retrieve_built, kb_catalog, stored_kb, stream_kb_refresh, attach_questions, chunks_to_do, lexical_index, embed, tokens, bm25_topk, code_overlap, vector_topk,
              vector_topk_by_type, candidate_pool, dedupe_candidates, rerank, znorm_by_modality, fuse_code_bonus,
              table_floor, split_topk, mixed_slot_fill, distance_fallback, format_context)
}
QUERIES["retrieve"] = retrieve_all
