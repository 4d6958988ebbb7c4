"""The whole retrieval chain for all queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.config import RetrievalConfig
from dossier.functions.lineage import cut
from dossier.functions.sizes import written_side
from dossier.functions.text import code_tokens
from dossier.operators.index import LexicalIndex, lexical_index
from dossier.operators.retrieval import (
    QUERY,
    Scorer,
    bm25_topk,
    candidate_pool,
    dedupe_candidates,
    distance_fallback,
    fuse_code_bonus,
    mixed_slot_fill,
    rerank,
    rerank_text,
    split_topk,
    table_floor,
    with_code_overlap,
    znorm_by_modality,
)
from dossier.operators.vectors import ALL, Pool, vector_pools

DOC = ["kb", "doc_id"]


def channel_pools(cfg: RetrievalConfig) -> list[Pool]:
    """The three vector searches of one query, answered by one pass.

    Rules of the published system: the list of texts falls away where it is no longer than the
    general one, and tables are limited to `table_pool_max` (None: all tables are candidates).
    """
    pools = [Pool("general", cfg.fetch_k), Pool("table", cfg.table_pool_max or ALL, "table")]
    if cfg.text_fetch_k > cfg.fetch_k:
        pools.append(Pool("text", cfg.text_fetch_k, "text_chunk"))
    return pools


def candidates(
    queries: DataFrame, kb: DataFrame, cfg: RetrievalConfig, index: LexicalIndex | None = None, metric: str = "l2sq"
) -> DataFrame:
    """Narrow and wide candidates with the columns ranking needs; long texts stay behind.

    `queries`: kb, query_id, text, embedding. `kb`: kb, doc_id, type, table_name, chunk_id,
    title, document, serialized, content, embedding. A query is answered from its own base;
    ids need to be unique inside a base only. Codes are taken from candidates, not from all texts.
    """
    # both written once: a search would otherwise run for each list made of it, and again for the documents to be read
    vectors = cut(vector_pools(queries, kb, channel_pools(cfg), metric))
    lexical = None
    if cfg.bm25_enabled:
        index = index or lexical_index(kb)
        text_ids = kb.filter(F.col("type") == "text_chunk").select("kb", "doc_id")
        lexical = bm25_topk(queries, index, cfg.bm25_top_n).join(text_ids, DOC, "left_semi")
    pool = cut(candidate_pool(vectors, lexical, cfg.fetch_k, cfg.text_fetch_k))
    own = F.when(F.length(F.coalesce("serialized", F.lit(""))) > 0, F.col("serialized")).when(
        F.length(F.coalesce("content", F.lit(""))) > 0, F.col("content")
    ).otherwise(F.col("document"))
    wanted = written_side(pool.select(*DOC).distinct())  # ids go to the texts, not texts to the ids
    facts = kb.join(wanted, DOC, "left_semi").select(
        *DOC, "type", "table_name", "chunk_id", "title", code_tokens(own).alias("doc_codes")
    )
    asked = queries.select(*QUERY, code_tokens(F.col("text")).alias("query_codes"))
    return dedupe_candidates(pool.join(facts, DOC).join(asked, QUERY))


def with_pair_texts(pairs: DataFrame, queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Query and document text for a pair scorer, joined only for the pairs to be scored."""
    texts = kb.select(*DOC, rerank_text().alias("doc_text"))
    return pairs.join(texts, DOC).join(queries.select(*QUERY, F.col("text").alias("query_text")), QUERY)


def rank_candidates(cands: DataFrame, scorer: Scorer | None, cfg: RetrievalConfig) -> DataFrame:
    """From candidates to the final ranks of every query."""
    scored = with_code_overlap(rerank(cands, scorer, cfg.top_k))
    # a pair scorer is the dearest step: its scores are written once, then ranked
    scored = cut(scored.drop("query_codes", "doc_codes"))
    columns = [*QUERY, "channel", "doc_id", "type", "key", "distance", "rerank_score", "code_score", "norm_score"]
    ranked = fuse_code_bonus(znorm_by_modality(scored, cfg.rerank_shortlist), cfg.code_token_bonus).select(*columns, "rank")
    narrow, wide = ranked.filter("channel = 'narrow'"), ranked.filter("channel = 'wide'")
    if cfg.table_floor:
        narrow = table_floor(narrow, cfg.top_k)
    picked = (split_topk if cfg.split_results else mixed_slot_fill)(narrow, wide, cfg.top_k)
    plain = scored.filter("channel = 'narrow' and rerank_score is null")
    by_distance = distance_fallback(plain, cfg.top_k).withColumns(
        {"code_score": F.lit(0.0), "norm_score": F.lit(None).cast("double")}
    )
    final = [*columns, "final_rank"]
    return picked.select(*final).unionByName(by_distance.select(*final))


def retrieve(
    queries: DataFrame,
    kb: DataFrame,
    scorer: Scorer | None = None,
    cfg: RetrievalConfig = RetrievalConfig(),
    index: LexicalIndex | None = None,
    metric: str = "l2sq",
) -> DataFrame:
    """Evidence for all queries: ranks only; `attach_evidence` adds the texts."""
    return rank_candidates(cut(candidates(queries, kb, cfg, index, metric)), scorer, cfg)


def attach_evidence(ranked: DataFrame, kb: DataFrame) -> DataFrame:
    """Join the long columns back, for the few ranked rows only."""
    wide = ["display_name", "table_name", "serialized", "html", "notes", "legend", "footnotes",
            "chunk_id", "title", "section_path", "content", "page_idx", "img_path"]
    return written_side(ranked).join(kb.select(*DOC, *[c for c in wide if c in kb.columns]), DOC)
