"""DuckDB SQL that gives the same rows as the queries over stored indexes."""

from __future__ import annotations

from dossier.plans.sql_retrieval import _ALL, VECTOR_DOCS, nearest
from dossier.plans.sql_retrieval import ORACLES as RETRIEVAL

ORACLES = {
    "index_after_refreshes": RETRIEVAL["lexical_index"],
    "bm25_topk_stored": RETRIEVAL["bm25_topk"],
    "vector_topk_indexed": f"with {VECTOR_DOCS}, {_ALL} select query_id, doc_id, round(distance, 6) distance, seq from ({nearest('vector_queries', 'vector_docs', 12)})",
    "vector_index_recall": f"""with {VECTOR_DOCS}, {_ALL}
        select 'all' as channel, count(*) n_exact, true as recall_reached from ({nearest('vector_queries', 'vector_docs', 12)})
        union all select 'table', count(*), true from ({nearest('vector_queries', 'vector_docs', 12, "d.type = 'table'")})""",
}
