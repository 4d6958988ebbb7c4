"""Words counted inside their document's row, and documents scored by rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dossier.functions.text import token_counts
from dossier.operators import index as ix
from dossier.operators import retrieval as rt

TEXTS = ["a b a", "b b b c", "", None, "a b a", "d 1.2.1 HD 1.1 a", "c"] * 3


def corpus(spark, twice=False):
    rows = [(("x", "y")[i % 2], i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:4] * twice, "kb string, doc_id int, document string")


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["z"])], "id int, t array<string>")
    got = {r.id: r.c and {x.token: x.tf for x in r.c} for r in rows.select("id", token_counts(F.col("t")).alias("c")).collect()}
    assert got == {1: {"a": 1, "b": 3}, 2: None, 3: None, 4: {"z": 1}}


def test_words_are_grouped_by_id_only_where_ids_repeat(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(ix.lexical_index(corpus(spark)).postings)
    index = ix.lexical_index(corpus(spark, twice=True))
    got = {(r.kb, r.doc_id, r.token): r.tf for r in index.postings.collect()}
    want = Counter()
    for kb, i, t in [r for r in corpus(spark, twice=True).collect()]:
        want.update((kb, i, w) for w in (t or "").split() if "." not in w and w.islower())
    assert {k: v for k, v in got.items() if k in want} == dict(want)


def test_vocabulary_follows_from_postings(spark):
    for docs in (corpus(spark), corpus(spark, twice=True)):
        index = ix.lexical_index(docs)
        want = Counter((r.kb, r.token) for r in index.postings.collect())
        assert {(r.kb, r.token): r.df for r in index.terms.collect()} == want
        n = {r.kb: r["count"] for r in docs.groupBy("kb").count().collect()}
        words = Counter()
        for r in index.postings.collect():
            words[r.kb] += r.tf
        assert {r.kb: round(r.avg_len, 9) for r in index.stats.collect()} == {kb: round(words[kb] / n[kb], 9) for kb in n}


def test_documents_are_scored_as_by_grouping(spark, monkeypatch):
    index = ix.lexical_index(corpus(spark))
    asked = spark.createDataFrame([("x", 1, "a b"), ("x", 2, "c c HD 1.1"), ("y", 1, "a d"), ("y", 3, "nothing"), ("z", 1, "a")], "kb string, query_id int, text string")
    rows = lambda: sorted(map(tuple, rt.bm25_topk(asked, index, 2).select("kb", "query_id", "doc_id", "score", "rank").collect()))
    monkeypatch.setattr(rt, "HITS", 2)
    by_document = rows()
    monkeypatch.setattr(rt, "is_small", lambda *a: False)
    assert by_document == rows() and len(by_document) >= 6


def test_a_task_keeps_few_of_many_equal_documents():
    best = rt._BestDocuments(2, 3)
    for lo in range(0, 1000, 100):
        docs = pa.RecordBatch.from_pydict({"doc_id": np.arange(lo, lo + 100)})
        doc = np.repeat(np.arange(100), 2)
        best.add(doc, np.tile([0, 1], 100), np.where(np.tile([0, 1], 100) == 0, 1.0, lo + np.arange(200) // 2 + 1.0), docs)
        assert len(best.query) <= 6
    kept = sorted(zip(best.query.tolist(), best.docs.column("doc_id").to_pylist()))
    assert kept == [(0, 0), (0, 1), (0, 2), (1, 997), (1, 998), (1, 999)]
