"""The stored lexical index against the plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import postings as po
from dossier.operators import retrieval as rt
from dossier.operators.index import lexical_index
from dossier.operators.retrieval import bm25_topk


def corpus(spark, n, seed, bases=("k", "other")):
    """Words of very unequal frequency, some repeated texts, texts of one word and of none."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, weights, k=r.choice([0, 1, 5, 30, 80])))
        rows.append((bases[i % 7 == 0], f"d{i % (n - 5):04d}x{i // (n - 5)}", text))
    return spark.createDataFrame(rows, "kb string, doc_id string, document string")


def asked(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(f"w{int(400 * r.random() ** 3)}" for _ in range(r.choice([1, 3, 12]))) for _ in range(12)] + ["", "unknown", "w0 w0 w1"]
    return spark.createDataFrame([(kb, i, t) for i, t in enumerate(texts) for kb in ("k", "other", "none")], "kb string, query_id int, text string")


def ranked(df):
    return sorted((r.kb, r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("n, seed", [(1, 1), (3, 2), (500, 3)])
def test_pruned_search_is_exact(spark, tmp_path, n, seed):
    docs, queries = corpus(spark, 250, seed), asked(spark, seed)
    po.write_postings(docs, str(tmp_path / "ix"), docs_per_bucket=40)
    stored = po.read_postings(spark, str(tmp_path / "ix"))
    assert stored.buckets == 7
    assert ranked(po.stored_topk(queries, stored, n)) == ranked(bm25_topk(queries, lexical_index(docs), n))


def test_negative_weights_and_tiny_bases(spark, tmp_path):
    rows = [("a", "x", "one two"), ("a", "y", "one two"), ("b", "z", "one"), ("c", "u", ""), ("d", "p", "one one"), ("d", "q", "one"), ("d", "r", "two")]
    docs = spark.createDataFrame(rows, "kb string, doc_id string, document string")
    queries = spark.createDataFrame([(kb, 1, "one two") for kb in "abcde"], "kb string, query_id int, text string")
    stored = po.write_postings(docs, str(tmp_path / "ix"))
    assert ranked(po.stored_topk(queries, stored, 1)) == ranked(bm25_topk(queries, lexical_index(docs), 1))


def test_common_words_are_read_for_few_documents_and_postings_stay(spark, tmp_path):
    rows = [("k", f"d{i:04d}", "the of and the of and " * 3 + f"rare{i // 8} " * 2) for i in range(800)]
    docs = spark.createDataFrame(rows, "kb string, doc_id string, document string")
    queries = spark.createDataFrame([("k", i, f"the of and rare{i}") for i in range(5)], "kb string, query_id int, text string")
    stored = po.write_postings(docs, str(tmp_path / "ix"))
    counts = po.postings_scored(queries, stored, 3).first()
    assert counts.n_matched == 5 * (3 * 800 + 8) and counts.n_scored < counts.n_matched / 20
    found = po._divided(queries, stored, 3)
    plan = po._parts(stored.postings, found.heavy, True).groupBy("kb", "query_id", "doc_id").agg(F.sum("part"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan
    assert ranked(po.stored_topk(queries, stored, 3)) == ranked(bm25_topk(queries, lexical_index(docs), 3))


def test_empty_base(spark, tmp_path):
    docs = spark.createDataFrame([], "kb string, doc_id string, document string")
    stored = po.write_postings(docs, str(tmp_path / "ix"))
    assert po.stored_topk(asked(spark, 1), stored, 3).count() == 0


@pytest.mark.parametrize("terms_at_once, at_once", [(400_000, 1_000_000), (20, 3)])
def test_pairs_in_play_are_summed_where_their_document_is(spark, tmp_path, monkeypatch, terms_at_once, at_once):
    """Words of nearly equal weight leave most pairs in play: they are not written, and not met with all their document's words."""
    docs, queries = corpus(spark, 250, 5), asked(spark, 5)
    stored = po.write_postings(docs, str(tmp_path / "ix"))
    met = []
    monkeypatch.setattr(po, "_of_pairs", lambda ix, pairs, *rest, was=po._of_pairs: met.append(pairs.count()) or was(ix, pairs, *rest))
    monkeypatch.setattr(po, "TERMS_AT_ONCE", terms_at_once, raising=False)
    monkeypatch.setattr(rt, "HITS", at_once)
    got = ranked(po.stored_topk(queries, stored, 3))
    assert sum(met) <= queries.count() * 2 * 3
    monkeypatch.undo()
    assert got == ranked(bm25_topk(queries, lexical_index(docs), 3))


def test_light_words_count_only_where_the_others_reach():
    doc, query = np.array([4, 4, 4, 7, 7]), np.array([0, 0, 1, 0, 1])
    part, heavy = np.array([2.0, 0.5, 0.5, 0.5, 3.0]), np.array([True, False, False, False, True])
    rest, bar = np.array([0.6, 0.6]), np.array([2.5, -np.inf])
    assert rt._in_play(doc, query, part, heavy, rest, bar).tolist() == [True, True, True, False, True]
    far = np.append(query[:-1], 1) * 1_000_000  # few of many queries are met
    wide = lambda x: np.where(np.arange(1_000_001) == 0, x[0], x[1])
    assert rt._in_play(doc, far, part, heavy, wide(rest), wide(bar)).tolist() == [True, True, True, False, True]
