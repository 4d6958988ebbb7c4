"""An index after several refreshes against one built at once."""

import random

import pytest

from dossier.operators import index_store as st
from dossier.operators.index import lexical_index
from dossier.operators.retrieval import bm25_topk

DOCS = "kb string, doc_id int, document string"


def frame(spark, docs):
    return spark.createDataFrame([(kb, i, t) for (kb, i), t in docs.items()], DOCS)


def table(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def same(spark, root, docs):
    kept, built = st.open_index(spark, root), lexical_index(frame(spark, docs))
    assert table(kept.postings, "kb", "doc_id", "doc_len", "token", "tf") == table(built.postings, "kb", "doc_id", "doc_len", "token", "tf")
    assert table(kept.terms, "kb", "token", "df", "idf") == table(built.terms, "kb", "token", "df", "idf")
    assert table(kept.stats, "kb", "n_docs", "avg_len") == table(built.stats, "kb", "n_docs", "avg_len")
    asked = spark.createDataFrame([(kb, q, f"w{q} w{q + 1} w3") for kb in ("007", "b") for q in range(6)], "kb string, query_id int, text string")
    ranked = lambda ix: table(bm25_topk(asked, ix, 5), "kb", "query_id", "rank", "doc_id", "score")
    assert ranked(kept) == ranked(built)


def test_refreshes_equal_a_full_build(spark, tmp_path):
    root, r = str(tmp_path / "ix"), random.Random(4)
    text = lambda: " ".join(f"w{int(30 * r.random() ** 2)}" for _ in range(r.choice([0, 1, 8, 20])))
    docs = {(kb, i): text() for kb in ("007", "b") for i in range(30)}
    st.refresh_index(spark, root, frame(spark, docs))
    same(spark, root, docs)
    changed = {("007", i): text() for i in range(20, 40)}  # ten changed, ten new
    gone = [("b", i) for i in range(5)] + [("b", 999), ("none", 1), ("007", 25)]  # the last is given as well
    st.refresh_index(spark, root, frame(spark, changed), spark.createDataFrame(gone, "kb string, doc_id int"))
    docs = {k: t for k, t in (docs | changed).items() if k not in gone[:5]}
    same(spark, root, docs)
    st.compact_index(spark, root)
    same(spark, root, docs)
    last = {("b", i): text() for i in range(3)}  # removed ones come back
    everything = [k for k in docs if k[0] == "007"]
    st.refresh_index(spark, root, frame(spark, last), spark.createDataFrame(everything, "kb string, doc_id int"))
    same(spark, root, {k: t for k, t in (docs | last).items() if k[0] == "b"})


def test_a_failed_refresh_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ix")
    docs = {("007", 1): "one two", ("007", 2): "two three"}
    st.refresh_index(spark, root, frame(spark, docs))

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(st, "_commit", fails)
    with pytest.raises(RuntimeError):
        st.refresh_index(spark, root, frame(spark, {("007", 1): "other"}))
    monkeypatch.undo()
    same(spark, root, docs)
    st.refresh_index(spark, root, frame(spark, {("007", 2): "four"}))
    same(spark, root, docs | {("007", 2): "four"})
