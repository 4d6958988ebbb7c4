"""Index and retrieval against brute force."""

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from dossier.config import RetrievalConfig, TextConfig
from dossier.operators import index as ix
from dossier.operators import retrieval as rt
from dossier.operators import vectors as vx
from dossier.functions.text import CODE_PATTERN
from dossier.plans import inputs
from dossier.plans.retrieve import attach_evidence, candidates, retrieve


def test_bm25_equals_the_formula(spark):
    rnd = random.Random(2)
    vocab = ["the", "store", "wall", "gap", "1.2", "HD 1.1", "x_1", "é"]
    docs = [(f"d{i:02d}", " ".join(rnd.choices(vocab, weights=[9, 3, 3, 2, 1, 1, 1, 1], k=rnd.randint(0, 12)))) for i in range(40)]
    docs += [(f"d{i:02d}", docs[0][1]) for i in range(40, 45)]  # copies must tie by id
    queries = [(0, "the wall the gap"), (1, "HD 1.1 store"), (2, "nothing"), (3, "the")]

    def toks(t):
        codes = re.findall(r"\b(?:[A-Z]{1,4}[\s-]?)?\d+(?:\.\d+)+\b", t)
        return [w.lower() for w in re.findall(r"\w+", t)] + [c.lower() for c in {re.sub(r"[\s-]+", "", c).upper() for c in codes}]

    bags = {d: toks(t) for d, t in docs}
    n, avg = len(docs), sum(map(len, bags.values())) / len(docs)
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    want = set()
    for q, t in queries:
        scores = {}
        for d, b in bags.items():
            s = sum(idf.get(w, 0) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in toks(t))
            if round(s, 9) > 0:
                scores[d] = round(s, 9)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        want |= {(q, d, k, round(s, 6)) for k, (d, s) in enumerate(best, 1)}
    d = spark.createDataFrame([("k", *x) for x in docs] + [("other", "z", "the wall")], "kb string, doc_id string, document string")
    q = spark.createDataFrame([("k", *x) for x in queries], "kb string, query_id int, text string")
    got = rt.bm25_topk(q, ix.lexical_index(d), 5).collect()
    assert {(r.query_id, r.doc_id, r.rank, round(r.score, 6)) for r in got} == want


def test_neighbours_are_exact_in_memory_and_in_blocks(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(120, 6)).astype("float32")
    d[60:80] = d[3]  # a third of a group are copies
    q = rng.normal(size=(9, 6)).astype("float32")
    types = ["table" if i % 3 == 0 else "text_chunk" for i in range(120)]
    docs = spark.createDataFrame([(f"d{i:03d}", types[i], d[i].tolist()) for i in range(120)], "doc_id string, type string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(9)], "query_id int, embedding array<float>")
    pools = [vx.Pool("all", 7), vx.Pool("tab", 4, "table")]
    for metric in ("l2sq", "cosine"):
        want = set()
        for i in range(9):
            a, b = q[i].astype("float64"), d.astype("float64")
            dist = ((b - a) ** 2).sum(1) if metric == "l2sq" else 1 - (b * a).sum(1) / np.sqrt((b * b).sum(1) * (a * a).sum())
            order = sorted(range(120), key=lambda j: (round(dist[j], 12), j))
            want |= {(i, "all", f"d{j:03d}", k) for k, j in enumerate(order[:7], 1)}
            want |= {(i, "tab", f"d{j:03d}", k) for k, j in enumerate([j for j in order if types[j] == "table"][:4], 1)}
        for limits in ({}, {"max_query_rows": 4, "doc_block_floats": 150}):
            got = vx.vector_pools(queries, docs, pools, metric, **limits).collect()
            assert {(r.query_id, r.channel, r.doc_id, r.seq) for r in got} == want
    assert vx.vector_topk(queries.filter("false"), docs, 3).count() == 0


def test_table_floor_and_slots(spark):
    def ranked(types, scores):
        return spark.createDataFrame(
            [("k", 1, "narrow", f"n{i}", t, s, i + 1) for i, (t, s) in enumerate(zip(types, scores))],
            "kb string, query_id int, channel string, doc_id string, type string, norm_score double, rank int",
        )

    x, t = "text_chunk", "table"
    lifted = rt.table_floor(ranked([x, x, t, x, x, x], [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]), 2).orderBy("rank").collect()
    assert [r.doc_id for r in lifted] == ["n0", "n2", "n1", "n3", "n4", "n5"]
    low = rt.table_floor(ranked([x, x, x, x, t], [6.0, 5.0, 4.0, 3.0, 2.0]), 2).orderBy("rank").collect()
    assert [r.doc_id for r in low] == ["n0", "n1", "n2", "n3", "n4"]
    narrow = ranked([x, t, x], [3.0, 2.0, 1.0])
    wide = spark.createDataFrame([("k", 1, "wide", "w0", x, 9.0, 1)], narrow.schema)
    mixed = rt.mixed_slot_fill(narrow, wide, 3).orderBy("final_rank").collect()
    assert [r.doc_id for r in mixed] == ["w0", "n1", "n2"]
    split = rt.split_topk(narrow, wide.filter("false"), 1).orderBy("final_rank").collect()
    assert [r.doc_id for r in split] == ["n1", "n0"]


KB = ("kb string, doc_id string, type string, embedding array<float>, table_name string, display_name string, chunk_id string, "
      "title string, section_path string, document string, serialized string, content string, html string, notes string, legend string, "
      "footnotes string, img_path string, page_idx int, synth int")


def small_kb(spark):
    rows = []
    for i in range(12):
        tab = i % 3 == 0
        text = f"rule {i} for HD 1.{i}"
        rows.append(("k", f"d{i:02d}", "table" if tab else "text_chunk", [float(i), 0.0], f"Table {i}" if tab else "", f"Table {i}" if tab else "",
                     "" if tab else f"chunk_p{i}_idx{i}", "" if tab else f"T{i}", "", text, text if tab else "", "" if tab else text, "", "", "", "", "", i, 0))
    return spark.createDataFrame(rows, KB)


def test_retrieve_with_and_without_scorer(spark):
    kb = small_kb(spark)
    queries = spark.createDataFrame([("k", 1, "what about HD 1.7", [7.2, 0.0])], "kb string, query_id int, text string, embedding array<float>")
    score = lambda p: p.withColumn("rerank_score", -F.coalesce("distance", F.lit(99.0)))
    got = retrieve(queries, kb, score, RetrievalConfig(top_k=2)).orderBy("final_rank").collect()
    assert [(r.doc_id, r.type) for r in got] == [("d06", "table"), ("d09", "table"), ("d07", "text_chunk"), ("d08", "text_chunk")]
    assert {r.doc_id: r.code_score for r in got} == {"d06": 0.0, "d09": 0.0, "d07": 1.0, "d08": 0.0}
    plain = retrieve(queries, kb, None, RetrievalConfig(top_k=2)).orderBy("final_rank").collect()
    assert [r.doc_id for r in plain] == ["d07", "d08"]
    context = rt.format_context(attach_evidence(retrieve(queries, kb, score, RetrievalConfig(top_k=1)), kb)).first().context
    assert context == "[TABLE] Table 6\n\nrule 6 for HD 1.6\n\n" + "=" * 60 + "\n\n[TEXT] T7\n\n[CONTENT]\nrule 7 for HD 1.7"
    assert retrieve(queries, kb.filter("false"), score).count() == 0


def test_evidence_comes_from_the_own_base_only(spark):
    """Two bases with the same ids: each query is answered as if its base were alone."""
    one = small_kb(spark)
    far = F.transform("embedding", lambda x: (x * 3 + 1).cast("float"))
    two = one.withColumns({"kb": F.lit("other"), "embedding": far, "document": F.concat("document", F.lit(" HD 1.7"))})
    text = "what about HD 1.7"
    queries = spark.createDataFrame(
        [("k", 1, text, [7.2, 0.0]), ("other", 1, text, [7.2, 0.0]), ("k", 2, "rule 3", [2.0, 1.0]), ("none", 1, text, [1.0, 1.0])],
        "kb string, query_id int, text string, embedding array<float>",
    )
    score = lambda p: p.withColumn("rerank_score", -F.coalesce("distance", F.lit(99.0)))
    cfg = RetrievalConfig(top_k=2)
    rows = lambda q, kb: sorted((r.kb, r.query_id, r.final_rank, r.doc_id, r.key) for r in retrieve(q, kb, score, cfg).collect())
    alone = rows(queries.filter("kb = 'k'"), one) + rows(queries.filter("kb = 'other'"), two)
    both = one.unionByName(two)
    assert rows(queries, both) == sorted(alone) and {r[0] for r in alone} == {"k", "other"}
    shown = attach_evidence(retrieve(queries, both, score, cfg), both)
    assert shown.count() == len(alone)
    assert {r.kb for r in rt.format_context(shown).collect()} == {"k", "other"}


def test_ties_keep_document_order(spark):
    docs = spark.createDataFrame([("k", f"chunk_p{i}", "same words", i) for i in (2, 10, 1)], "kb string, doc_id string, document string, doc_order int")
    others = spark.range(9).select(F.lit("k").alias("kb"), F.concat(F.lit("x"), "id").alias("doc_id"), F.lit("none").alias("document"), F.col("id").cast("int").alias("doc_order"))
    index = ix.lexical_index(docs.unionByName(others))
    queries = spark.createDataFrame([("k", 1, "same words")], "kb string, query_id int, text string")
    got = [r.doc_id for r in rt.bm25_topk(queries, index, 5).orderBy("rank").collect()]
    assert got == ["chunk_p1", "chunk_p2", "chunk_p10"]


def test_kb_documents_windows_and_questions(spark):
    chunks = spark.createDataFrame(
        [("k", "chunk_p1_idx5", "B", ["A", "B"], "B\nline one\nline two", 1, 5)],
        "kb string, chunk_id string, title string, section_path array<string>, content string, page_idx int, start_idx long",
    )
    tables = spark.createDataFrame(
        [("k", 3, 0, "T", "T", "prose", "<x>", "", "", ["n"], [])],
        "kb string, table_idx long, page_idx int, table_name string, display_name string, serialized string, html string, img_path string, "
        "legend string, notes array<string>, footnotes array<string>",
    )
    raw = spark.createDataFrame([("k", "chunk_p1_idx5", "- 1. Is this long enough?\nno question here at all\n* short?\n2) And what about that one?\nWhat is the third one here?")],
                                "kb string, chunk_id string, raw string")
    questions = ix.attach_questions(raw, 2)
    assert [r.question for r in questions.orderBy("question_no").collect()] == ["Is this long enough?", "And what about that one?"]
    assert ix.chunks_to_do(chunks, raw).count() == 0
    docs = ix.kb_documents(tables, chunks, questions, TextConfig(window_max_chars=12))
    got = {r.doc_id: (r.document, r.synth) for r in docs.collect()}
    assert got["table_p0_idx3"] == ("T\nprose", 0)
    assert got["chunk_p1_idx5__w0"] == ("A > B\nB\nB\nline one", 0) and got["chunk_p1_idx5__w1"] == ("A > B\nB\nline two", 0)
    assert got["chunk_p1_idx5__q1"] == ("And what about that one?", 1)
    assert [r.doc_id for r in docs.orderBy("doc_order").collect()][0] == "table_p0_idx3"
    assert ix.duplicate_ids(docs).count() == 0
    load = lambda route: (lambda texts: np.array([[len(t), float(route == "english")] for t in texts]))
    assert {tuple(r.embedding) for r in ix.embed(docs.filter("type = 'table'"), load).collect()} == {(7.0, 1.0)}


def test_searches_run_once_and_texts_stay_where_they_are(spark):
    asked = spark.createDataFrame([("a", 1, "alpha beta 1.2", [1.0, 0.0])], "kb string, query_id long, text string, embedding array<float>")
    found = candidates(asked, small_kb(spark).withColumn("kb", F.lit("a")), RetrievalConfig(top_k=2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "regexp_extract_all(document" not in plan


def test_a_text_is_hashed_once_for_its_vector(spark):
    df = spark.createDataFrame([("some text",), (None,), ("",)], "t string")
    expr = inputs.text_vector(F.col("t"))
    got = [r[0] for r in df.select(expr).collect()]
    digits = hashlib.md5(b"some text").hexdigest() + hashlib.md5(b"xsome text").hexdigest()
    assert np.allclose(got[0], [(int(c, 16) + 1 - 8.5) / 40 for c in digits]) and len(got[2]) == 64
    assert got[1] == [None] * 64
    # only the outer transform, over one element, reads the hashes: what stands behind its places doesn't
    assert "md5" not in expr._jc.toString().split("sequence(1, 64)", 1)[1]


def test_codes_are_those_of_the_plain_pattern(spark):
    plain = r"(?U)\b(?:[A-Z]{1,4}[\s-]?)?\d+(?:\.\d+)+\b|\b[A-Z]{1,4}[\s-]?\d+\b|\bGroup\s+[A-Z]\b"
    texts = ["HD 1.1 and T4", "xHD1.2 1.2.3.", "Group K, Group  Z9", "ABCDE 12", "É1.2 ٣.٤ A-٣", "", None, "1. 2.3a", "AT4 T4-5 T-5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(CODE_PATTERN), F.lit(0)).alias("b")).collect():
        assert r.a == r.b
