"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import vector_index as vi
from dossier.operators import vectors
from dossier.operators.vectors import vector_topk, vector_topk_by_type

DOC = "kb string, doc_id string, type string, embedding array<float>"


def clustered(spark, n=600, hot=0.5):
    """Vectors around 12 centres in three bases; base 007 holds about half of them."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8)) * 4
    rows = []
    for i in range(n):
        v = centres[i % 12] + r.normal(size=8)
        base = "007" if r.random() < hot else ("b", None)[i % 2]
        rows.append((base, f"d{i:04d}", "table" if i % 3 else "text_chunk", [float(x) for x in v]))
    rows += [("007", "none", "table", None), ("lone", "one", "table", [1.0] * 8), ("007", "twin", "table", rows[0][3]), ("007", "twin2", "table", rows[0][3])]
    return spark.createDataFrame(rows, DOC)


def asked_of(docs):
    return docs.filter("embedding is not null").select(F.coalesce("kb", F.lit("main")).alias("kb"), F.col("doc_id").alias("query_id"), "embedding")


def exact_rows(df):
    return sorted((r.kb, r.query_id, r.doc_id, r.seq) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_all_lists_give_the_exact_answer(spark, tmp_path, metric):
    docs = clustered(spark)
    vi.write_vector_index(vi.vector_index(docs, metric), str(tmp_path / "ix"))
    index = vi.read_vector_index(spark, str(tmp_path / "ix"))
    named = docs.withColumn("kb", F.coalesce("kb", F.lit("main")))
    assert exact_rows(vi.indexed_topk(asked_of(docs), index, 5)) == exact_rows(vector_topk(asked_of(docs), named, 5, metric))
    by_type = vi.indexed_topk(asked_of(docs), index, 4, "text_chunk")
    assert exact_rows(by_type) == exact_rows(vector_topk_by_type(asked_of(docs), named, "text_chunk", 4, metric))


def test_few_lists_hold_most_neighbours_and_only_they_are_read(spark, tmp_path):
    docs = clustered(spark)
    built = vi.calibrated(vi.vector_index(docs), 5, 0.95, sample=1000)
    vi.write_vector_index(built, str(tmp_path / "ix"))
    index = vi.read_vector_index(spark, str(tmp_path / "ix"))
    assert index.probe == built.probe < 8
    named = docs.withColumn("kb", F.coalesce("kb", F.lit("main")))
    got = vi.recall(vector_topk(asked_of(docs), named, 5), vi.indexed_topk(asked_of(docs), index, 5), ("kb", "query_id")).first()
    assert got.recall >= 0.9
    one = asked_of(docs).filter("query_id = 'd0000'")
    read = vi.probed_lists(index, vi.probed(one, index, 2))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert read.select("kb", "list").distinct().count() == 2


def test_rows_meet_their_nearest_centroid_in_blocks_too(spark, monkeypatch):
    docs = clustered(spark, 200)
    index = vi.vector_index(docs)
    want = {(r.kb, r.doc_id): r.list for r in index.lists.collect()}
    centroids = {}
    for r in index.centroids.collect():
        centroids.setdefault(r.kb, {})[r.list] = np.array(r.centroid)
    for r in index.lists.collect():
        away = {c: ((np.array(r.embedding) - m) ** 2).sum() for c, m in centroids[r.kb].items()}
        assert away[r.list] == pytest.approx(min(away.values()))
    monkeypatch.setattr(vi, "MAX_CENTROID_FLOATS", 0)
    monkeypatch.setattr(vi, "BLOCK_FLOATS", 80)
    again = vi.nearest_lists(vi._based(docs).filter("embedding is not null"), index.centroids, 1)
    assert {(r.kb, r.doc_id): r.list for r in again.collect()} == want


def test_empty_and_tiny_bases(spark):
    none = spark.createDataFrame([], DOC)
    index = vi.calibrated(vi.vector_index(none), 3)
    asked = spark.createDataFrame([("x", 1, [0.5] * 8)], "kb string, query_id int, embedding array<float>")
    assert vi.indexed_topk(asked, index, 3).count() == 0
    tiny = spark.createDataFrame([("x", "a", "t", [0.0] * 8), ("x", "b", "t", [0.0] * 8)], DOC)
    found = vi.indexed_topk(asked, vi.vector_index(tiny), 3)
    assert [(r.doc_id, r.seq) for r in found.orderBy("seq").collect()] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("metric, blocks", [("l2sq", (4_000, 40_000)), ("cosine", (7, 11))])
def test_own_ranks_equal_a_full_sort(spark, metric, blocks):
    from dossier.operators.vectors import own_ranks

    docs = clustered(spark, 120).withColumn("kb", F.coalesce("kb", F.lit("main")))
    rows = [r for r in docs.collect()]
    asked = [(r.kb, r.doc_id, r.doc_id if i % 9 else "unknown", [x + 0.3 * (i % 4) for x in r.embedding] if r.embedding else None) for i, r in enumerate(rows)]
    got = {(r.kb, r.query_id): r.rank for r in own_ranks(spark.createDataFrame(asked, "kb string, query_id string, own string, embedding array<float>"), docs, metric, *blocks).collect()}

    def away(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return ((a - b) ** 2).sum() if metric == "l2sq" else 1 - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))

    for kb, query, own, vector in asked:
        order = sorted((away(r.embedding, vector), r.doc_id) for r in rows if r.kb == kb and r.embedding and vector)
        want = next((n for n, (_, name) in enumerate(order, 1) if name == own), None)
        assert got[kb, query] == want or vector and order[got[kb, query] - 1][0] == pytest.approx(order[want - 1][0], abs=1e-12)


def test_queries_of_all_lists_are_not_written_for_each_list(spark, tmp_path, monkeypatch):
    docs = clustered(spark)
    index = vi.vector_index(docs)
    monkeypatch.setattr(vi, "probed", lambda *a: pytest.fail("queries written for each list"))
    named = docs.withColumn("kb", F.coalesce("kb", F.lit("main")))
    assert exact_rows(vi.indexed_topk(asked_of(docs), index, 5, probe=vi.ALL_LISTS)) == exact_rows(vector_topk(asked_of(docs), named, 5))


def test_the_best_are_merged_tile_by_tile(monkeypatch):
    r = np.random.default_rng(3)
    queries, docs = r.integers(0, 3, (70, 4)).astype(float), r.integers(0, 3, (500, 4)).astype(float)
    names = np.array([f"d{i:03d}" for i in r.permutation(500)], dtype=object)
    monkeypatch.setattr(vectors, "TILE_DOCS", 37)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 16)
    best = vectors._Best(queries, [vectors.Pool("all", 9)], "l2sq")
    best.add(names, np.array(["table"] * 500, dtype=object), docs)
    assert len(best.kept) == 5 and max(len(q) for q, _, _ in best.kept.values()) == 16 * 9
    found = {}
    for frame in best.frames("a", np.arange(70)):
        for q, name in zip(frame["query_id"], frame["doc_id"]):
            found.setdefault(q, []).append(name)
    for q, names_found in found.items():
        away = ((docs - queries[q]) ** 2).sum(axis=1)
        assert names_found == [n for _, n in sorted(zip(away, names))[:9]]
    assert len(found) == 70


@pytest.mark.parametrize("scale", [0.0, 40.0])
def test_ranks_compare_equal_and_far_vectors_in_groups(monkeypatch, scale):
    r = np.random.default_rng(9)
    docs = np.concatenate([r.integers(0, 3, (900, 5)), r.integers(0, 3, (300, 5)) + scale]).astype(float)
    names = np.array([f"d{i % 700:04d}" for i in r.permutation(1200)], dtype=object)
    own = r.integers(0, 1200, 200)
    queries = docs[own] + r.integers(0, 2, (200, 5))
    away = ((docs[own] - queries) ** 2).sum(axis=1)
    monkeypatch.setattr(vectors, "LEAF", 16)
    near = vectors._Nearer(docs, names, "l2sq")
    compared = []
    monkeypatch.setattr(vectors._Nearer, "_compared", lambda self, lo, hi, q, *rest, was=vectors._Nearer._compared: compared.append((hi - lo) * len(q)) or was(self, lo, hi, q, *rest))
    got = near.count(queries, away, names[own])
    far = ((docs[None] - queries[:, None]) ** 2).sum(axis=2)
    assert got.tolist() == [int(((f < a) | ((f == a) & (names < n))).sum()) for f, a, n in zip(far, away, names[own])]
    assert sum(compared) < 200 * 1200 / 2


def test_calibration_holds_for_each_pool(spark):
    """The nearest of all types are copies in one list; the nearest tables stand elsewhere."""
    r = np.random.default_rng(4)
    rows = [("main", f"d{i}_{c}", "text_chunk" if i % 4 else "table", [float(x) for x in v]) for i, v in enumerate(r.normal(size=(60, 4))) for c in range(6)]
    docs = spark.createDataFrame(rows, DOC)
    built, pools = vi.vector_index(docs), [vectors.Pool("all", 5), vectors.Pool("table", 5, "table")]
    index = vi.calibrated(built, 5, 0.95, 1000, pools)
    exact, found = vectors.vector_pools(asked_of(docs), docs, pools), vi.indexed_pools(asked_of(docs), index, pools)
    for p in pools:
        assert vi.recall(exact.filter(F.col("channel") == p.channel), found.filter(F.col("channel") == p.channel), ("kb", "query_id")).first().recall >= 0.9
    assert vi.calibrated(built, 5, 0.95, 1000).probe < index.probe


def test_recall_asks_every_vector(spark, tmp_path):
    from dossier.plans.catalog_indexes import vector_index_recall

    rows = [(i, [float(i % 7), float(i % 11)], i % 10) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.channel: (r.n_exact, r.recall_reached) for r in vector_index_recall(spark, str(tmp_path)).collect()}
    assert got == {"all": (1200, True), "table": (1200, True)}


def test_ranks_in_a_large_base_meet_open_lists_only(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows, asked, want = [], [], {}
    for kb, n in (("", 300), ("main", 120), ("one", 1)):
        docs = r.integers(0, 4, (n, 5)).astype("float64") + 20 * r.integers(0, 3, (n, 1))
        queries = docs + r.integers(0, 2, (n, 5))
        names = [f"d{i:03d}" for i in range(n)]
        far = ((docs[None] - queries[:, None]) ** 2).sum(axis=2)
        for i in range(n):
            rows.append((kb, names[i], [float(x) for x in docs[i]]))
            asked.append((kb, f"q{i}", names[i], [float(x) for x in queries[i]]))
            want[kb, f"q{i}"] = 1 + int(((far[i] < far[i, i]) | ((far[i] == far[i, i]) & (np.array(names) < names[i]))).sum())
    asked.append(("main", "lost", "nobody", [0.0] * 5))
    docs = spark.createDataFrame([*rows, (None, "d0", [1.0] * 5)], "kb string, doc_id string, embedding array<float>")
    queries = spark.createDataFrame(asked, "kb string, query_id string, own string, embedding array<float>")
    monkeypatch.setattr(vectors, "ROUTED_ROWS", 0, raising=False)
    monkeypatch.setattr(vectors, "LISTS", 6, raising=False)
    monkeypatch.setattr(vectors, "_met_blocks", lambda *a: pytest.fail("every block of documents shown to every query"))
    got = {(x.kb, x.query_id): x.rank for x in vectors.own_ranks(queries, docs, query_rows=50, doc_rows=30).collect()}
    assert got == want | {("main", "lost"): None}


@pytest.mark.parametrize("metric, probe", [("l2sq", 1), ("l2sq", 4), ("cosine", 3)])
def test_many_queries_are_written_for_blocks_of_lists(spark, monkeypatch, metric, probe):
    r = np.random.default_rng(6)
    rows = [(("", "a")[i % 3 == 0], f"d{i:03d}", ("table", "text_chunk")[i % 2], [float(x) for x in r.integers(0, 5, 4)]) for i in range(240)]
    docs = spark.createDataFrame(rows, DOC)
    index, pools = vi.vector_index(docs, metric), [vectors.Pool("all", 5), vectors.Pool("table", 3, "table")]
    key = lambda df: sorted((x.kb, x.query_id, x.channel, x.seq, x.doc_id, round(x.distance, 9)) for x in df.collect())
    with monkeypatch.context() as m:
        m.setattr(vi, "_by_list_blocks", lambda *a, **k: None, raising=False)
        want = key(vi.indexed_pools(asked_of(docs), index, pools, probe))
    monkeypatch.setattr(vi, "probed", lambda *a: pytest.fail("queries written for each list"))
    got = key(vi.indexed_pools(asked_of(docs), index, pools, probe, max_query_rows=40, doc_block_floats=4 * 30))
    assert got == want and len({x[0] for x in got}) == 2
