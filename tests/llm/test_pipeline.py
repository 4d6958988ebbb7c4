import re

import pytest

import __spark_entry__
import corpus_pipeline
from dossier.llm import pii, quality
from dossier.llm.common import cut, table
from tests.llm.frames import crowded
from tests.llm.test_dart_minhash import brute_classes
from tests.llm.test_decontaminate import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and what each stage makes of it."""
    docs = crowded(table(spark, SF, "documents"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return out


def test_every_stage_against_brute_force(spark, stages):
    given = [[r.asDict() for r in df.collect()] for df in stages]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    model = quality.train(stages[0], table(spark, SF, "labels"))
    scores = model.score(__import__("numpy").array([quality.features(r["text"]) for r in given[0]]))
    assert sorted(r["doc_id"] for r in given[1]) == sorted(r["doc_id"] for r, s in zip(given[0], scores) if s >= quality.THRESHOLD)
    before = sorted(given[1], key=lambda r: r["doc_id"])
    kept = [r["doc_id"] for r, c in zip(before, brute_classes([r["text"] for r in before])) if before[c]["doc_id"] == r["doc_id"]]
    assert sorted(r["doc_id"] for r in given[2]) == kept and len(kept) < len(before)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = sorted(r["doc_id"] for r in given[2] if not brute(r["text"], items)[-1])
    assert sorted(r["doc_id"] for r in given[3]) == clean and len(clean) < len(given[2])
    finder, texts = pii.Finder(), {r["doc_id"]: r["text"] for r in given[3]}
    for r in given[4]:
        assert r["text"] == pii.redact(texts[r["doc_id"]], finder.spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    assert len(given[5]) == len(given[4]) == len(given[3])
    assert {r["doc_id"]: r["size"] for r in given[5]} == {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in given[4]}


def test_run_gives_the_last_stage(spark, stages):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1].collect()))


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        assert docs.count() == 0


def test_null_and_repeated_rows_run_through(spark):
    docs = table(spark, SF, "documents").limit(30)
    odd = docs.union(docs.limit(5)).union(docs.limit(3).selectExpr("cast(null as long)", "text", "null", "null", "null"))
    odd = cut(odd.union(docs.limit(2).selectExpr("doc_id + 100000", "cast(null as string)", "lang", "source", "n_chars")))
    for _, stage in corpus_pipeline.STAGES:
        odd = cut(stage(spark, odd, SF))
    assert odd.count() > 10


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)

