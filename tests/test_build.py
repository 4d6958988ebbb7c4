"""From blocks to a searchable base, on hand-made blocks of two standards."""

from pyspark.sql import functions as F

from dossier.config import RetrievalConfig, TextConfig
from dossier.operators.index import lexical_index
from dossier.plans import build
from dossier.plans.build import build_kb, encode_queries
from dossier.plans.retrieve import attach_evidence, retrieve
from dossier.sources.blocks import BLOCK

BLOCKS = "standard_id string, block_idx long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BLOCK.fields)
CELLS = [["Kind", "1.1", "1.2"], ["1.1", "", "X"], ["1.2", "X", ""], ["1.3", "X", "X"]]


def html(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def standard(name, word):
    rows = [
        ("text", "1 Storage", 1, 0, None, None), ("text", f"Walls of {word} keep stores apart and are checked every year by hand.", None, 0, None, None),
        ("table", None, None, 0, html(CELLS), [f"Mixing {word}"]), ("table", None, None, 1, html(CELLS), []),
        ("text", "2 Transport", 1, 2, None, None), ("text", f"Trucks with {word} stand in the yard, and nobody smokes near them.", None, 2, None, None),
    ]
    return [(name, i, t, text, level, page, [], body, caption or [], [], "") for i, (t, text, level, page, body, caption) in enumerate(rows)]


def encode(df, text):
    return df.withColumn("embedding", F.array(F.length(text).cast("float"), (F.col("route") == "english").cast("float")))


def test_base_is_built_and_searched(spark):
    blocks = spark.createDataFrame(standard("a", "brick") + standard("b", "clay"), BLOCKS)
    asked = spark.createDataFrame([("a", "chunk_p0_idx0", "Which walls keep stores apart here?")], "kb string, chunk_id string, raw string")
    docs = build_kb(blocks, encode, asked, TextConfig(questions_per_chunk=1)).cache()
    ids = {(r.kb, r.doc_id) for r in docs.collect()}
    # Both parts of the table are one document; the question belongs to one base only; the same ids occur in both.
    assert ids == {(k, d) for k in "ab" for d in ("table_p0_idx2", "chunk_p0_idx0", "chunk_p2_idx4")} | {("a", "chunk_p0_idx0__q0")}
    table = docs.filter("type = 'table' and kb = 'b'").first()
    assert table.table_name == "Mixing clay" and table.html.count("<table>") == 2 and "Mixing clay" in table.document
    queries = spark.createDataFrame([("a", 1, "walls of brick"), ("b", 1, "walls of clay")], "kb string, query_id int, text string")
    asked = encode_queries(queries, docs, encode)
    found = attach_evidence(retrieve(asked, docs, None, RetrievalConfig(top_k=2), lexical_index(docs)), docs)
    texts = {k: " ".join(r.content + r.serialized for r in found.filter(F.col("kb") == k).collect()) for k in "ab"}
    assert "brick" in texts["a"] and "clay" not in texts["a"] and "clay" in texts["b"] and "brick" not in texts["b"]


def test_a_chunk_with_many_windows_is_written_once(spark, monkeypatch):
    lines = [("text", "1 Storage", 1)] + [("text", f"Line {i} about stores that are kept apart from one another.", None) for i in range(12)]
    rows = [("a", i, t, text, level, 0, [], "", [], [], "") for i, (t, text, level) in enumerate(lines)]
    written = []
    write = build.cut
    monkeypatch.setattr(build, "cut", lambda df: written.append(df.columns) or write(df))
    blocks = spark.createDataFrame(rows, BLOCKS)
    asked = spark.createDataFrame([("a", "chunk_p0_idx0", "Which stores are kept apart here?")], "kb string, chunk_id string, raw string")
    cfg = TextConfig(window_max_chars=120, questions_per_chunk=1)
    docs = build_kb(blocks, encode, asked, cfg)
    found = docs.collect()
    assert len(found) > 5 and {r.content for r in found} == {"\n".join(x[1] for x in lines)}
    assert sum("content" in c for c in written) == 1
    narrow = build_kb(blocks, encode, asked, cfg, contents=False)
    assert narrow.columns == [c for c in docs.columns if c != "content"]
    assert sorted(map(str, narrow.collect())) == sorted(map(str, docs.drop("content").collect()))


def test_sections_given_along_are_not_made_again(spark, monkeypatch):
    from dossier.operators.text import section_chunks

    blocks = spark.createDataFrame(standard("a", "brick") + standard("b", "clay"), BLOCKS)
    asked = spark.createDataFrame([("a", "chunk_p0_idx0", "Which walls keep stores apart here?")], "kb string, chunk_id string, raw string")
    cfg = TextConfig(questions_per_chunk=1, window_max_chars=40)
    want = sorted(map(str, build_kb(blocks, encode, asked, cfg).collect()))
    sections = section_chunks(blocks, cfg.repeat_min_pages, cfg.min_content_chars)
    monkeypatch.setattr(build, "section_chunks", None)
    assert sorted(map(str, build_kb(blocks, encode, asked, cfg, sections=sections).collect())) == want


def test_lines_to_drop_are_found_once_however_often_blocks_are_read(spark, monkeypatch):
    from dossier.operators import text as tx

    rows = [("a", 2 * p + i, "text", t, None, p, [], "", [], [], "") for p in range(6) for i, t in enumerate(("Head", f"Head\nbody {p}"))]
    blocks = spark.createDataFrame(rows, BLOCKS)
    repeated = tx.repeated_lines(blocks, 5)
    kept = tx.strip_repeated_lines(blocks, repeated)
    assert "Generate" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.block_idx, r.content) for r in kept.collect()) == sorted((2 * p + i, (f"body {p}" if i else "")) for p in range(6) for i in range(2))
