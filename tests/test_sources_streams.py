"""Sources, sinks and streams in temporary folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dossier.operators.audit import audit_results
from dossier.operators.index import lexical_index, read_index, write_index
from dossier.plans.inputs import nearness_scorer
from dossier.operators.text import numbered_items
from dossier.plans.retrieve import retrieve
from dossier.sources import kb_versions as kv
from dossier.sources.blocks import bad_shards, placed_blocks, read_blocks, read_shards
from dossier.sources.kb import export_audit, kb_catalog, read_kb, write_kb
from dossier.sources.scenarios import read_scenario_files, read_scenarios
from dossier.streaming import report_items as ri
from dossier.streaming.audit_stream import stream_audit_items, stream_call_rate, stream_kb_refresh
from tests.test_retrieval import small_kb


def test_shards_of_every_shape(spark, tmp_path):
    std = tmp_path / "std1"
    std.mkdir()
    block = lambda t, p: {"type": "text", "text": t, "page_idx": p, "extra": {"ignored": 1}}
    (std / "pages_001-050_content_list.json").write_text(json.dumps([block("a", 0), {"type": "list", "list_items": ["x"], "page_idx": 1}], indent=1))
    (std / "pages_051-100_content_list.json").write_text(json.dumps({"content_list": [block("b", 0)]}))
    (std / "pages_101-150_content_list.json").write_text(json.dumps({"data": {"content_list": [block("c", 2), {"type": "text", "text": "d"}]}}))
    (std / "other.json").write_text("[]")
    got = [(r.standard_id, r.block_idx, r.page_idx, r.type, r.text) for r in read_blocks(spark, str(tmp_path)).orderBy("block_idx").collect()]
    assert got == [("std1", 0, 0, "text", "a"), ("std1", 1, 1, "list", None), ("std1", 2, 50, "text", "b"), ("std1", 3, 102, "text", "c"), ("std1", 4, None, "text", "d")]


def test_scenarios(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"item_no": 1, "text": "q", "expected": "A", "table": "T4"}, {"item_no": 2, "text": "r", "expected": "B", "section": "S", "chunk_id": "chunk_p1_idx2"}]))
    got = {r.item_no: (r.label, r.grp) for r in read_scenarios(spark, str(path)).collect()}
    assert got == {1: ("T4", "T4"), 2: ("chunk_p1_idx2", "S")}


def test_bad_scenario_files_are_named(spark, tmp_path):
    good = json.dumps([{"item_no": "7", "text": 5, "table": "T"}, {"item_no": "x", "text": None}])
    for name, text in {"a": good, "b": good[:-3], "c": "{}", "d": "[1]", "e": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    said = {r.file[-6]: r.reason for r in read_scenario_files(spark, str(tmp_path), "*.json").collect()}
    assert said == {"a": None, "b": "not JSON", "c": "no list of scenarios", "d": "scenario without fields", "e": None}
    rows = read_scenarios(spark, str(tmp_path), "*.json", on_bad="leave_out").orderBy(F.col("item_no").desc_nulls_last()).collect()
    assert [(r.item_no, r.text, r.label, r.grp) for r in rows] == [(7, "5", "T", "T"), (None, None, "?", "?")]
    with pytest.raises(Exception, match="[bcd].json"):
        read_scenarios(spark, str(tmp_path), "*.json").collect()


def test_kb_is_replaced_whole(spark, tmp_path):
    path, kb = str(tmp_path / "kb"), small_kb(spark)
    write_kb(kb.unionByName(kb.withColumn("kb", F.lit("other"))), path)
    assert read_kb(spark, path).count() == 24 and read_kb(spark, path, "table", "k").count() == 4
    write_kb(kb.filter("type = 'text_chunk'").limit(3), path)
    assert (read_kb(spark, path, kb="k").count(), read_kb(spark, path, kb="other").count()) == (3, 12)
    row = kb_catalog(read_kb(spark, path)).filter("kb = 'other'").first()
    assert (row.tables, row.chunks, row.total, row.collection) == (4, 8, 12, "other")
    plan = read_kb(spark, path, "table", "other")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kb" in plan


def test_index_is_stored(spark, tmp_path):
    index = lexical_index(small_kb(spark))
    write_index(index, str(tmp_path / "ix"))
    again = read_index(spark, str(tmp_path / "ix"))
    assert again.postings.count() == index.postings.count() and again.stats.first() == index.stats.first()


def test_audit_results_are_exported(spark, tmp_path):
    items = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "kb string, query_id int, text string")
    matches = small_kb(spark).filter("doc_id in ('d00', 'd01')").withColumns({"query_id": F.lit(1), "final_rank": F.when(F.col("type") == "table", 1).otherwise(2)})
    verdicts = spark.createDataFrame([("k", 1, "COMPLIANT", "ok"), ("k", 2, "COMPLIANT", "ok")], "kb string, query_id int, verdict string, reasoning string")
    contexts = spark.createDataFrame([("k", 1, "ctx")], "kb string, query_id int, context string")
    export_audit(audit_results(items, matches, contexts, verdicts), str(tmp_path / "out"))
    got = {r.query_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [s.name for s in got[1].sources] == ["Table 0", "T1"] and got[1].verdict == "COMPLIANT"
    assert (got[2].verdict, got[2].sources, got[2].context) == ("NOT_EVALUATED", [], "")


def test_streamed_reports_equal_the_batch(spark, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    for r in ("a", "b"):
        rows = [{"report_id": r, "line_no": i, "line": t} for i, t in enumerate(["1. what of HD 1.4", "goes on", "2. and HD 1.8"])]
        (lines / f"{r}.json").write_text("\n".join(map(json.dumps, rows)))
    encode = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(0.0).cast("float")))
    query = stream_audit_items(spark, str(lines), str(tmp_path / "out"), str(tmp_path / "cp"), small_kb(spark), encode, "k", nearness_scorer)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.report_id, r.item_no) for r in got.select("report_id", "item_no").distinct().collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert got.groupBy("query_id").count().filter("count != 6").count() == 0


def test_streamed_kb_and_calls(spark, tmp_path):
    small_kb(spark).write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema(small_kb(spark).schema).parquet(str(tmp_path / "in"))
    stream_kb_refresh(docs, str(tmp_path / "kb"), str(tmp_path / "cp")).awaitTermination()
    assert read_kb(spark, str(tmp_path / "kb")).count() == 12
    spark.range(600).select(F.timestamp_seconds("id").alias("ts"), F.lit("p").alias("provider")).write.parquet(str(tmp_path / "calls"))
    calls = spark.readStream.schema("ts timestamp, provider string").parquet(str(tmp_path / "calls"))
    q = stream_call_rate(calls).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "rate")).option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema("window_start timestamp, window_end timestamp, provider string, n_calls long").parquet(str(tmp_path / "rate"))
    # the watermark stands at 599 - 120 s: exactly the windows that ended by then are out
    rows = {int(r.window_start.timestamp()): r.n_calls for r in got.collect()}
    assert rows == {s: min(60, s + 60) for s in range(-50, 420, 10)}


def test_order_of_more_than_a_thousand_shards(spark, monkeypatch):
    from pyspark.sql import functions as F

    from dossier.plans import catalog_text, inputs

    n = 1_003
    given = spark.range(n).select(
        F.lit("s").alias("standard_id"), F.col("id").alias("block_idx"), F.lit("text").alias("type"), F.col("id").cast("string").alias("text"),
        F.lit(None).cast("int").alias("text_level"), (F.col("id") * 20).cast("int").alias("page_idx"),
        *[F.lit(None).cast("array<string>").alias(c) for c in ("list_items", "table_caption", "table_footnote")],
        *[F.lit(None).cast("string").alias(c) for c in ("table_body", "img_path")],
    )
    monkeypatch.setattr(inputs, "blocks", lambda spark, sf: given)
    read = catalog_text.read_blocks(spark, None).select("standard_id", "block_idx", "text").collect()
    assert sorted(read) == [("s", i, str(i)) for i in range(n)]


def _shard(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_bad_shards_stop_their_standard_and_are_named(spark, tmp_path):
    good = lambda *texts: json.dumps([{"type": "text", "text": t, "page_idx": 0} for t in texts])
    _shard(tmp_path / "whole", "pages_001-050_content_list.json", good("a", "b"))
    _shard(tmp_path / "whole", "pages_051-100_content_list.json", json.dumps({"data": {"content_list": json.loads(good("c"))}}))
    _shard(tmp_path / "whole", "pages_101-150_content_list.json", "[]")
    for name, text in {
        "cutoff": good("x", "y")[:-7], "empty": "", "shape": json.dumps({"pages": []}), "null": json.dumps({"content_list": None}),
        "lost": json.dumps([{"type": "text", "text": "a"}, "lost"]), "word": '"only a word"', "number": "[1, 2]", "bytes": None,
    }.items():
        _shard(tmp_path / name, "pages_001-050_content_list.json", good("first"))
        _shard(tmp_path / name, "pages_051-100_content_list.json", text or "")
    (tmp_path / "bytes" / "pages_051-100_content_list.json").write_bytes(b'[{"text": "\xff"}]')
    _shard(tmp_path / "empty", "pages_101-150_content_list.json", good("third"))  # Spark skips empty files: a gap tells
    _shard(tmp_path / "gap", "pages_001-050_content_list.json", good("first"))
    _shard(tmp_path / "gap", "pages_101-150_content_list.json", good("third"))
    shards = read_shards(spark, str(tmp_path))
    said = {(r.standard_id, r.shard[6:9]): r.reason for r in bad_shards(shards).collect()}
    assert said == {
        ("cutoff", "051"): "not JSON", ("empty", "101"): "pages missing before", ("bytes", "051"): "not JSON", ("shape", "051"): "no list of blocks", ("null", "051"): "no list of blocks",
        ("lost", "051"): "block without fields", ("word", "051"): "no list of blocks", ("number", "051"): "block without fields",
        ("gap", "101"): "pages missing before",
    }
    left = placed_blocks(shards, "leave_out").orderBy("block_idx").collect()
    assert [(r.standard_id, r.block_idx, r.page_idx, r.text) for r in left] == [("whole", 0, 0, "a"), ("whole", 1, 0, "b"), ("whole", 2, 50, "c")]
    with pytest.raises(Exception, match="cutoff|empty|bytes|shape|null|lost|word|number|gap"):
        read_blocks(spark, str(tmp_path)).collect()
    read = read_blocks(spark, str(tmp_path), on_bad="leave_out", ranges=False).filter("standard_id = 'gap'").orderBy("block_idx").collect()
    assert [(r.block_idx, r.page_idx) for r in read] == [(0, 0), (1, 100)]


def test_drifted_fields_are_read(spark, tmp_path):
    blocks = [
        {"type": "list", "list_items": "lone", "page_idx": "3", "text_level": 2.0}, {"type": "table", "table_caption": ["a", 5], "page_idx": None},
        {"text": 17, "list_items": [{"no": "text"}]}, {"type": "text", "text": "", "list_items": []},
    ]
    _shard(tmp_path / "s", "pages_001-050_content_list.json", json.dumps(blocks))
    rows = read_blocks(spark, str(tmp_path)).orderBy("block_idx").collect()
    assert [(r.type, r.text, r.page_idx, r.text_level, r.table_caption) for r in rows] == [
        ("list", None, 3, 2, None), ("table", None, None, None, ["a", "5"]), (None, "17", None, None, None), ("text", "", None, None, None),
    ]
    assert rows[0].list_items == ["lone"] and rows[3].list_items == []


def _steps(spark, tmp_path, steps, start):
    """Each step's lines arrive, then the stream runs to its end and stops; its state goes on."""
    base = dt.datetime(2026, 1, 1)
    for minutes, lines in steps:
        rows = [(r, n, t, base + dt.timedelta(minutes=minutes)) for r, n, t in lines]
        spark.createDataFrame(rows, ri.LINE_SCHEMA).write.mode("append").json(str(tmp_path / "in"))
        start(spark.readStream.schema(ri.LINE_SCHEMA).json(str(tmp_path / "in"))).awaitTermination()


REPORT = [("a", i, t) for i, t in enumerate(["intro", "1. what of HD 1.4", "goes on", "", "2. and HD 1.8", "more", "even more", "3.  third HD", "4. ", "5. last"])]


def test_items_over_three_batches_equal_the_batch(spark, tmp_path):
    other = [("b", 7, "9. only"), ("b", 8, "x")]

    def start(lines):
        with ri.rocksdb_state(spark):
            return ri.stream_report_items(lines).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
                "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    _steps(spark, tmp_path, [(0, REPORT[2::-1]), (1, REPORT[3:6] + other[:1]), (2, REPORT[6:] + other[1:]), (2000, [("end", 0, "x")])], start)
    got = spark.read.schema("report_id string, item_line long, item_no int, text string").parquet(str(tmp_path / "out"))
    want = numbered_items(spark.createDataFrame(REPORT + other, "report_id string, line_no long, line string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_evidence_of_split_reports_equals_the_batch(spark, tmp_path):
    encode = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(0.0).cast("float")))
    kb = small_kb(spark)
    start = lambda lines: ri.stream_item_evidence(lines, str(tmp_path / "out"), str(tmp_path / "cp"), kb, encode, "k", nearness_scorer)
    _steps(spark, tmp_path, [(0, REPORT[:2]), (1, REPORT[2:5]), (2000, [("end", 0, "x")])], start)
    items = numbered_items(spark.createDataFrame(REPORT[:5], "report_id string, line_no long, line string"))
    asked = encode(items.select(F.lit("k").alias("kb"), F.concat_ws("#", "report_id", F.col("item_line").cast("string")).alias("query_id"), "text"))
    columns = ["query_id", "doc_id", "final_rank"]
    want = retrieve(asked, kb, nearness_scorer).select(*columns)
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_versions_switch_whole(spark, tmp_path):
    root = str(tmp_path / "kb")
    docs = lambda kb, v, ids: spark.createDataFrame([(kb, v, ("table", "text_chunk")[i % 2], f"d{i}", f"{kb}{v}") for i in ids], "kb string, version int, type string, doc_id string, document string")
    seen = lambda: {(r.kb, r.version): r.n for r in kv.read_current(spark, root).groupBy("kb", "version").agg(F.count(F.lit(1)).alias("n")).collect()}
    kv.announce(spark.createDataFrame([("007", 1, 4), ("b", 1, 2), ("007", 2, 6), ("b", 2, 9)], kv.MANIFEST), root)
    kv.stage(docs("007", 1, range(4)).unionByName(docs("b", 1, range(2))), root, 0)
    assert kv.current_versions(spark, root).count() == 0 and seen() == {}
    kv.publish(spark, root)
    assert seen() == {("007", 1): 4, ("b", 1): 2}
    kv.stage(docs("007", 2, range(3)).unionByName(docs("b", 2, range(5))), root, 1)  # then the job fails: nothing is switched
    assert seen() == {("007", 1): 4, ("b", 1): 2}
    kv.stage(docs("007", 2, range(3)).unionByName(docs("b", 2, range(5))), root, 1)  # and is repeated
    assert kv.publish(spark, root).count() == 0
    kv.stage(docs("007", 2, range(3, 6)), root, 2)
    assert [tuple(r) for r in kv.publish(spark, root).collect()] == [("007", 2)]
    assert seen() == {("007", 2): 6, ("b", 1): 2}
    kv.publish(spark, root)
    assert spark.read.parquet(f"{root}/current").count() == 3
    assert {r.document for r in kv.read_current(spark, root, "007").collect()} == {"0072"}
    assert kv.read_current(spark, root, type_="table").count() == 4
    plan = kv.read_current(spark, root, "007", "table")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_streamed_versions(spark, tmp_path):
    root, schema = str(tmp_path / "kb"), "kb string, version long, type string, doc_id string"
    kv.announce(spark.createDataFrame([("k", 1, 4)], kv.MANIFEST), root)
    for part in (range(3), range(3, 4)):
        spark.createDataFrame([("k", 1, "table", f"d{i}") for i in part], schema).write.mode("append").parquet(str(tmp_path / "in"))
        kv.stream_staged_refresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "cp")).awaitTermination()
        assert kv.read_current(spark, root).count() == (0 if len(part) == 3 else 4)


def test_storing_a_base_leaves_no_shuffle_behind(spark, tmp_path):
    import time

    import pyarrow.parquet as pq

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    shuffles = lambda: {x for x in held() if "shuffle_" in x}
    docs = spark.range(300).selectExpr("concat('k', id % 2) kb", "cast(id as string) doc_id", "if(id % 3 = 0, 'table', 'text_chunk') type", "repeat('text ', 50) document")
    before, setting = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    write_kb(docs, str(tmp_path / "kb"))
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(setting) == was
    assert read_kb(spark, str(tmp_path / "kb")).count() == 300
    one = next((tmp_path / "kb").rglob("*.parquet"))
    assert pq.ParquetFile(one).metadata.row_group(0).column(0).compression == "ZSTD"
