"""Audit, evaluation and scenario operators on small input."""

from pyspark.sql import functions as F

from dossier.config import AuditConfig
from dossier.functions.numbers import parse_numbers, parse_range, pick_inside
from dossier.operators import audit as au
from dossier.operators import evaluate as ev
from dossier.operators import scenarios as sc


def test_replies(spark):
    replies = ["VERDICT: non_compliant\nREASONING: too near\nmore", "verdict : COMPLIANT", "", "maybe", None]
    df = spark.createDataFrame(list(enumerate(replies)), "query_id int, reply string")
    got = [(r.verdict, r.reasoning) for r in au.parse_responses(df).orderBy("query_id").collect()]
    assert got == [("NON_COMPLIANT", "too near\nmore"), ("COMPLIANT", "verdict : COMPLIANT"), ("NOT_EVALUATED", au.EMPTY_REPLY),
                   ("NOT_EVALUATED", "maybe"), ("NOT_EVALUATED", au.EMPTY_REPLY)]
    strict = au.parse_responses(df, unparsed="NON_COMPLIANT").filter("query_id = 3").first()
    assert strict.verdict == "NON_COMPLIANT"


def test_call_rate(spark):
    times = [0, 1, 2, 3, 4, 30, 59, 61, 200]
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(times)], "call_id int, provider string, t int").select(
        "call_id", "provider", F.timestamp_seconds("t").alias("ts"))
    got = {r.call_id: r.wait_s for r in au.call_rate_breaches(df).collect()}
    assert got == {5: 30.5, 6: 60 - 58 + 0.5, 7: 60 - 59 + 0.5}


def test_verdict_reuse(spark):
    req = spark.createDataFrame([("m", 1, "a", "c"), ("m", 2, "b", None)], "model string, query_id int, text string, context string")
    key = req.select(au.cache_key(F.col("model"), "p", F.col("text"), F.coalesce("context", F.lit(""))).alias("cache_key"), F.lit("COMPLIANT").alias("verdict"), F.lit("r").alias("reasoning"))
    hit = au.reuse_verdicts(req, key.limit(1), "p")
    assert hit.filter("cached").count() == 1 and au.requests_to_do(hit).count() == 0
    assert au.requests_to_do(au.reuse_verdicts(req, key, "changed")).count() == 1


def test_gold_rank_rules_and_metrics(spark):
    matches = spark.createDataFrame(
        [(1, "table", "Table 5-1", "", "", 1, 1), (1, "table", "Table 5", "", "", 2, 2), (1, "text_chunk", "", "", "chunk_p7_idx1", 7, 3),
         (2, "text_chunk", "", "", "chunk_p7_idx1", 7, 1), (3, "table", "Other", "", "", 133, 1)],
        "query_id int, type string, table_name string, display_name string, chunk_id string, page_idx int, final_rank int")
    scen = spark.createDataFrame([(1, "Table 5", "g"), (2, "chunk_p7_idx9", "h"), (3, "Table 133", "g")], "query_id int, label string, grp string")
    rules = spark.createDataFrame([("Table 5", "Table 5", None, ["Table 5-"], None, None), ("Table 133", None, None, None, "Table 133", None),
                                   ("Table 133", None, None, None, None, 133)], ev.RULE_SCHEMA)
    rank = lambda mode, r=None: {x.query_id: x["rank"] for x in ev.gold_rank(matches, scen, mode, r).collect()}
    assert rank("chunk", rules) == {1: 2, 2: None, 3: 1}
    assert rank("page", rules) == {1: 2, 2: 1, 3: 1}
    assert rank("chunk") == {1: 1, 2: None, 3: None}
    m = {r.grp: r for r in ev.retrieval_metrics(ev.gold_rank(matches, scen, "chunk", rules)).collect()}
    assert (m[None].scope, m[None].n) == ("all", 3) and abs(m[None].mrr - 0.5) < 1e-9 and m["g"].hr1 == 0.5


def test_guard(spark):
    now = spark.createDataFrame([("set1", 0.9), ("text", 0.8)], "run string, hr3 double")
    base = spark.createDataFrame([("set1", 0.95), ("text", 0.7)], "run string, hr3 double")
    assert {r.run: r.status for r in ev.regression_guard(now, base, ["set1"]).collect()} == {"set1": "regression", "text": "up"}
    assert not ev.guard_passes(ev.regression_guard(now, base, ["set1"])).first().passed
    assert ev.guard_passes(ev.regression_guard(now, base, ["set1"], 0.05)).first().passed


def test_remap(spark):
    body = "Title of the old section\nthis line is long enough to prove it\nshort"
    old = spark.createDataFrame([("k", "chunk_p1_idx5", body), ("k", "chunk_p2_idx9", "Another old title here\nnot found anywhere at all")], "kb string, chunk_id string, content string")
    new = spark.createDataFrame([("k", "chunk_p1_idx3", "x\n" + body), ("k", "chunk_p9_idx40", "zzz")], "kb string, chunk_id string, content string")
    scen = old.select("kb", "chunk_id").unionByName(spark.createDataFrame([("k", "chunk_p0_idx1")], "kb string, chunk_id string"))
    for span in (2, 1000):
        got = {r.chunk_id: (r.host_id, r.status) for r in ev.remap_gold(scen, old, new, span).collect()}
        assert got == {"chunk_p1_idx5": ("chunk_p1_idx3", "ok"), "chunk_p2_idx9": ("chunk_p1_idx3", "not_verified"), "chunk_p0_idx1": (None, "not_in_old")}
    bad = ev.remap_gold(scen, old, new)
    assert ev.apply_remap(scen, bad).join(scen, ["kb", "chunk_id"]).count() == 3
    assert "chunk_p1_idx3" in {r.chunk_id for r in ev.apply_remap(scen, bad.filter("status = 'ok'")).collect()}


def test_numbers(spark):
    cells = {"45.000": [45000.0], "115.001 and 0.5": [115001.0, 0.5], "51,50": [51.5], "10.1- 1.200,5": [10.1, 1200.5], "none": []}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.n for r in df.select("c", parse_numbers(F.col("c")).alias("n")).collect()} == cells
    ranges = {"3.1- 10": (3.1, 10.0, 6.6), "0.5'den az": (0.0, 0.5, 0.2), "7": (7.0, 7.0, 7.5)}
    df = spark.createDataFrame([(c,) for c in ranges], "c string").select("c", parse_range(F.col("c")).alias("r")).withColumn("p", pick_inside(F.col("r")))
    assert {r.c: (r.r.lo, r.r.hi, r.p) for r in df.collect()} == ranges


def test_false_pairs_cover_every_ordered_pair_once(spark):
    rows = [(0, 0, "h")] + [(i, c, f"g{i}" if c == 0 else (f"t{i}{c}" if (i + c) % 3 else "nil")) for i in range(1, 6) for c in range(3)]
    cells = spark.createDataFrame([("t", *r) for r in rows], "table_id string, row_idx int, col_idx int, text string")
    kept = sc.equivalence_rows(cells, ["a", "b"], span=2)
    n = kept.count()
    all_pairs = sc.equivalence_pairs(kept, n * (n - 1)).filter(F.col("expected") == AuditConfig().violation)
    assert all_pairs.count() == n * (n - 1)
    assert sc.equivalence_pairs(kept, 7).filter(F.col("expected") == AuditConfig().violation).count() == 7


def test_balanced_sample(spark):
    pool = spark.createDataFrame([("t", f"x{i}", "COMPLIANT" if i % 4 else "NON_COMPLIANT") for i in range(40)], "table_id string, text string, expected string")
    got = sc.balanced_sample(pool, 9).collect()
    assert sorted(r.expected for r in got).count("COMPLIANT") == 4 and len(got) == 9
    assert {r.text for r in got} == {r.text for r in sc.balanced_sample(pool.repartition(7), 9).collect()}
