"""A store of verdicts and a log of metrics, over several runs."""

import datetime as dt

from pyspark.sql import functions as F

from dossier.operators.audit import requests_to_do, reuse_verdicts
from dossier.operators.evaluate import guard_passes, regression_guard
from dossier.sources.stored_results import VERDICTS, baseline, read_verdicts, record_metrics, store_verdicts

DAY = dt.datetime(2026, 1, 1)


def replies(spark, *rows):
    return spark.createDataFrame([(k, v, r, DAY + dt.timedelta(days=d)) for k, v, r, d in rows], VERDICTS)


def stored(spark, path):
    return {r.cache_key: (r.verdict, r.reasoning) for r in read_verdicts(spark, path).collect()}


def test_the_latest_verdict_wins_and_errors_never_count(spark, tmp_path):
    path = str(tmp_path / "v")
    assert stored(spark, path) == {}
    store_verdicts(replies(spark, ("aa1", "COMPLIANT", "x", 1), ("aa2", "NOT_EVALUATED", "e", 1), ("bb1", "COMPLIANT", "y", 1), (None, "COMPLIANT", "n", 1)), path)
    assert stored(spark, path) == {"aa1": ("COMPLIANT", "x"), "bb1": ("COMPLIANT", "y")}
    untouched = sorted(p.name for p in (tmp_path / "v" / "prefix=bb").iterdir())
    for _ in range(2):  # a repeated merge changes nothing
        store_verdicts(replies(spark, ("aa1", "NON_COMPLIANT", "z", 3), ("aa1", "COMPLIANT", "old", 0), ("aa2", "COMPLIANT", "w", 2), ("aa1", "NOT_EVALUATED", "e", 9)), path)
        assert stored(spark, path) == {"aa1": ("NON_COMPLIANT", "z"), "aa2": ("COMPLIANT", "w"), "bb1": ("COMPLIANT", "y")}
    assert sorted(p.name for p in (tmp_path / "v" / "prefix=bb").iterdir()) == untouched


def test_a_second_run_asks_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    requests = spark.createDataFrame([("m", "k", i, f"item {i}", f"context {i}" if i else None) for i in range(40)], "model string, kb string, query_id int, text string, context string")
    first = reuse_verdicts(requests, read_verdicts(spark, path), "p")
    todo = requests_to_do(first)
    assert todo.count() == 39
    store_verdicts(todo.select("cache_key", F.lit("COMPLIANT").alias("verdict"), F.lit("r").alias("reasoning"), F.lit(DAY).alias("stored_at")), path)
    second = reuse_verdicts(requests, read_verdicts(spark, path), "p")
    assert requests_to_do(second).count() == 0 and second.count() == 40


def test_baselines_as_of_a_time_and_of_a_tag(spark, tmp_path):
    path = str(tmp_path / "log")
    suite = lambda hr3: spark.createDataFrame([("exact", hr3), ("loose", hr3 / 2)], "run string, hr3 double")
    for day, tag, hr3 in ((1, "release", 0.9), (2, "trial", 0.5), (3, "release", 0.8), (3, "trial", 0.7)):
        record_metrics(suite(hr3), path, tag, DAY + dt.timedelta(days=day))
    at = lambda **o: sorted((r.run, r.hr3) for r in baseline(spark, path, **o).select("run", "hr3").collect())
    assert at() == [("exact", 0.7), ("loose", 0.35)]
    assert at(tag="release") == [("exact", 0.8), ("loose", 0.4)]
    assert at(before=DAY + dt.timedelta(days=3)) == [("exact", 0.5), ("loose", 0.25)]
    assert at(before=DAY + dt.timedelta(days=3), tag="release") == [("exact", 0.9), ("loose", 0.45)]
    assert at(before=DAY) == [] and at(tag="none") == []
    passed = lambda base: guard_passes(regression_guard(suite(0.75), base, ["exact"])).first().passed
    assert passed(baseline(spark, path)) and not passed(baseline(spark, path, tag="release"))
