import random
import re

from dossier.llm import url_rules as u
from tests.llm.frames import crowded, rows

PAGES = "page_id long, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def judged(url, rules):
    host, path = split(url)
    best = max(
        ((len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)),
        default=None,
    )
    return host, path, best and best[3], best[2] if best else "allow"


def frame(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def check(spark, urls, rules):
    pages = crowded(spark.createDataFrame(list(enumerate(urls)), PAGES))
    given = [(h, p or "", v) for h, p, v in rules if h]
    want = sorted((i, *judged(x, given)) for i, x in enumerate(urls))
    assert rows(u.judge_urls(pages, frame(spark, rules)), "page_id", "host", "path", "rule", "verdict") == want


def test_random_rules(spark, monkeypatch):
    rng = random.Random(8)
    labels, parts = ["com", "org", "a", "b", "ab", "example", "x-1", "com2"], ["/", "/a", "/a/", "/a/b", "/ab", "/é/", "/a%20", "//"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), rng.choice(parts), rng.choice(["allow", "block"])) for _ in range(150)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(['', 'b', '/b/c', '?q=/a', '#/a'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "x://COM", "https://A.Example.COM:80/a", "http://a..com/a", "http://.com/a", "http://com./a", urls[0], urls[0]]
    check(spark, urls, rules)
    monkeypatch.setattr(u, "RUN_KEYS", 3)  # many sorted runs for each group
    check(spark, urls, rules)


def test_odd_rules(spark):
    rules = [("com", None, "block"), (None, "/a", "block"), ("", "/a", "block"), ("a.com", "", "allow"), ("org", "/a", "allow"), ("org", "/a", "block")]
    urls = ["http://com/a", "http://b.a.com", "http://x.org/abc", "http://net/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    got = rows(u.judge_urls(pages, frame(spark, rules), default="review"), "page_id", "rule", "verdict")
    assert got == [(0, "com", "block"), (1, "a.com", "allow"), (2, "org/a", "block"), (3, None, "review")]
    assert u.judge_urls(spark.createDataFrame([], PAGES), frame(spark, rules)).count() == 0
    assert rows(u.judge_urls(pages, frame(spark, [])), "verdict") == [("allow",)] * 4


def test_plan_has_no_python(spark):
    pages = spark.range(3).selectExpr("id page_id", "'http://a.com/en/' url")
    plan = u.judge_urls(pages, u.rules_table(spark, u.RULES))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_many_hosts_of_one_path_are_dealt_to_many_runs(spark, monkeypatch):
    """The most common path of a crawl: its hosts don't share a sorted run."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(u, "RUN_KEYS", 100)
    urls = [f"http://h{i}.com/" for i in range(2000)]
    check(spark, urls, [("com", "/", "block"), ("h7.com", "/", "allow")])
    dealt = []
    window = u.Window.partitionBy

    def spied(*columns):
        dealt.append(columns)
        return window(*columns)

    monkeypatch.setattr(u.Window, "partitionBy", spied)
    keys = spark.range(2000).select(F.lit("com.").alias("g"), F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("k"))
    swept = u._sweep(keys, spark.createDataFrame([("com.", "/")], "g string, k string"))
    assert dealt == [("g", "run")] and swept.count() == 2000
    whole = F.pmod(F.xxhash64("host", "k"), F.lit(21))
    assert keys.select(whole).distinct().count() == 21


def test_very_long_urls(spark):
    check(spark, ["http://a.com/" + "x/" * 50_000, "http://" + "a." * 2_000 + "com/en/"], [("com", "/en/", "block"), ("a.com", "/x/x", "allow")])
