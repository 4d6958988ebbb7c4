"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. Hosts are turned
round label by label (`www.example.com` becomes `com.example.www.`), so that a rule's host, and likewise its path, is a
prefix, that is an interval of the sorted keys; intervals of prefixes nest or lie apart. A sorted sweep carries the
stack of the rule opened last, with the rules around it: exactly the members that are prefixes of a url's key fit it.
The sweep runs over hosts first, then, for each host of a rule, over paths.

The longest rule (host and path together) wins, the longer host on a tie; of one rule given twice, block wins.
Rules with an empty or null host fit nothing; a null path is empty. A null url, or one without `://`, has an empty host
and path. Urls that no rule fits get `default`. Each page row gives a row, repeated ones too.

A hot host or rule doesn't meet in one task: equal urls are judged once, and a group of many keys is dealt out by hash
to several sorted runs, each with all rules of that group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut, table

RUN_KEYS = 200_000  # keys of one sorted run, about
MOST_SENT = 100_000  # groups of rules with their numbers of runs, sent to all tasks; more are joined
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query's contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.sql("select '' host, '' path, '' verdict where false")
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Rules (g, k) with `stack`: the keys of the same group that are prefixes of k, shortest first, k itself last."""
    starts = rules.select("g", "k", F.explode(F.sequence(F.lit(0), F.length("k"))).alias("n"))
    starts = starts.select("g", F.col("k").alias("of"), F.substring("k", F.lit(1), F.col("n")).alias("k"))
    around = starts.join(rules, ["g", "k"]).groupBy("g", "of").agg(
        F.sort_array(F.collect_list(F.struct(F.length("k").alias("n"), "k"))).alias("s")
    )
    return around.select("g", F.col("of").alias("k"), F.transform("s", lambda x: x["k"]).alias("stack"))


def _sweep(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct keys (g, k, ...) with `fits`: the keys of rules in the same group that are prefixes of k, shortest first."""
    runs = keys.groupBy("g").agg((F.count(F.lit(1)) / RUN_KEYS + 1).cast("int").alias("runs"))
    runs = cut(runs.join(rules.select("g").distinct(), "g"))  # one row for each group that has rules
    if runs.limit(MOST_SENT + 1).count() <= MOST_SENT:
        runs = F.broadcast(runs)
    # By the whole key: many hosts may have the same path.
    whole = F.xxhash64(*[c for c in keys.columns if c != "g"])
    asked = keys.join(runs, "g").withColumn("run", F.pmod(whole, F.col("runs")).cast("int")).drop("runs")
    opened = _stacks(rules).join(runs, "g").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")
    both = asked.withColumn("kind", F.lit(1)).unionByName(opened.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("g", "run").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("top", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = F.filter("top", lambda p: F.startswith(F.col("k"), p))
    return swept.withColumn("fits", fits).where("size(fits) > 0").drop("stack", "top", "kind", "run")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    known = (
        rules.where("host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict")).withColumn("host_key", reversed_host(F.col("host")))
    )
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = seen.where("host <> ''").select("host", "path").distinct()

    top = F.substring_index("k", ".", 1)
    hosts = urls.select("host").distinct().withColumn("k", reversed_host(F.col("host"))).withColumn("g", top)
    host_rules = known.select(F.col("host_key").alias("k")).distinct().withColumn("g", top)
    of_host = _sweep(hosts, host_rules).select("host", F.explode("fits").alias("g"))

    paths = urls.join(of_host, "host").select("g", "host", F.col("path").alias("k"))
    path_rules = known.select(F.col("host_key").alias("g"), F.col("path").alias("k"))
    fits = _sweep(paths, path_rules).select("g", "host", F.col("k").alias("path"), F.element_at("fits", -1).alias("rule_path"))

    named = known.select(F.col("host_key").alias("g"), F.col("path").alias("rule_path"), F.col("host").alias("rule_host"), "verdict")
    best = fits.join(named, ["g", "rule_path"]).groupBy("host", "path").agg(
        F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_host", "rule_path", "verdict")).alias("b")
    ).select("host", "path", F.concat("b.rule_host", "b.rule_path").alias("rule"), "b.verdict")
    return seen.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


OP2_SQL = """
with rules(rh, rp, rv) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
seen as (select page_id, row_number() over () rn, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
fit as (select rn, rh || rp as rule_text, rv, row_number() over (partition by rn order by length(rh) + length(rp) desc, length(rh) desc) k
  from seen, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule_text as rule, coalesce(rv, 'allow') as verdict from seen left join fit on seen.rn = fit.rn and k = 1
"""
