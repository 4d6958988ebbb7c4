"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `width` consecutive words of an item (an item of fewer words, but not none, is one window). Full containment
needs every word of the window, so its rarest word alone is the necessary prefix: words are ordered by the number of
documents they occur in (all documents are counted), then by the word. Documents give only the places where a prefix
word stands, each with the `width` - 1 words on both sides; places meet the windows of that word in one join; lengths
and the word's position in the window bound where the window can lie; then all words are compared.

Null texts have no words. Items without words have no windows. Repeated items count once per item_id; repeated
documents each get a row. Work per text is done once for equal texts (by MD5). Only named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import alnum_words, cut, map_rows, table

WIDTH = 10
#: Distinct words of the benchmark that may be sent to every task (some tens of bytes each); beyond it, words are joined.
SENT_WORDS = 1_000_000


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, window (words joined by spaces, distinct per item)."""

    def make():
        def step(given):
            ids, windows = [], []
            for item, text in zip(given["item_id"], given["text"]):
                words = [w.decode() for w in alnum_words(text)]
                found = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
                ids += [item] * len(found)
                windows += found
            yield {"item_id": ids, "window": windows}

        return step

    return map_rows(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), "item_id string, window string", make).distinct()


def _sent(words: DataFrame):
    """A broadcast set of the words (UTF-8) where they are few enough, else None."""
    if words.limit(SENT_WORDS + 1).count() > SENT_WORDS:
        return None
    return words.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in words.toLocalIterator()))


def document_counts(docs: DataFrame, words: DataFrame, sent) -> DataFrame:
    """word, df: in how many documents each of `words` occurs. Counts are summed per task before the shuffle."""

    def make():
        held: Counter[bytes] = Counter()

        def flush():
            out = {"word": [w.decode() for w in held], "df": list(held.values())}
            held.clear()
            return out

        def step(given):
            for text in given["text"]:
                found = set(alnum_words(text))
                held.update(found if sent is None else sent.value.intersection(found))
            if len(held) > 200_000:
                yield flush()

        step.rest = lambda: [flush()]
        return step

    counts = map_rows(docs.select("text"), "word string, df long", make)
    if sent is None:
        counts = counts.join(words, "word", "left_semi")
    return counts.groupBy("word").agg(F.sum("df").alias("df"))


def places(docs: DataFrame, sent, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_words, at: array of (word, place, first, around) for each place of a prefix word.

    `around` holds the words from `first` on, `width` - 1 on each side of the place.
    """
    schema = "doc_id long, text_key binary, n_words long, at array<struct<word: string, place: int, first: int, around: string>>"

    def make():
        prefixes = None if sent is None else sent.value

        def found(words: list[bytes]) -> list[dict]:
            if prefixes is not None and prefixes.isdisjoint(words):
                return []
            out = []
            for i, w in enumerate(words):
                if prefixes is None or w in prefixes:
                    first = max(0, i - width + 1)
                    out.append({"word": w.decode(), "place": i, "first": first, "around": b" ".join(words[first : i + width]).decode()})
            return out

        def step(given):
            words = [alnum_words(t) for t in given["text"]]
            yield {
                "doc_id": given["doc_id"],
                "text_key": [hashlib.md5(b" ".join(w)).digest() for w in words],
                "n_words": [len(w) for w in words],
                "at": [found(w) for w in words],
            }

        return step

    return map_rows(docs.select("doc_id", "text"), schema, make)


def prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, word (its rarest), place (first place of that word in it), n (its words)."""
    each = windows.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("place", "word"))
    ranked = each.join(counts, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    least = ranked.groupBy("window").agg(F.min(F.struct("df", "word", "place")).alias("m"), F.count(F.lit(1)).alias("n"))
    # A word in no document cannot lead to a match.
    return least.where("m.df > 0").select("window", "m.word", "m.place", "n")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = cut(item_windows(items, width))
    words = windows.select(F.explode(F.split("window", " ")).alias("word")).distinct()
    counts = document_counts(docs, words, _sent(words))
    needed = cut(prefixed(windows, counts))
    prefixes = needed.select("word").distinct()
    placed = cut(places(docs, _sent(prefixes), width))

    at = placed.where(F.size("at") > 0).select("text_key", "n_words", F.explode("at").alias("a"))
    at = at.select("text_key", "n_words", "a.word", F.col("a.place").alias("i"), "a.first", "a.around").distinct()
    pairs = at.join(needed, "word")
    start = F.col("i") - F.col("place")
    bounded = pairs.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    # Word by word: the window must be the words around the place from its own start on.
    same = F.concat(
        F.lit(" "), F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("first") + 1, F.col("n").cast("int")), " ")
    ) == F.concat(F.lit(" "), F.col("window"))
    hits = cut(bounded.where(same).select("text_key", "start", "n", "window").distinct())

    item_ids = hits.join(windows, "window").select("text_key", "item_id").distinct().groupBy("text_key").agg(
        F.sort_array(F.collect_list("item_id")).alias("ids")
    )
    spans = hits.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        "spans", zero,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["upto"], x["start"].cast("long")))).alias("n"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
    )["n"]
    found = spans.join(item_ids, "text_key").select(
        "text_key", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("joined")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return placed.select("doc_id", "text_key", "n_words").join(found, "text_key", "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def _sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP5_SQL = f"""
with d as (select row_number() over () rn, doc_id, {_sql_words('text')} w from documents),
b as (select item_id::varchar item, {_sql_words('text')} w from benchmark),
win as (select distinct item, array_to_string(list_slice(w, s, s + 9), ' ') k, least(10, len(w)) n
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) s from b where len(w) > 0)),
places as (select rn, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win) where len(w) >= n),
hit as (select distinct rn, n, i, k from (select rn, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') k from places) semi join win using (k)),
pos as (select rn, count(distinct p) n_hit from (select rn, unnest(range(i, i + n)) p from hit) group by 1),
its as (select rn, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct rn, item from hit join win using (k)) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (rn) left join its using (rn)
"""


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any item window; all columns stay. Rows meet their decision by (doc_id, words of the text)."""
    decided = decontaminate(docs, items)
    bad = cut(decided.where("contaminated").select(F.col("doc_id").alias("__id"), "text_key").distinct())

    @F.pandas_udf("binary")
    def key(texts):
        return texts.map(lambda t: hashlib.md5(b" ".join(alnum_words(t))).digest())

    keyed = docs.withColumn("__key", key("text"))
    kept = keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["__id"]) & (keyed["__key"] == bad["text_key"]), "left_anti")
    return kept.select(*docs.columns)
