"""Building a knowledge base: documents, question rows, lexical index, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.config import TextConfig
from dossier.functions.lineage import cut
from dossier.functions.sizes import written_side
from dossier.functions.text import index_tokens, split_lines, strip, token_counts
from dossier.operators.text import pack_windows

# Okapi parameters of the public BM25 implementation.
K1, B, EPSILON = 1.5, 0.75, 0.25
MIN_QUESTION_CHARS = 15


def _header(path: Column, title: Column, with_path: bool) -> Column:
    joined = F.array_join(path, " > ")
    use = (F.length(joined) > 0) & (joined != title) & F.lit(with_path)
    return F.when(use, F.concat(joined, F.lit("\n"), title)).otherwise(title)


def _order(kind: int, pos: Column, part: int, sub: Column) -> Column:
    """Place of a document in its knowledge base: tables first, then chunk by chunk."""
    return F.struct(
        F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), F.lit(part).alias("part"), sub.cast("int").alias("sub")
    ).alias("doc_order")


def table_rows_of_kb(tables: DataFrame) -> DataFrame:
    """Index rows of tables.

    `tables`: kb, table_idx, page_idx, table_name, display_name, serialized, html, img_path,
    legend, notes, footnotes.
    """
    return tables.select(
        "kb",
        F.concat(F.lit("table_p"), F.col("page_idx").cast("string"), F.lit("_idx"), F.col("table_idx").cast("string")).alias("doc_id"),
        F.lit("table").alias("type"),
        F.concat("display_name", F.lit("\n"), "serialized").alias("document"),
        "table_name",
        "display_name",
        "page_idx",
        "img_path",
        "legend",
        "html",
        F.array_join("notes", "\n").alias("notes"),
        F.array_join("footnotes", "\n").alias("footnotes"),
        "serialized",
        _order(0, F.col("table_idx"), 0, F.lit(0)),
    )


def chunk_rows_of_kb(chunks: DataFrame, cfg: TextConfig = TextConfig()) -> DataFrame:
    """Index rows of text chunks, one per window.

    `chunks`: kb, chunk_id, title, section_path, content, page_idx, start_idx.
    """
    header = _header(F.col("section_path"), F.col("title"), cfg.embed_section_path)
    return pack_windows(chunks, cfg.window_max_chars).select(
        "kb",
        "doc_id",
        F.lit("text_chunk").alias("type"),
        F.concat(header, F.lit("\n"), F.col("window")).alias("document"),
        "page_idx",
        "chunk_id",
        "title",
        F.array_join("section_path", " > ").alias("section_path"),
        "content",
        _order(1, F.col("start_idx"), 0, F.col("window_no")),
        *[c for c in ("chunk_no",) if c in chunks.columns],
    )


def question_rows_of_kb(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Extra index rows whose text is a question about a chunk."""
    return questions.join(chunks, ["kb", "chunk_id"]).select(
        "kb",
        F.concat("chunk_id", F.lit("__q"), F.col("question_no").cast("string")).alias("doc_id"),
        F.lit("text_chunk").alias("type"),
        F.col("question").alias("document"),
        "page_idx",
        "chunk_id",
        "title",
        F.array_join("section_path", " > ").alias("section_path"),
        "content",
        F.lit(1).alias("synth"),
        _order(1, F.col("start_idx"), 1, F.col("question_no")),
        *[c for c in ("chunk_no",) if c in chunks.columns],
    )


def kb_documents(
    tables: DataFrame, chunks: DataFrame, questions: DataFrame | None = None, cfg: TextConfig = TextConfig()
) -> DataFrame:
    """All index rows of the knowledge bases, one schema for tables, windows and questions."""
    docs = table_rows_of_kb(tables).unionByName(chunk_rows_of_kb(chunks, cfg), allowMissingColumns=True)
    if questions is not None:
        docs = docs.unionByName(question_rows_of_kb(chunks, questions), allowMissingColumns=True)
    else:
        docs = docs.withColumn("synth", F.lit(None).cast("int"))
    text = ["table_name", "display_name", "img_path", "legend", "html", "notes", "footnotes",
            "serialized", "chunk_id", "title", "section_path", "content"]
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in text}
    return docs.withColumns({**filled, "synth": F.coalesce("synth", F.lit(0))})


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """Document ids used more than once inside one knowledge base (should be none)."""
    return docs.groupBy("kb", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def attach_questions(generated: DataFrame, n: int = 2) -> DataFrame:
    """First `n` usable questions in the generated text of each chunk.

    `generated`: kb, chunk_id, raw. A usable line has 15 characters or more and a question
    mark after its bullet or number is taken off.
    """
    tidy = F.transform(
        split_lines(F.col("raw")),
        lambda ln: strip(F.regexp_replace(strip(ln), r"^[-*0123456789.) ]+", "")),
    )
    good = F.filter(tidy, lambda q: (F.length(q) >= MIN_QUESTION_CHARS) & F.contains(q, F.lit("?")))
    return generated.select(
        "kb", "chunk_id", F.posexplode_outer(F.slice(good, 1, n)).alias("question_no", "question")
    ).filter(F.col("question").isNotNull())


def chunks_to_do(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks for which nothing was generated yet."""
    return chunks.join(done.select("kb", "chunk_id"), ["kb", "chunk_id"], "left_anti")


# --- lexical index ---------------------------------------------------------------------


@dataclass(frozen=True)
class LexicalIndex:
    """postings: kb, doc_id, doc_len, token, tf (and doc_order where documents have one); terms: kb, token, df, idf; stats: kb, n_docs, avg_len."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def repeated_ids(docs: DataFrame) -> bool:
    """True if some document id stands more than once in its base (ids alone are read)."""
    return not duplicate_ids(docs).isEmpty()


def counted_words(docs: DataFrame, ids: list[str], text: str, n: int) -> DataFrame:
    """Postings (ids, doc_len, token, tf) in `n` partitions by kb and doc_id.

    A text's words are counted inside its row, without a row for each word. Texts under one id count together where
    they are equally long; then, and only then, words are grouped by id.
    """
    spread = docs.select(*ids, F.col(text).alias("t")).repartition(n, "kb", "doc_id")
    sized = spread.select(*ids, index_tokens(F.col("t")).alias("toks")).withColumn("doc_len", F.size("toks"))
    # outer: otherwise Spark would first filter on the size of the computed array, below the
    # shuffle, and so cut every text into words twice
    if not repeated_ids(docs):
        return sized.select(*ids, "doc_len", F.inline_outer(token_counts(F.col("toks")))).filter(F.col("token").isNotNull())
    words = sized.select(*ids, "doc_len", F.explode_outer("toks").alias("token")).filter(F.col("token").isNotNull())
    return words.groupBy(*ids, "doc_len", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def words_of_bases(postings: DataFrame, docs: DataFrame, text: str, n: int) -> DataFrame:
    """kb, token, df and n_tokens, whose sum over a base is its number of words.

    How many documents hold a word needs no count inside a document; a document's length goes with its first word.
    """
    if repeated_ids(docs):
        return postings.groupBy("kb", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n_tokens"))
    toks = docs.select("kb", index_tokens(F.col(text)).alias("toks"))
    each = toks.select("kb", F.size("toks").alias("doc_len"), F.posexplode_outer(F.array_distinct("toks")).alias("pos", "token"))
    return each.filter(F.col("token").isNotNull()).groupBy("kb", "token").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("pos") == 0, F.col("doc_len")).otherwise(0)).alias("n_tokens")
    )


def lexical_index(docs: DataFrame, text: str = "document") -> LexicalIndex:
    """Postings, document frequencies and corpus statistics of each knowledge base.

    Texts are spread by document before they are cut into words, so the words of a document
    are counted where they are, and a document can later be scored against all queries without moving its postings again. The vocabulary is
    written once; corpus statistics come from it, not from another pass over the texts.
    """
    # A given number of partitions: scoring multiplies the rows by the queries that match, so
    # small texts must not be packed together by their size.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = ["kb", "doc_id", *[c for c in ("doc_order",) if c in docs.columns]]
    postings = counted_words(docs, ids, text, n)
    vocabulary = cut(words_of_bases(postings, docs, text, n))
    sizes = docs.groupBy("kb").agg(F.count(F.lit(1)).alias("n_docs"))
    totals = vocabulary.groupBy("kb").agg(F.sum("n_tokens").alias("total"))
    stats = sizes.join(totals, "kb", "left").select(
        "kb", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_len")
    )
    return LexicalIndex(postings, term_weights(vocabulary, stats), stats)


def term_weights(vocabulary: DataFrame, stats: DataFrame) -> DataFrame:
    """Okapi idf of each term; terms in most documents get a small share of the mean."""
    # One row per base: sent to the vocabulary after its count, so that a base's words need not meet by its name.
    raw = vocabulary.join(written_side(stats.select("kb", "n_docs")), "kb").withColumn(
        "raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.groupBy("kb").agg(F.avg("raw").alias("mean_raw"))
    return raw.join(written_side(mean), "kb").select(
        "kb", "token", "df",
        F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"),
    )


def write_index(index: LexicalIndex, folder: str) -> None:
    """Store an index, the postings of a document side by side."""
    ids = ["kb", "doc_id"]
    index.postings.sortWithinPartitions(*ids).write.mode("overwrite").parquet(f"{folder}/postings")
    index.terms.write.mode("overwrite").parquet(f"{folder}/terms")
    index.stats.write.mode("overwrite").parquet(f"{folder}/stats")


def read_index(spark, folder: str) -> LexicalIndex:
    """A stored index. Files don't tell the planner how they are dealt, so postings are dealt by document once here."""
    postings, terms, stats = (spark.read.parquet(f"{folder}/{part}") for part in ("postings", "terms", "stats"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return LexicalIndex(postings.repartition(n, "kb", "doc_id"), terms, stats)


# --- vectors ---------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def embed(
    docs: DataFrame, load_encoder: Callable[[str], Encoder], text: str = "document",
    route: str | None = None, batch_rows: int = 128,
) -> DataFrame:
    """Add `embedding` by a user-supplied encoder, one call per batch of texts.

    `load_encoder(route)` runs once per task and route (for example english, multilingual).
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready: dict[str, Encoder] = {}
        for texts, routes in batches:
            out: list = [None] * len(texts)
            for name, rows in routes.reset_index(drop=True).groupby(routes.to_numpy()).indices.items():
                encoder = ready.setdefault(name, None) or load_encoder(name)
                ready[name] = encoder
                at = rows.tolist()
                for lo in range(0, len(at), batch_rows):
                    part = at[lo:lo + batch_rows]
                    for i, vec in zip(part, encoder([texts.iloc[i] for i in part])):
                        out[i] = np.asarray(vec, dtype="float32")
            yield pd.Series(out)

    chosen = F.lit("english") if route is None else F.col(route)
    return docs.withColumn("embedding", encode(F.col(text), chosen))
