"""Retrieval: lexical and vector channels, candidate pools, scoring, ranking, evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.lineage import cut
from dossier.functions.sizes import broadcast_if, is_small
from dossier.functions.text import code_tokens, index_tokens
from dossier.operators.index import B, K1, LexicalIndex
from dossier.operators.text import first_per_key

# Scores are compared after rounding, so that equal texts tie whatever the order of the sums.
SCORE_DIGITS = 9
SEPARATOR = "=" * 60
# A query belongs to a knowledge base and is answered from it; ids are unique inside a base only.
QUERY = ["kb", "query_id"]
# A scorer adds `rerank_score` to rows with query_text and doc_text.
Scorer = Callable[[DataFrame], DataFrame]


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Word tokens (duplicates kept), code tokens (a set) and both as index tokens."""
    return df.withColumns({
        "index_tokens": index_tokens(F.col(text)),
        "code_tokens": code_tokens(F.col(text)),
    })


def bm25_topk(queries: DataFrame, index: LexicalIndex, n: int = 10) -> DataFrame:
    """Best `n` documents (score above 0) of each query over its whole knowledge base.

    `queries`: kb, query_id, text. Query terms are few and, once their number is checked, go
    to the documents. Postings are partitioned by document, so a document's score is complete
    inside one task, which sums it in numpy, and only each task's best `n` are shuffled; a word found in every document
    gathers nowhere. Ties go by doc_id, or by doc_order if the postings carry one.
    """
    asked = (
        queries.select("kb", "query_id", F.explode_outer(index_tokens(F.col("text"))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("kb", "query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    )
    small = is_small(asked)
    weighted = (
        index.terms.join(broadcast_if(small, asked), ["kb", "token"])
        .join(broadcast_if(is_small(index.stats), index.stats.select("kb", "avg_len")), "kb")
        .select("kb", "token", "query_id", (F.col("qtf") * F.col("idf")).alias("w"), "avg_len")
    )
    order = [c for c in ("doc_order",) if c in index.postings.columns]
    if small:
        scored = scored_by_document(index.postings, weighted, order, n)
    else:
        # words that nobody asks are dropped before they are counted by document
        wanted = asked.select("kb", "token").distinct()
        hits = index.postings.join(wanted, ["kb", "token"], "left_semi").join(weighted, ["kb", "token"])
        norm = K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len"))
        part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        scored = hits.groupBy(*QUERY, "doc_id", *order).agg(F.sum(part).alias("score"))
    scored = scored.withColumn("score", F.round("score", SCORE_DIGITS)).filter(F.col("score") > 0)
    w = Window.partitionBy(*QUERY).orderBy(F.desc("score"), *order, "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


HITS = 1_000_000  # words met with queries at once, about
SLACK = 4.0 * 10**-SCORE_DIGITS  # scores nearer than this may be equal once they are rounded


def scored_by_document(postings: DataFrame, weighted: DataFrame, order: list[str], n: int) -> DataFrame:
    """kb, query_id, doc_id (doc_order), score: the best of each task, from the asked words of each document in one row.

    `weighted` (kb, token, query_id, w, avg_len) is bounded. Documents come in the order of ties, so that of equal scores
    a task keeps the first `n`; scores that rounding may make equal are all kept. With `light`, `rest` and `bar` of each word
    and query, words that are light are summed only where the others and `rest` together reach the query's `bar`.
    """
    terms = cut(weighted).toArrow().combine_chunks()
    spark = postings.sparkSession
    ids = ["kb", "doc_id", *order]
    schema = weighted.select(*QUERY).schema.simpleString().removeprefix("struct<").removesuffix(">")
    kinds = ", ".join(f"{c} {postings.schema[c].dataType.simpleString()}" for c in ("doc_id", *order))
    out = f"{schema}, {kinds}, score double"
    if not len(terms):
        return spark.createDataFrame([], out)
    (kb, bases), (token, _), (number, numbers) = (_coded(terms[c]) for c in ("kb", "token", "query_id"))
    by_token = np.lexsort((token, kb))
    kb, token, number = kb[by_token], token[by_token], number[by_token]
    starts = np.flatnonzero(np.append(True, (kb[1:] != kb[:-1]) | (token[1:] != token[:-1])))
    pair, query = np.unique(kb * len(numbers) + number, return_inverse=True)
    asked = terms.take(pa.array(by_token[starts])).select(["kb", "token", "avg_len"])
    asked = spark.createDataFrame(asked.append_column("no", pa.array(np.arange(len(starts), dtype="int32"))))
    light = rest = bar = None
    if "light" in terms.column_names:
        one = np.unique(query, return_index=True)[1]
        light, rest, bar = (terms[c].to_numpy()[by_token] for c in ("light", "rest", "bar"))
        rest, bar = rest[one], np.where(np.isnan(bar[one]), -np.inf, bar[one])
    found = spark.sparkContext.broadcast((
        np.append(starts, len(terms)), query, terms["w"].to_numpy()[by_token],
        [bases.take(pa.array(pair // len(numbers))), numbers.take(pa.array(pair % len(numbers)))], light, rest, bar,
    ))
    norm = K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len"))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    hits = postings.join(F.broadcast(asked), ["kb", "token"]).select(*ids, F.struct("no", impact.alias("impact")).alias("hit"))
    by_doc = hits.groupBy(*ids).agg(F.sort_array(F.collect_list("hit")).alias("hits")).sortWithinPartitions(*order, "doc_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, query, weight, names, light, rest, bar = found.value
        best = _BestDocuments(len(names[0]), n, bar)
        for batch in batches:
            lists = batch.column("hits")
            docs = batch.select([c for c in batch.schema.names if c not in ("kb", "hits")])
            flat = lists.flatten()
            no, impact = flat.field("no").to_numpy(), flat.field("impact").to_numpy()
            size = lists.value_lengths().to_numpy()
            met = np.add.reduceat(np.diff(at)[no], np.append(0, np.cumsum(size)[:-1]))
            part = np.cumsum(met) // HITS
            first = np.append(0, np.cumsum(size))
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                lo, hi = first[rows[0]], first[rows[-1] + 1]
                n_met = np.diff(at)[no[lo:hi]]
                step = np.arange(n_met.sum()) - np.repeat(np.cumsum(n_met) - n_met, n_met)
                term = np.repeat(at[no[lo:hi]], n_met) + step
                doc = np.repeat(np.repeat(rows, size[rows]), n_met)
                asks, value = query[term], np.repeat(impact[lo:hi], n_met) * weight[term]
                if light is not None:
                    play = _in_play(doc, asks, value, ~light[term], rest, bar)
                    doc, asks, value = doc[play], asks[play], value[play]
                best.add(doc, asks, value, docs)
        if best.docs is not None:
            q, value, docs = best.query, best.value, best.docs
            head = [c.take(pa.array(q)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*head, *docs.columns, pa.array(value)], names=[*QUERY, *docs.schema.names, "score"]
            )

    return by_doc.mapInArrow(score, out)


def _in_play(doc: np.ndarray, query: np.ndarray, part: np.ndarray, heavy: np.ndarray, rest: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """True for parts of documents that can still reach the bar of the query; documents come in order."""
    if not len(doc):
        return np.zeros(0, dtype=bool)
    pair = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * len(bar) + query
    if pair.max() > 8 * len(pair):
        found, pair = np.unique(pair, return_inverse=True)
        reached = np.bincount(pair[heavy], weights=part[heavy], minlength=len(found))
    else:
        reached = np.bincount(pair[heavy], weights=part[heavy], minlength=pair.max() + 1)
    return reached[pair] + rest[query] >= bar[query]


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, null among them, and the values."""
    coded = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy().astype("int64"), coded.dictionary


class _BestDocuments:
    """Running best `n` documents of each query inside one task; documents come in the order of ties."""

    def __init__(self, n_queries: int, n: int, bar: np.ndarray | None = None) -> None:
        self.n, self.bar = n, np.full(n_queries, -np.inf) if bar is None else bar.copy()
        self.query, self.value, self.docs = np.zeros(0, dtype="int64"), np.zeros(0), None

    def add(self, doc: np.ndarray, query: np.ndarray, part: np.ndarray, docs: pa.RecordBatch) -> None:
        first = doc[0] if len(doc) else 0  # documents come in order
        pair = (doc - first) * len(self.bar) + query
        if len(pair) and pair.max() <= 8 * len(pair):
            value = np.bincount(pair, weights=part)
            pair = np.flatnonzero(value)
            value = value[pair]
        else:
            pair, where = np.unique(pair, return_inverse=True)
            value = np.bincount(where, weights=part, minlength=len(pair))
        doc, query = np.divmod(pair, len(self.bar))
        doc = doc + first
        near = (value > 0) & (value >= self.bar[query] - SLACK)
        if not near.any():
            return
        query, value = np.append(self.query, query[near]), np.append(self.value, value[near])
        order = np.lexsort((-value, query))  # stable: ties stay in the order they came in
        q, v = query[order], value[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        nth = place == self.n - 1
        self.bar[q[nth]] = v[nth]
        run = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])))
        equal = np.arange(len(q)) - np.repeat(run, np.diff(np.append(run, len(q))))
        keep = np.sort(order[(equal < self.n) & (v >= self.bar[q] - SLACK)])
        new = docs.take(pa.array(doc[near]))
        table = pa.Table.from_batches([new] if self.docs is None else [self.docs, new])
        self.query, self.value = query[keep], value[keep]
        self.docs = _one_batch(table.take(pa.array(keep)), docs.schema)


def _one_batch(table: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    found = table.combine_chunks().to_batches()
    return found[0] if found else pa.RecordBatch.from_pylist([], schema=schema)


def with_code_overlap(pairs: DataFrame, query: str = "query_codes", doc: str = "doc_codes") -> DataFrame:
    """`code_score`: share of the query's codes (a set) that the document's codes contain; 0 without codes."""
    shared = F.size(F.array_intersect(query, doc)) / F.size(query)
    return pairs.withColumn("code_score", F.when(F.size(query) > 0, shared).otherwise(F.lit(0.0)))


# --- pools -----------------------------------------------------------------------------


def candidate_pool(vector_hits: DataFrame, bm25_hits: DataFrame | None, fetch_k: int, text_fetch_k: int) -> DataFrame:
    """Narrow and wide candidate lists of every query; order is (list_no, seq).

    `vector_hits`: kb, query_id, channel (general, table, text), doc_id, distance, seq.
    `bm25_hits`: kb, query_id, doc_id, rank, already limited to text documents.
    As in the published system the vector list of texts is left out where `text_fetch_k` is
    not above `fetch_k`.
    """
    first, second = F.lit(0).alias("list_no"), F.lit(1).alias("list_no")
    narrow = vector_hits.filter(F.col("channel").isin("general", "table")).select(
        *QUERY,
        F.lit("narrow").alias("channel"),
        "doc_id",
        "distance",
        (F.col("channel") == "table").cast("int").alias("list_no"),
        "seq",
    )
    parts = [narrow]
    if text_fetch_k > fetch_k:
        parts.append(
            vector_hits.filter(F.col("channel") == "text").select(
                *QUERY, F.lit("wide").alias("channel"), "doc_id", "distance", first, "seq"
            )
        )
    if bm25_hits is not None:
        parts.append(
            bm25_hits.select(
                *QUERY,
                F.lit("wide").alias("channel"),
                "doc_id",
                F.lit(None).cast("double").alias("distance"),
                second,
                F.col("rank").alias("seq"),
            )
        )
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return pool


def evidence_key() -> Column:
    """What counts as the same evidence: the table's name, else the chunk, else its title."""
    return F.when(F.col("type") == "table", F.col("table_name")).otherwise(
        F.when(F.length(F.coalesce("chunk_id", F.lit(""))) > 0, F.col("chunk_id")).otherwise(F.col("title"))
    )


def dedupe_candidates(cands: DataFrame) -> DataFrame:
    """First occurrence of each piece of evidence inside each channel."""
    return first_per_key(cands.withColumn("key", evidence_key()), [*QUERY, "channel", "key"], [F.col("list_no"), F.col("seq")])


def rerank(cands: DataFrame, scorer: Scorer | None, top_k: int) -> DataFrame:
    """Score each distinct (query, evidence) once and give the score to both channels.

    Queries with no more than `top_k` narrow candidates keep a null score.
    """
    if scorer is None:
        return cands.withColumn("rerank_score", F.lit(None).cast("double"))
    is_narrow = F.col("channel") == "narrow"
    size = F.sum(F.when(is_narrow, 1).otherwise(0)).over(Window.partitionBy(*QUERY))
    sized = cands.withColumn("__narrow", size)
    order = [F.when(is_narrow, 0).otherwise(1), F.col("list_no"), F.col("seq")]
    pairs = first_per_key(sized.filter(F.col("__narrow") > top_k), [*QUERY, "key"], order)
    scores = scorer(pairs.drop("__narrow")).select(*QUERY, "key", "rerank_score")
    return sized.drop("__narrow").join(scores, [*QUERY, "key"], "left")


def rerank_text(max_chars: int | None = None, max_html_chars: int | None = None) -> Column:
    """Text given to a pair scorer, whole by default; question rows are judged by their chunk.

    The published system cuts chunks to 800 and markup to 500 characters: pass those numbers
    where the scorer has such limits.
    """
    cut_to = lambda c, n: c if n is None else F.substring(c, 1, n)
    chunk = cut_to(F.concat_ws("\n", "section_path", "title", "content"), max_chars)
    return F.when((F.col("type") == "text_chunk") & (F.coalesce("synth", F.lit(0)) != 0), chunk).otherwise(
        F.when(F.length(F.coalesce("document", F.lit(""))) > 0, F.col("document"))
        .when(F.length(F.coalesce("content", F.lit(""))) > 0, cut_to(F.col("content"), max_chars))
        .otherwise(cut_to(F.col("html"), max_html_chars))
    )


def znorm_by_modality(scored: DataFrame, shortlist: int = 0) -> DataFrame:
    """Scores in standard deviations: per type in narrow, over the whole list in wide."""
    narrow = F.col("channel") == "narrow"
    group = F.when(narrow, F.col("type")).otherwise(F.lit("*"))
    rows = scored.filter(F.col("rerank_score").isNotNull()).withColumn("__group", group)
    by = Window.partitionBy(*QUERY, "channel", "__group")
    rows = rows.withColumn("type_first", F.when(narrow, F.min(F.struct("list_no", "seq")).over(by)))
    if shortlist > 0:
        best = by.orderBy(F.desc("rerank_score"), "list_no", "seq")
        rows = (
            rows.withColumn("__rn", F.row_number().over(best))
            .filter(~narrow | (F.col("__rn") <= shortlist))
            .drop("__rn")
        )
    sd = F.stddev_pop("rerank_score").over(by)
    return rows.withColumn(
        "norm_score",
        (F.col("rerank_score") - F.avg("rerank_score").over(by)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd),
    ).drop("__group")


def fuse_code_bonus(normed: DataFrame, weight: float = 1.0) -> DataFrame:
    """Add the code bonus and rank each channel; ties keep the order they came in."""
    fused = normed.withColumn("norm_score", F.round(F.col("norm_score") + weight * F.col("code_score"), SCORE_DIGITS))
    narrow = F.col("channel") == "narrow"
    w = Window.partitionBy(*QUERY, "channel").orderBy(
        F.desc("norm_score"),
        "type_first",
        F.when(narrow, F.col("rerank_score")).otherwise(F.lit(0.0)).desc(),
        "list_no",
        "seq",
    )
    return fused.withColumn("rank", F.row_number().over(w))


def table_floor(ranked: DataFrame, top_k: int) -> DataFrame:
    """Give the best table rank `top_k` if none is above it and it is not below the median.

    `ranked`: narrow rows with kb, query_id, type, norm_score, rank.
    """
    q = Window.partitionBy(*QUERY)
    table_rank = F.when(F.col("type") == "table", F.col("rank"))
    n = F.count(F.lit(1)).over(q)
    best = F.min(table_rank).over(q)
    best_score = F.max(F.when(F.col("type") == "table", F.struct(-F.col("rank"), F.col("norm_score").alias("s")))).over(q)["s"]
    rows = ranked.withColumns({"__n": n, "__best": best, "__bs": best_score})
    median = F.max(F.when(F.col("rank") == F.col("__n") - F.floor(F.col("__n") / 2), F.col("norm_score"))).over(q)
    rows = rows.withColumn("__m", median)
    lift = (F.col("__n") > top_k) & (F.col("__best") > top_k) & (F.col("__bs") >= F.col("__m"))
    moved = (
        F.when(F.col("rank") == F.col("__best"), F.lit(top_k))
        .when((F.col("rank") >= top_k) & (F.col("rank") < F.col("__best")), F.col("rank") + 1)
        .otherwise(F.col("rank"))
    )
    return rows.withColumn(
        "rank", F.when(F.coalesce(lift, F.lit(False)), moved).otherwise(F.col("rank"))
    ).drop("__n", "__best", "__bs", "__m")


def split_topk(narrow: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """k tables, then k texts; texts come from the wide list if the query has one."""
    per_type = Window.partitionBy(*QUERY, "type").orderBy("rank")
    tables = (
        narrow.filter(F.col("type") == "table")
        .withColumn("slot", F.row_number().over(per_type)).filter(F.col("slot") <= k)
    )
    source = F.when(F.col("channel") == "wide", 0).otherwise(1)
    texts = wide.unionByName(narrow.filter(F.col("type") == "text_chunk")).withColumn("__src", source)
    texts = texts.withColumn("__use", F.min("__src").over(Window.partitionBy(*QUERY))).filter("__src = __use")
    w = Window.partitionBy(*QUERY).orderBy("rank")
    texts = texts.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= k).drop("__src", "__use")
    both = tables.withColumn("__half", F.lit(0)).unionByName(texts.withColumn("__half", F.lit(1)))
    order = Window.partitionBy(*QUERY).orderBy("__half", "slot")
    return both.withColumn("final_rank", F.row_number().over(order)).drop("slot", "__half", "rank")


def mixed_slot_fill(narrow: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """Slots by the narrow ranking; its text slots are filled in turn from the wide list."""
    head = narrow.filter(F.col("rank") <= k)
    is_text = F.col("type") == "text_chunk"
    turn = F.sum(F.when(is_text, 1).otherwise(0)).over(
        Window.partitionBy(*QUERY).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    slots = head.withColumn("final_rank", F.col("rank")).withColumn("turn", F.when(is_text, turn)).drop("rank")
    fill = wide.filter(F.col("rank") <= k).select(
        *QUERY, F.col("rank").alias("turn"),
        F.struct(*[c for c in wide.columns if c not in (*QUERY, "rank")]).alias("__w"),
    )
    joined = slots.join(fill, [*QUERY, "turn"], "left")
    keep = [c for c in wide.columns if c not in (*QUERY, "rank")]
    return joined.select(
        *QUERY,
        *[F.when(F.col("__w").isNotNull(), F.col(f"__w.{c}")).otherwise(F.col(c)).alias(c) for c in keep],
        "final_rank",
    )


def distance_fallback(narrow: DataFrame, k: int) -> DataFrame:
    """Narrow list by distance when nothing was scored; unknown distances come last."""
    w = Window.partitionBy(*QUERY).orderBy(F.asc_nulls_last("distance"), "list_no", "seq")
    return narrow.withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= k)


# --- evidence text ---------------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit(""))) > 0


def _block() -> Column:
    def part(tag: str, name: str, sep: str) -> Column:
        return F.when(_filled(name), F.concat(F.lit(f"[{tag}]{sep}"), F.col(name)))

    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("[TEXT] "), F.coalesce("title", F.lit(""))),
        part("SECTION", "section_path", " "),
        F.concat(F.lit("[CONTENT]\n"), F.coalesce("content", F.lit(""))),
    )
    shown = F.when(_filled("display_name"), F.col("display_name")).otherwise(F.col("table_name"))
    prose = F.concat_ws("\n\n", F.concat(F.lit("[TABLE] "), shown), F.col("serialized"))
    raw = F.concat_ws(
        "\n\n",
        F.concat(F.lit("[TABLE] "), F.coalesce("table_name", F.lit(""))),
        part("LEGEND", "legend", " "),
        F.concat(F.lit("[HTML]\n"), F.coalesce("html", F.lit(""))),
        part("NOTES", "notes", "\n"),
        part("FOOTNOTES", "footnotes", "\n"),
    )
    return F.when(F.col("type") == "text_chunk", text).otherwise(F.when(_filled("serialized"), prose).otherwise(raw))


def format_context(matches: DataFrame) -> DataFrame:
    """Evidence of each query as one text, in rank order (at most 2k blocks per query)."""
    return (
        matches.select(*QUERY, "final_rank", _block().alias("block"))
        .groupBy(*QUERY)
        .agg(
            F.sort_array(F.collect_list(F.struct("final_rank", "block"))).alias("b"),
            F.count(F.lit(1)).alias("n_blocks"),
        )
        .select(
            *QUERY,
            "n_blocks",
            F.array_join(F.transform("b", lambda x: x["block"]), f"\n\n{SEPARATOR}\n\n").alias("context"),
        )
    )
