"""Exact nearest neighbours without pairing every query with every document in the plan.

Documents stay where they are. Each task compares its Arrow batches with a bounded block of
queries and gives back only its own best k per query and pool; Spark merges those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.lineage import cut

# Query block kept by a task; beyond it, queries and documents are split into blocks.
MAX_QUERY_FLOATS = 8_000_000
MAX_QUERY_ROWS = 20_000
MAX_RESULT_ROWS = 1_000_000  # of one task, over all its queries and pools
DOC_BLOCK_FLOATS = 4_000_000
PAIRS = 20_000  # compared exactly at once
TILE_QUERIES, TILE_DOCS = 256, 8_192  # compared roughly at once
MET_AGAIN = 4  # times k: with more documents of a tile below the bar, the tile's own k-th lowers it
ALL = (1 << 31) - 1  # k of a pool that takes every document


@dataclass(frozen=True)
class Pool:
    """The k nearest documents of one type (None: of all types)."""

    channel: str
    k: int
    type: str | None = None


def _exact(docs: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances row by row."""
    if metric == "cosine":
        norms = np.sqrt((docs * docs).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
        return 1.0 - (docs * q).sum(axis=1) / np.where(norms == 0, 1.0, norms)
    return ((docs - q) ** 2).sum(axis=1)


def _rough(docs: np.ndarray, qs: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances by one matrix product, and how far they may be off."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        return 1.0 - unit(qs) @ unit(docs).T, 1e-9
    dd, qq = (docs * docs).sum(axis=1), (qs * qs).sum(axis=1)
    scale = float(dd.max(initial=0.0) + qq.max(initial=0.0))
    return qq[:, None] + dd[None, :] - 2.0 * (qs @ docs.T), 1e-9 * (1.0 + scale)


class _Best:
    """Running best k per (query, pool) inside one task, for queries of one knowledge base."""

    def __init__(self, queries: np.ndarray, pools: Sequence[Pool], metric: str) -> None:
        self.queries, self.pools, self.metric = queries, pools, metric
        # by pool and first query of a tile: rows are merged tile by tile, so that little more is held than what is kept
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bars = [np.full(len(queries), np.inf) for _ in pools]  # distance of the k-th that is kept: none farther is wanted

    def add(self, ids: np.ndarray, types: np.ndarray, vectors: np.ndarray, some: np.ndarray | None = None) -> None:
        """Compare documents with all queries, or with `some` (their places, in order)."""
        asked = np.arange(len(self.queries)) if some is None else some
        tiles = [(lo, asked[np.searchsorted(asked, lo):np.searchsorted(asked, lo + TILE_QUERIES)]) for lo in range(0, len(self.queries), TILE_QUERIES)]
        for p, pool in enumerate(self.pools):
            mask = slice(None) if pool.type is None else types == pool.type
            docs, names = vectors[mask], ids[mask]
            for at in range(0, len(names), TILE_DOCS):
                for lo, rows in tiles:
                    if len(rows):
                        self._add(p, lo, rows, pool.k, names[at:at + TILE_DOCS], docs[at:at + TILE_DOCS])

    def _add(self, p: int, lo: int, asked: np.ndarray, k: int, names: np.ndarray, docs: np.ndarray) -> None:
        block = self.queries[asked]
        rough, slack = _rough(docs, block, self.metric)
        limit, nth = self.bars[p][asked] + slack, min(k, len(names)) - 1
        wanted = rough <= limit[:, None]
        if np.count_nonzero(wanted) > MET_AGAIN * k * len(block):
            limit = np.minimum(limit, np.partition(rough, nth, axis=1)[:, nth] + slack)
            wanted = rough <= limit[:, None]
        rows, near = np.nonzero(wanted)
        parts = [self.kept[p, lo]] if (p, lo) in self.kept else []
        for at in range(0, len(rows), PAIRS):
            r, n = rows[at:at + PAIRS], near[at:at + PAIRS]
            parts.append((asked[r], _exact(docs[n], block[r], self.metric), names[n]))
        if not parts:  # distances that are no numbers
            return
        query, dist, name = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((name, dist, query))
        query, dist, name = query[order], dist[order], name[order]
        first = np.searchsorted(query, query)  # place of the first row of the same query
        best = np.arange(len(query)) - first < k
        self.kept[p, lo] = query, dist, _ = query[best], dist[best], name[best]
        full = np.flatnonzero(np.bincount(query - lo) == k) + lo
        self.bars[p][full] = dist[np.searchsorted(query, full, side="right") - 1]

    def frames(self, kb: object, query_ids: np.ndarray) -> Iterator[pd.DataFrame]:
        """What is kept, a frame for each tile of queries and pool."""
        for (p, _), (q, dist, name) in self.kept.items():
            yield pd.DataFrame({"kb": kb, "query_id": query_ids[q], "channel": self.pools[p].channel, "doc_id": name, "distance": dist})


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype("float64")


def _with_base(df: DataFrame) -> DataFrame:
    """Rows without a knowledge base belong to one unnamed base."""
    return df if "kb" in df.columns else df.withColumn("kb", F.lit(""))


def vector_pools(
    queries: DataFrame,
    docs: DataFrame,
    pools: Sequence[Pool],
    metric: str = "l2sq",
    max_query_rows: int = MAX_QUERY_ROWS,
    doc_block_floats: int = DOC_BLOCK_FLOATS,
) -> DataFrame:
    """Nearest documents of every query in its own knowledge base, for several pools in one pass.

    `queries`: kb, query_id, embedding. `docs`: kb, doc_id, type, embedding (kb may be missing
    in both: one base). Ties go by doc_id. Result: kb, query_id, channel, doc_id, distance,
    seq (1 = nearest). What a task gives back is bounded by its queries and pools.
    """
    pools = list(pools)
    q = _with_base(queries).select("kb", "query_id", "embedding").filter(F.col("embedding").isNotNull())
    d = _with_base(docs).select("kb", "doc_id", "type", "embedding").filter(F.col("embedding").isNotNull())
    q_type, d_type = q.schema["query_id"].dataType.simpleString(), d.schema["doc_id"].dataType.simpleString()
    schema = f"kb string, query_id {q_type}, channel string, doc_id {d_type}, distance double"

    head = q.limit(1).toPandas()
    if len(head) == 0:
        return q.sparkSession.createDataFrame([], schema + ", seq int")
    width = max(1, len(head["embedding"].iloc[0]))
    cap = query_cap(pools, width, max_query_rows)
    block = q.limit(cap + 1).toPandas()
    if len(block) <= cap:
        shared = q.sparkSession.sparkContext.broadcast(
            {kb: (part["query_id"].to_numpy(), _matrix(part["embedding"])) for kb, part in block.groupby("kb")}
        )

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = {kb: _Best(matrix, pools, metric) for kb, (_, matrix) in shared.value.items()}
            for b in batches:
                for kb, part in b.groupby("kb"):
                    if kb in best:
                        best[kb].add(part["doc_id"].to_numpy(), part["type"].to_numpy(), _matrix(part["embedding"]))
            for kb, found in best.items():
                yield from found.frames(kb, shared.value[kb][0])

        found = d.mapInPandas(local, schema)
    else:
        found = _by_blocks(q, d, pools, metric, schema, cap, max(1, doc_block_floats // width))
    w = Window.partitionBy("kb", "query_id", "channel").orderBy("distance", "doc_id")
    size = F.create_map(*[F.lit(x) for p in pools for x in (p.channel, p.k)])
    most = max(p.k for p in pools)
    return (
        found.withColumn("seq", F.row_number().over(w))
        .filter(F.col("seq") <= most)  # constant bound: lets Spark limit groups before the shuffle
        .filter(F.col("seq") <= size[F.col("channel")])
    )


def query_cap(pools: Sequence[Pool], width: int, max_query_rows: int = MAX_QUERY_ROWS) -> int:
    """Queries that one task may hold."""
    return max(1, min(max_query_rows, MAX_QUERY_FLOATS // width, MAX_RESULT_ROWS // sum(min(p.k, 1000) for p in pools)))


def _met_blocks(q: DataFrame, d: DataFrame, query_rows: int, doc_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and documents with __q and __d: within a base each block of queries meets each block of documents."""
    n = lambda rows: F.ceil(F.count(F.lit(1)) / max(1, rows)).cast("int")
    n_q, n_d = q.groupBy("kb").agg(n(query_rows).alias("n_q")), d.groupBy("kb").agg(n(doc_rows).alias("n_d"))
    blocks = cut(n_q.join(n_d, "kb"))  # one row per base
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    left = q.join(blocks, "kb").withColumn("__q", part("query_id", "n_q")).withColumn("__d", numbers("n_d"))
    right = d.join(blocks, "kb").withColumn("__d", part("doc_id", "n_d")).withColumn("__q", numbers("n_q"))
    return left, right


def _by_blocks(
    q: DataFrame, d: DataFrame, pools: list[Pool], metric: str, schema: str, cap: int, doc_block_rows: int
) -> DataFrame:
    """More queries than a task may hold: within each base, bounded query blocks meet bounded document blocks."""
    left, right = _met_blocks(q, d, cap // 2, doc_block_rows)

    def meet(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ds):
            return pd.DataFrame(columns=["kb", "query_id", "channel", "doc_id", "distance"])
        best = _Best(_matrix(qs["embedding"]), pools, metric)
        best.add(ds["doc_id"].to_numpy(), ds["type"].to_numpy(), _matrix(ds["embedding"]))
        found = list(best.frames(qs["kb"].iloc[0], qs["query_id"].to_numpy()))
        return pd.concat(found) if found else pd.DataFrame(columns=["kb", "query_id", "channel", "doc_id", "distance"])

    keys = ["kb", "__q", "__d"]
    return (
        left.select(*keys, "query_id", "embedding").groupBy(*keys)
        .cogroup(right.select(*keys, "doc_id", "type", "embedding").groupBy(*keys)).applyInPandas(meet, schema)
    )


def vector_topk(queries: DataFrame, docs: DataFrame, k: int, metric: str = "l2sq", **limits: int) -> DataFrame:
    """The k nearest documents of every query in its base."""
    found = vector_pools(queries, docs, [Pool("all", k)], metric, **limits).drop("channel")
    return found if "kb" in queries.columns else found.drop("kb")


def vector_topk_by_type(
    queries: DataFrame, docs: DataFrame, type_: str, k: int, metric: str = "l2sq", **limits: int
) -> DataFrame:
    """The k nearest documents of one type; the type filter reaches the stored data first."""
    found = vector_pools(queries, docs.filter(F.col("type") == type_), [Pool(type_, k)], metric, **limits).drop("channel")
    return found if "kb" in queries.columns else found.drop("kb")


RANKED = 4_000  # queries ranked at once
LEAF = 128  # different vectors of a group
LISTS = 64  # of a large base
ROUTED_ROWS = 100_000  # documents of a base, beyond which dealing them to lists costs less than showing them to all queries


class _Nearer:
    """Documents of one block, to be counted by distance: different vectors in groups around their middle."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray, metric: str) -> None:
        self.metric = metric
        self.names, code = np.unique(names, return_inverse=True)
        distinct, which, counts = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
        which = which.ravel()
        leaves = _leaves(distinct) if metric == "l2sq" else [np.arange(len(distinct))]
        order = np.concatenate(leaves)
        self.vectors, self.counts = distinct[order], counts[order]
        self.bounds = np.append(0, np.cumsum([len(x) for x in leaves]))
        place = np.empty(len(order), dtype="int64")
        place[order] = np.arange(len(order))
        self.keys = np.sort(place[which] * (len(self.names) + 1) + code)  # documents by vector, then by name
        self.first = np.append(0, np.cumsum(self.counts))
        parts = [self.vectors[lo:hi] for lo, hi in zip(self.bounds, self.bounds[1:])]
        self.middles = np.stack([x.mean(axis=0) for x in parts])
        self.radii = np.array([np.sqrt(((x - m) ** 2).sum(axis=1).max()) for x, m in zip(parts, self.middles)])

    def count(self, queries: np.ndarray, away: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each query how many documents are nearer than `away`, or as near with a smaller name than `own`."""
        before, name = np.zeros(len(queries), dtype="int64"), np.searchsorted(self.names, own)
        if self.metric == "l2sq":
            inside, outside = _apart(self.middles, self.radii, queries, away)
            before += inside @ np.add.reduceat(self.counts, self.bounds[:-1])
            open_ = ~(inside | outside)
        else:
            open_ = np.ones((len(queries), len(self.middles)), dtype=bool)
        for g in np.flatnonzero(open_.any(axis=0)):
            lo, hi = self.bounds[g], self.bounds[g + 1]
            asked = np.flatnonzero(open_[:, g])
            step = max(1, TILE_QUERIES * TILE_DOCS // (hi - lo))
            for at in range(0, len(asked), step):
                some = asked[at:at + step]
                before[some] += self._compared(lo, hi, queries[some], away[some], name[some])
        return before

    def _compared(self, lo: int, hi: int, queries: np.ndarray, away: np.ndarray, name: np.ndarray) -> np.ndarray:
        vectors = self.vectors[lo:hi]
        rough, slack = _rough(vectors, queries, self.metric)
        nearer = (rough < away[:, None] - slack) @ self.counts[lo:hi]
        i, j = np.nonzero(np.abs(rough - away[:, None]) <= slack)  # decided exactly
        close = np.concatenate([_exact(vectors[j[at:at + PAIRS]], queries[i[at:at + PAIRS]], self.metric) for at in range(0, len(i), PAIRS)] or [np.zeros(0)])
        tied = np.searchsorted(self.keys, (j + lo) * (len(self.names) + 1) + name[i]) - self.first[j + lo]
        n = np.where(close < away[i], self.counts[j + lo], np.where(close == away[i], tied, 0))
        return nearer + np.bincount(i, weights=n, minlength=len(queries)).astype("int64")


def _apart(middles: np.ndarray, radii: np.ndarray, queries: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and group around a middle: is all of it nearer than `away`, is all of it farther."""
    rough, slack = _rough(middles, queries, "l2sq")
    apart, far = np.sqrt(np.maximum(rough, 0.0)), np.sqrt(np.maximum(away, 0.0))[:, None]
    spare = radii + 2.0 * np.sqrt(slack) + 1e-9 * (apart.max(initial=0.0) + radii.max(initial=0.0))
    return apart + spare < far, apart - spare > far


def _leaves(vectors: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of at most LEAF, halved along the number that differs most."""
    done, todo = [], [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        some = vectors[rows]
        by = np.argpartition(some[:, np.argmax(some.max(axis=0) - some.min(axis=0))], len(rows) // 2)
        todo += [rows[by[:len(rows) // 2]], rows[by[len(rows) // 2:]]]
    return done


def own_ranks(queries: DataFrame, docs: DataFrame, metric: str = "l2sq", query_rows: int = 40_000, doc_rows: int = 40_000) -> DataFrame:
    """kb, query_id, rank of each query's own document (`own`) among all documents of its base, however far down.

    `queries`: kb, query_id, own, embedding. Nothing but counts leaves a block: how many documents are nearer, or as near with
    a smaller doc_id. Inside a block, equal vectors are compared once and vectors lie in small groups: a group that is wholly
    nearer or wholly farther than the own document is counted or passed over, only the others are compared vector by vector.
    Documents of a large base are dealt to lists around centroids first, and a query meets only the lists that are neither.
    A document that is not in the base has no rank (null).
    """
    q = queries.select("kb", "query_id", "own", "embedding")
    d = docs.select("kb", "doc_id", "embedding").filter(F.col("embedding").isNotNull())
    q_type = q.schema["query_id"].dataType.simpleString()
    pairs = q.filter(F.col("embedding").isNotNull()).join(
        d.select("kb", F.col("doc_id").alias("own"), F.col("embedding").alias("mine")), ["kb", "own"]
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                away = _exact(_matrix(b["mine"]), _matrix(b["embedding"]), metric)
                yield b[["kb", "query_id", "own", "embedding"]].assign(away=away)

    known = cut(pairs.mapInPandas(measure, f"kb string, query_id {q_type}, own {q.schema['own'].dataType.simpleString()}, embedding array<float>, away double"))

    def count(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ds):
            return pd.DataFrame({"kb": [], "query_id": [], "before": []})
        near = _Nearer(_matrix(ds["embedding"]), ds["doc_id"].to_numpy(), metric)
        before = []
        for lo in range(0, len(qs), RANKED):
            some = qs.iloc[lo:lo + RANKED]
            before.append(near.count(_matrix(some["embedding"]), some["away"].to_numpy(), some["own"].to_numpy()))
        return pd.DataFrame({"kb": qs["kb"].to_numpy(), "query_id": qs["query_id"].to_numpy(), "before": np.concatenate(before)})

    counts = f"kb string, query_id {q_type}, before long"
    largest = d.groupBy("kb").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if metric == "l2sq" and largest > max(doc_rows, ROUTED_ROWS):
        counted = _counted_in_lists(known, d, count, counts, query_rows, doc_rows)
    else:
        left, right = _met_blocks(known, d, query_rows, doc_rows)
        counted = _cogrouped(left, right, ["kb", "__q", "__d"], count, counts)
    ranks = counted.groupBy("kb", "query_id").agg((F.sum("before") + 1).alias("rank"))
    return q.select("kb", "query_id").join(ranks, ["kb", "query_id"], "left")


def _cogrouped(left: DataFrame, right: DataFrame, keys: list[str], count, counts: str) -> DataFrame:
    return (
        left.select(*keys, "query_id", "own", "embedding", "away").groupBy(*keys)
        .cogroup(right.select(*keys, "doc_id", "embedding").groupBy(*keys)).applyInPandas(count, counts)
    )


def _counted_in_lists(known: DataFrame, d: DataFrame, count, counts: str, query_rows: int, doc_rows: int) -> DataFrame:
    """kb, query_id, before: documents before the own one, in parts: lists wholly nearer at once, open ones document by document.

    A list is open to a query if its own document's distance falls between the list's nearest and farthest point. A list of
    many documents, or one open to many queries, is met in blocks of at most `doc_rows` and `query_rows`.
    """
    from dossier.operators.vector_index import MAX_CENTROID_FLOATS, train_centroids

    name = F.concat(F.lit("="), F.col("kb"))  # a base may be called anything, also nothing
    docs, asked = d.filter(F.col("kb").isNotNull()).withColumn("kb", name), known.withColumn("kb", name)
    spark, schema = d.sparkSession, lambda df: df.schema.simpleString().removeprefix("struct<").removesuffix(">")
    centroids = train_centroids(docs, max_lists=LISTS)
    if centroids.count() * len(centroids.first()["centroid"]) > MAX_CENTROID_FLOATS:  # many bases: each is small
        left, right = _met_blocks(known, d, query_rows, doc_rows)
        return _cogrouped(left, right, ["kb", "__q", "__d"], count, counts)
    middles = spark.sparkContext.broadcast({
        kb: (part["list"].to_numpy(), _matrix(part["centroid"])) for kb, part in centroids.toPandas().groupby("kb")
    })

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kb, part in b.groupby("kb"):
                numbers, m = middles.value[kb]
                vectors = _matrix(part["embedding"])
                near = _rough(m, vectors, "l2sq")[0].argmin(axis=1)
                yield part.assign(list=numbers[near], off=np.sqrt(_exact(m[near], vectors, "l2sq")))

    listed = cut(docs.mapInPandas(place, f"{schema(docs)}, list int, off double"))
    balls = listed.groupBy("kb", "list").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).toPandas()
    around = {}
    for kb, part in balls.groupby("kb"):
        numbers, m = middles.value[kb]
        around[kb] = part["list"].to_numpy(), m[np.searchsorted(numbers, part["list"])], part["n"].to_numpy(), part["radius"].to_numpy()
    shared = spark.sparkContext.broadcast(around)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kb, part in b.groupby("kb"):
                numbers, m, n, radii = shared.value[kb]
                inside, outside = _apart(m, radii, _matrix(part["embedding"]), part["away"].to_numpy())
                yield part.assign(before=inside @ n, open=[numbers[x] for x in ~(inside | outside)])

    routed = cut(asked.mapInPandas(route, f"{schema(asked)}, before long, open array<int>"))
    opened = routed.select("kb", "query_id", "own", "embedding", "away", F.explode("open").alias("list"))
    of = lambda c, rows: F.ceil(F.col(c) / max(1, rows)).cast("int")
    parts = opened.groupBy("kb", "list").agg(F.count(F.lit(1)).alias("n_q")).join(
        spark.createDataFrame(balls[["kb", "list", "n"]], "kb string, list int, n long"), ["kb", "list"]
    )
    blocks = F.broadcast(cut(parts.select("kb", "list", of("n_q", query_rows).alias("n_q"), of("n", doc_rows).alias("n_d"))))  # a row for each list
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    left = opened.join(blocks, ["kb", "list"]).withColumn("__q", part("query_id", "n_q")).withColumn("__d", every("n_d"))
    right = listed.join(blocks, ["kb", "list"]).withColumn("__d", part("doc_id", "n_d")).withColumn("__q", every("n_q"))
    met = _cogrouped(left, right, ["kb", "list", "__q", "__d"], count, counts)
    return routed.select("kb", "query_id", "before").unionByName(met).withColumn("kb", F.expr("substr(kb, 2)"))
