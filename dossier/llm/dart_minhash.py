"""MinHash near-duplicates by DartMinHash signatures and banded joins.

Texts are sets of shingles (`WIDTH` words; a shorter text is one shingle) hashed to 64 bits. Every shingle is a region of
its weight, and darts fall on it by a hashed random process: each dart has a rank and a coordinate, and a signature keeps
the earliest dart of each coordinate. Only ranks up to a limit that falls with the text's weight are thrown, so that a
signature takes about as many darts as coordinates need, however long the text is; where a coordinate stays empty, the
limit is doubled. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Texts that agree in a band are candidates, and a candidate pair is a link if the exact similarity of the whole shingle
sets reaches `SIMILARITY`. Pairs are never written out. Buckets with a text in common form clusters (found through one
link of each member to its bucket's smallest text), and the texts of a cluster meet in tiles of bounded size, where each
is compared with all others that are not yet in its class: first by the signatures' last bytes, with a margin of six
deviations, then by whole sets. A tile gives back a link for each two classes it joins, so no class that links could
join stays apart, and what leaves a tile is linear in its texts. Nothing is capped.

Equal texts (same words) are one text from the start. Null texts and texts without words link with nothing. Rows with a
null doc_id link with nothing and are kept. Repeated rows are copies of each other. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import alnum_words, components, cut, map_rows, table

WIDTH = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6  # a pair of similarity 0.8 misses all bands with a probability of 6 in a million
TILE_TEXTS = 512  # texts of one side of a tile, and their shingles, about
TILE_SHINGLES = 4_000_000
MARGIN = 6.0  # deviations by which a signature may fall short of a pair that is compared as a whole

_U = np.uint64
# Constants of a public 64-bit mixing function.
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_FOLD = _U(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `width` words, ascending."""
    import xxhash

    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, _U)
    for i in range(min(width, len(words))):
        out = out * _STEP + h[i : i + n]
    return np.unique(mix(out))


def weighted_cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of weighted elements: a hash for each cell, and the share of the cell that the element fills."""
    cells = np.ceil(weights).astype(np.int64)
    first = np.repeat(np.cumsum(cells) - cells, cells)
    no = np.arange(cells.sum()) - first
    filled = np.minimum(1.0, np.repeat(weights, cells) - no)
    return mix(np.repeat(elements, cells) + no.astype(_U) * _M1), filled


def dart_signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """Signatures (len(sets), k) of non-empty sets of 64-bit elements; weights are 1 where not given."""
    if not sets:
        return np.zeros((0, k), _U)
    if weights is None:
        cells, fill, total = sets, None, np.array([len(s) for s in sets], float)
    else:
        both = [weighted_cells(s, w) for s, w in zip(sets, weights)]
        cells, fill, total = [c for c, _ in both], np.concatenate([f for _, f in both]), np.array([w.sum() for w in weights])
    flat, owner = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    limit = (k * np.log(k) + 2 * k) / total
    sig = np.zeros(len(sets) * k, _U)
    open_sets = np.ones(len(sets), bool)
    while open_sets.any():
        at = np.flatnonzero(open_sets[owner])
        e, own = flat[at], owner[at]
        part = None if fill is None else fill[at]
        rank, lim, throw = np.zeros(len(e)), limit[own], 0
        best = np.full(len(sets) * k, np.inf)
        darts = []
        while len(e):
            throw += 1
            h = mix(e + _U(int(_STEP) * throw % (1 << 64)))
            rank = rank - np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0**-53)
            near = rank <= lim
            e, own, rank, lim, h = e[near], own[near], rank[near], lim[near], h[near]
            slot = own * k + (mix(h ^ _M2) % _U(k)).astype(np.int64)
            if part is not None:
                part = part[near]
                hit = ((mix(h ^ _M1) >> _U(11)).astype(float) * 2.0**-53) < part
                darts.append((slot[hit], rank[hit], h[hit]))
            else:
                darts.append((slot, rank, h))
            if len(e):
                np.minimum.at(best, darts[-1][0], darts[-1][1])
        for slot, at_rank, h in darts:
            first = at_rank == best[slot]
            sig[slot[first]] = h[first]
        open_sets &= ~np.isfinite(best).reshape(-1, k).all(1)
        limit = limit * 2
    return sig.reshape(-1, k)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, different for equal values in different bands."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _STEP, (len(signatures), bands)).copy()
    for i in range(rows):
        out = mix(out * _FOLD + parts[:, :, i])
    return out.view(np.int64)


def words_key(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, key (of the words), n (shingles; 0 without words), bands, sketch (last byte of each coordinate)."""

    def make():
        def step(given):
            words = [alnum_words(t) for t in given["text"]]
            keys = [words_key(w) for w in words]
            own = {k: w for k, w in zip(keys, words) if w}
            sets = {k: shingles(w, width) for k, w in own.items()}
            sig = dart_signatures(list(sets.values()), bands * rows)
            of = dict(zip(sets, bands_of(sig, bands, rows)))
            bytes_of = dict(zip(sets, map(bytes, sig.astype(np.uint8))))
            yield {
                "doc_id": given["doc_id"], "key": keys, "n": [len(sets.get(k, ())) for k in keys],
                "bands": [of[k] if k in of else [] for k in keys], "sketch": [bytes_of.get(k) for k in keys],
            }

        return step

    return map_rows(docs.select("doc_id", "text"), "doc_id long, key binary, n int, bands array<long>, sketch binary", make, rows=256)


class Classes:
    """Classes of the numbers below n; joined ones share a name."""

    def __init__(self, n: int) -> None:
        self.name = np.arange(n)

    def join(self, a: int, b: int) -> None:
        self.name[self.name == self.name[b]] = self.name[a]


def tile_links(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes of a tile's texts. With two sides, only texts of different sides are compared."""
    n, k = sketches.shape
    sizes = np.array([len(s) for s in sets])
    agree = similarity + (1 - similarity) / 256
    enough = k * agree - MARGIN * np.sqrt(k * agree * (1 - agree))
    classes, links = Classes(n), []
    two = len(np.unique(side)) > 1

    def similar(i: int, others: np.ndarray) -> np.ndarray:
        """Exact similarity of set i with other sets."""
        flat = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        ends = np.cumsum(sizes[others])
        common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), ends - sizes[others])
        return common >= similarity * (sizes[i] + sizes[others] - common)

    for i in range(1, n):
        before = np.flatnonzero(side[:i] != side[i]) if two else np.arange(i)
        before = before[np.minimum(sizes[before], sizes[i]) >= similarity * np.maximum(sizes[before], sizes[i])]
        before = before[classes.name[before] != classes.name[i]]
        if not len(before):
            continue
        score = (sketches[before] == sketches[i]).sum(1)
        before, score = before[score >= enough], score[score >= enough]
        # The likeliest text of each class first: most classes need no other.
        before = before[np.argsort(-score, kind="stable")]
        _, best = np.unique(classes.name[before], return_index=True)
        for part in (before[np.sort(best)], before):
            part = part[classes.name[part] != classes.name[i]]
            for at in range(0, len(part), 256):
                chunk = part[at : at + 256]
                for j in chunk[similar(i, chunk)] if len(chunk) else ():
                    if classes.name[j] != classes.name[i]:
                        classes.join(int(i), int(j))
                        links.append((int(i), int(j)))
    return links


def cluster_links(docs: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) within clusters. `members`: doc_id, key, cluster, n, sketch; each key once."""
    sizes = members.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / TILE_TEXTS + F.sum("n") / TILE_SHINGLES).cast("int").alias("tiles")
    )
    placed = members.join(sizes, "cluster")
    placed = placed.withColumn("c", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).withColumnRenamed("doc_id", "id")

    def make_sets():
        def step(given):
            out = {n: [] for n in ("cluster", "tiles", "c", "key", "sketch", "set")}
            for row in zip(*(given[n] for n in ("cluster", "tiles", "c", "key", "sketch", "text"))):
                words = alnum_words(row[5])
                if words_key(words) == row[3]:  # else another text with the same doc_id
                    for name, value in zip(out, (*row[:5], shingles(words, width).tobytes())):
                        out[name].append(value)
            yield out

        return step

    texts = docs.select("doc_id", "text").join(placed, F.col("doc_id") == F.col("id"))
    with_sets = map_rows(
        texts.select("cluster", "tiles", "c", "key", "sketch", "text"),
        "cluster binary, tiles int, c int, key binary, sketch binary, set binary", make_sets, rows=128,
    )
    each = with_sets.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = each.select("cluster", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "key", "sketch", "set")
    order = ["cluster", "lo", "hi"]

    def make_links():
        held: dict[bytes, tuple] = {}  # one of each key, should a row repeat
        current: list = [None]

        def compare():
            rows = list(held.values())
            found = tile_links(
                [np.frombuffer(r[2], _U) for r in rows], np.stack([np.frombuffer(r[1], np.uint8) for r in rows]),
                np.array([r[0] for r in rows]), similarity,
            ) if len(rows) > 1 else []
            names = list(held)
            held.clear()
            return {"a": [names[i] for i, _ in found], "b": [names[j] for _, j in found]}

        def step(given):
            for *tile, c, key, sketch, members in zip(*(given[n] for n in (*order, "c", "key", "sketch", "set"))):
                if held and current[0] != tile:
                    yield compare()
                current[0] = tile
                held[key] = (c, sketch, members)

        step.rest = lambda: [compare()] if held else []
        return step

    return map_rows(tiles.repartition(*order).sortWithinPartitions(*order, "key"), "a binary, b binary", make_links, rows=64)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, key, component_id (smallest doc_id reachable by links), kept."""
    named = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))
    signed = cut(signatures(named, bands, rows, width))
    entries = signed.where("n > 0").select("key", F.explode("bands").alias("h"))
    shared = cut(entries.groupBy("h").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead <> last").select("h", "lead"))
    near = entries.join(shared, "h").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    clusters = cut(components(near).select(F.col("node").alias("key"), F.col("comp").alias("cluster")))
    one = signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    sketches = signed.select("doc_id", "key", "sketch").dropDuplicates(["doc_id", "key"])
    members = one.join(clusters, "key").join(sketches, ["doc_id", "key"])
    links = cluster_links(named, cut(members), width, similarity)
    return _classes(signed, cut(components(links)))


def _classes(signed: DataFrame, comps: DataFrame) -> DataFrame:
    of = comps.select(F.col("node").alias("key"), "comp")
    placed = cut(signed.where("n > 0").select("doc_id", "key").join(of, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    grouped = placed.join(least, "comp").select("doc_id", "key", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = signed.where("n = 0").select("doc_id", "key", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without the copies: of each class the smallest doc_id stays, once; all columns stay."""
    decided = cut(near_duplicates(docs))
    many = decided.where("kept and doc_id is not null").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = cut(decided.where("not kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.lit(False).alias("__many"))
               .unionByName(many.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.lit(True).alias("__many"))).distinct())

    @F.pandas_udf("binary")
    def key_of(texts):
        return texts.map(lambda t: words_key(alnum_words(t)))

    keyed = docs.withColumn("__key", key_of("text"))
    match = (keyed["doc_id"] == gone["__id"]) & (keyed["__key"] == gone["__k"])
    kept = keyed.join(gone, match, "left_anti").select(*docs.columns)
    if gone.where("__many").isEmpty():
        return kept
    # Rows that repeat both id and words and are kept: one of each.
    again = gone.where("__many").join(gone.where("not __many").select("__id", "__k"), ["__id", "__k"], "left_anti")
    rows = keyed.join(again, (keyed["doc_id"] == again["__id"]) & (keyed["__key"] == again["__k"]))
    return kept.unionByName(rows.dropDuplicates(["doc_id", "__key"]).select(*docs.columns))
