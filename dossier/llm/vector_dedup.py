"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered lexicographically by a concatenation of random hashes (cells of random projections),
so that near vectors tend to stand near each other. Each is compared with its `WINDOW` neighbours, and the window is
widened to the whole run of vectors that share the first hashes of their keys: a run is compared in tiles, however long it
is and whatever ranges it was sorted into. How many hashes make a run is chosen for each label by the pairs that measured
runs would compare, never none; the number of passes follows from that, so that a pair at the limit shares no run with
probability at most `MISS`, whatever stands around it. `exact=True` compares each label as one run instead; so does a limit
so low that near vectors share no hash.

Pairs at or above the cosine limit, checked in double precision, are united over all passes into components. Inside a
component all pairs are then compared in blocks, so that link counts are exact for what the passes connect.

Only vectors of equal label and length are compared. Vectors that are null, empty or zero, hold null or non-finite
components, or have a null label link with nothing. Equal vectors of a label are one from the start and count as linked.
Repeated rows are copies of each other. Null ids never name a component that has another id.

Sorting is by ranges of (label, length, pass, hashes), so a hot label is cut where its hashes differ. Comparison holds a
batch and a window; tiles hold two blocks of `RUN_BLOCK` or `BLOCK` vectors; equal vectors never meet.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import components, cut, map_rows, table

COSINE = 0.98
HASHES = 16  # of a key; a run shares the first of them
MISS = 1e-5  # probability that no pass puts a pair at the limit into one run
CELL = 1.0  # width of a hash cell; a projection of a unit vector has variance 1
WINDOW = 12
BLOCK = 1024
RUN_BLOCK = 4096
MEASURED = 20_000  # vectors of a label whose runs are measured, to choose a depth; they decide cost only
ROW_COST = 2000.0  # of moving a vector to its tile, in compared pairs


def clean_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, node (hash of label and vector; null where the vector links with nothing), label, dim, unit (float64 bytes)."""

    def unit(label, values):
        if label is None or not values or any(v is None for v in values):
            return None
        x = np.array(values, float)
        with np.errstate(over="ignore"):
            big = np.abs(x).max()
        if not np.isfinite(x).all() or big == 0:
            return None
        return x

    def make():
        def step(given):
            out = {"vec_id": given["vec_id"], "label": given["label"], "node": [], "dim": [], "unit": []}
            for label, values in zip(given["label"], given["embedding"]):
                x = unit(label, values)
                if x is None:
                    node = dim = scaled = None
                else:
                    node, dim = hashlib.md5(f"{label}/".encode() + (x + 0.0).tobytes()).digest(), len(x)
                    x = x / np.abs(x).max()  # before squaring, against overflow
                    scaled = (x / np.linalg.norm(x)).tobytes()
                out["node"].append(node)
                out["dim"].append(dim)
                out["unit"].append(scaled)
            yield out

        return step

    schema = "vec_id long, label long, node binary, dim int, unit binary"
    return map_rows(rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding"), schema, make)


def run_passes(depth: int, limit: float) -> int | None:
    """Passes after which a pair at the limit has shared a run of `depth` hashes but for MISS; None if out of reach."""
    agree = 1 - math.sqrt(max(0.0, 2 - 2 * limit)) * math.sqrt(2 / math.pi) / CELL  # at least this, at each hash
    together = agree**depth if agree > 0 or not depth else 0.0
    if together >= 1:
        return 1
    n = math.log(MISS) / math.log1p(-together) if together > 1e-3 else math.inf
    return math.ceil(n) if n <= 1000 else None


def hashed(nodes: DataFrame, passes: int, hashes: int = HASHES, seed: int = 11) -> DataFrame:
    """A row per node and pass: label, dim, pass, key (concatenated hashes, in sorting order), depth, node, unit.

    Nodes have `depth`, the hashes of a run, and `n_passes`: they are in the first n_passes of the `passes` only.
    """

    def make():
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def step(given):
            for dim in set(given["dim"]):
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = rng.normal(size=(dim, passes * hashes)), rng.uniform(0, CELL, passes * hashes)
                at = [i for i, d in enumerate(given["dim"]) if d == dim]
                x = np.frombuffer(b"".join(given["unit"][i] for i in at)).reshape(len(at), dim)
                g, shift = planes[dim]
                cell = np.clip(np.floor((x @ g + shift) / CELL) + 128, 0, 255).astype(np.uint8).reshape(len(at), passes, hashes)
                each = [(k, p) for k, i in enumerate(at) for p in range(given["n_passes"][i])]
                take = lambda name: [given[name][at[k]] for k, _ in each]
                yield {
                    "label": take("label"), "dim": [dim] * len(each), "pass": [p for _, p in each],
                    "key": [cell[k, p].tobytes() for k, p in each], "depth": take("depth"), "node": take("node"), "unit": take("unit"),
                }

        return step

    schema = "label long, dim int, pass int, key binary, depth int, node binary, unit binary"
    return map_rows(nodes.select("label", "dim", "node", "unit", "depth", "n_passes"), schema, make)


def window_links(ordered: DataFrame, limit: float, window: int) -> DataFrame:
    """Links (a, b) between rows at most `window` apart in the order of their partition, within a label, length and pass."""

    def run(batches):
        held = None
        for batch in batches:
            group = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("label", "dim", "pass")], 1)
            node, unit = batch.column("node").to_pylist(), batch.column("unit").to_pylist()
            if held is not None:
                group, node, unit = np.concatenate([held[0], group]), held[1] + node, held[2] + unit
            a, b = [], []
            for dim in np.unique(group[:, 1]):
                at = np.flatnonzero(group[:, 1] == dim)
                x = np.frombuffer(b"".join(unit[i] for i in at)).reshape(len(at), dim)
                for s in range(1, min(window, len(at) - 1) + 1):
                    near = np.einsum("ij,ij->i", x[s:], x[:-s]) >= limit
                    near &= (group[at[s:]] == group[at[:-s]]).all(1)
                    for i in np.flatnonzero(near):
                        a.append(node[at[i]])
                        b.append(node[at[i + s]])
            held = group[-window:], node[-window:], unit[-window:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return ordered.mapInArrow(run, "a binary, b binary")


def run_depths(nodes: DataFrame, limit: float, exact: bool = False) -> DataFrame:
    """label, dim, depth, n_passes: the cheapest runs of each label and length, by the pairs that they would compare.

    depth 0, one run of the whole label, is taken if `exact`, or where no other depth can hold the limit.
    """
    spark = nodes.sparkSession
    sizes = cut(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.ceil(F.col("n") / MEASURED)))
    some = nodes.join(sizes, ["label", "dim"]).where("pmod(xxhash64(node), step) = 0").drop("n", "step")
    some = some.withColumns({"depth": F.lit(HASHES), "n_passes": F.lit(2)})
    keys = hashed(some, 2, seed=12).groupBy("label", "dim", "pass", "key").agg(F.count(F.lit(1)).alias("n"))
    runs = keys.select("label", "dim", "pass", "n", "key", F.explode(F.sequence(F.lit(1), F.lit(HASHES))).alias("depth"))
    runs = runs.groupBy("label", "dim", "pass", "depth", F.expr("substring(key, 1, depth)").alias("key")).agg(F.sum("n").alias("n"))
    pairs = runs.groupBy("label", "dim", "depth").agg((F.sum(F.col("n") * (F.col("n") - 1.0)) / 2).alias("pairs"))
    pairs = pairs.join(sizes, ["label", "dim"]).withColumn("pairs", F.col("pairs") * F.col("step") * F.col("step")).drop("step")
    whole = sizes.select("label", "dim", F.lit(0).alias("depth"), (F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs"), "n")
    passes = [(d, n) for d in range(1 if exact else HASHES + 1) if (n := run_passes(d, limit))]
    cost = pairs.unionByName(whole).join(F.broadcast(spark.createDataFrame(passes, "depth int, n_passes int")), "depth")
    cost = cost.withColumn("cost", F.col("n_passes") * (F.col("pairs") + F.col("n") * ROW_COST))
    best = cost.groupBy("label", "dim").agg(F.min(F.struct(F.col("depth") == 0, "cost", "depth", "n_passes")).alias("b"))
    return cut(best.select("label", "dim", "b.depth", "b.n_passes"))


def run_links(keyed: DataFrame, limit: float, block: int = RUN_BLOCK) -> DataFrame:
    """Links (a, b) that connect all that is linked inside runs: every pair of a run is compared, in tiles."""
    runs = keyed.withColumn("key", F.expr("substring(key, 1, depth)"))
    run = ["label", "dim", "pass", "key"]
    sizes = runs.groupBy(*run).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*run, F.ceil(F.col("n") / block).cast("int").alias("k"))
    placed = runs.join(sizes, run).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    each = placed.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tile = [*run, "lo", "hi"]
    tiles = each.select(*run, F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "node", "unit")
    tiles = tiles.repartition(*tile).sortWithinPartitions(*tile)

    def make():
        held: list[tuple] = []

        def links():
            """A link for each two parts of a tile that become one."""
            side, node = np.array([r[6] for r in held]), [r[7] for r in held]
            x = np.frombuffer(b"".join(r[8] for r in held)).reshape(len(held), held[0][1])
            i, j = np.flatnonzero(side == held[0][4]), np.flatnonzero(side == held[0][5])
            part, a, b = np.arange(len(held)), [], []
            for at in range(0, len(i), 512):
                near = x[i[at : at + 512]] @ x[j].T >= limit
                for r in np.flatnonzero(near.any(1)):
                    one, others = i[at + r], j[near[r]]
                    own = part[one]
                    parts, first = np.unique(part[others], return_index=True)
                    first = first[parts != own]
                    if len(first):
                        a += [node[one]] * len(first)
                        b += [node[k] for k in others[first]]
                        part[np.isin(part, parts)] = own
            held.clear()
            return {"a": a, "b": b}

        def step(given):
            for row in zip(*(given[n] for n in (*tile, "c", "node", "unit"))):
                if held and held[0][:6] != row[:6]:
                    yield links()
                held.append(row)

        step.rest = lambda: [links()] if held else []
        return step

    return map_rows(tiles, "a binary, b binary", make)


def link_counts(members: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """node, n: copies of other nodes of the component that are linked. `members` has comp, dim, node, unit, copies."""
    sizes = members.groupBy("comp").agg((F.count(F.lit(1)) / block + 1).cast("int").alias("k"))
    placed = members.join(sizes, "comp").withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    each = placed.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = each.select("comp", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "dim", "node", "unit", "copies")
    tiles = tiles.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")

    def make():
        held: list[tuple] = []

        def count():
            """Counts inside a tile: within its one block, or between its two."""
            side = np.array([r[3] for r in held])
            x = np.frombuffer(b"".join(r[5] for r in held)).reshape(len(held), held[0][6])
            copies = np.array([r[7] for r in held])
            lo, hi = held[0][1], held[0][2]
            i, j = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            near = x[i] @ x[j].T >= limit
            if lo == hi:
                np.fill_diagonal(near, False)
                n = near @ copies
                out = {"node": [r[4] for r in held], "n": n}
            else:
                out = {"node": [held[k][4] for k in [*i, *j]], "n": np.concatenate([near @ copies[j], near.T @ copies[i]])}
            held.clear()
            return out

        def step(given):
            for row in zip(*(given[n] for n in ("comp", "lo", "hi", "c", "node", "unit", "dim", "copies"))):
                if held and held[0][:3] != row[:3]:
                    yield count()
                held.append(row)

        step.rest = lambda: [count()] if held else []
        return step

    return map_rows(tiles, "node binary, n long", make).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, limit: float = COSINE, window: int = WINDOW, exact: bool = False) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. `exact` compares each label as one run."""
    given = cut(clean_vectors(rows))
    # Narrow counts first: of equal vectors one travels.
    nodes = cut(
        given.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
                                                             F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    )
    depths = run_depths(nodes, limit, exact)
    most = depths.agg(F.coalesce(F.max("n_passes"), F.lit(1))).first()[0]
    keyed = hashed(nodes.join(depths, ["label", "dim"]), most)
    order = ["label", "dim", "pass", "key", "node"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    links = window_links(ordered, limit, window).union(run_links(keyed, limit))
    comps = cut(components(links))
    members = nodes.join(comps, "node")
    counts = link_counts(members, limit)
    info = cut(nodes.select("node", "copies").join(comps, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ))
    placed = cut(given.where("node is not null").select("vec_id", "node").join(info, "node").select("vec_id", "n_links", "comp"))
    least = placed.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    linked = placed.join(least, "comp").select("vec_id", "n_links", "component_id")
    alone = given.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
  and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id a, vec_id b from v union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a, min(b) component_id from reach group by 1), n as (select a, count(*) n from l group by 1)
select vec_id, coalesce(n.n, 0)::bigint n_links, coalesce(component_id, vec_id) component_id, vec_id = coalesce(component_id, vec_id) kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""
