"""Repair of conversation structure at the least cost, by an auction algorithm for shortest paths.

A good conversation's roles are an optional system turn and then pairs of user and assistant. Four states say what has been
written so far: nothing, system, user, assistant. A lattice has a node for each place between two turns and each state;
its arcs are the edits: delete a turn (3), insert an empty turn of the role that the state asks for (2), keep a turn whose
role fits (0), give a turn the role asked for (2). Blank and repeated turns must go; a truncated turn that stays costs 1
more. Costs are whole numbers, no cycle is free.

The auction walks a path from the origin: the node at its end takes as its price the cheapest way on through its
neighbours. If that raises the price the path contracts by a node, else it extends to that neighbour; when it reaches the
target it is a shortest path. Prices start at the costs that no path avoids, so that every arc costs at least the fall in
price along it; where the two are equal the arc is tight, and the tight arcs hold all shortest paths. The least audit in
ASCII order is traced over them: in each state an edit leads to one node, so the first edit that reaches the target wins.

Long conversations never meet in one lattice. Turns are numbered over sorted ranges, blocks of `block` turns get a table of
costs between entry and exit states, tables of `block` neighbours are combined until one is left, prices of exits come back
down, each block is traced for each entry state, and the entry states follow in the same way. Only the digest of a repaired
conversation, one hash of all of it, is taken by a single reader of sorted turns, which holds a slice at a time.

Nulls: a null role or text is one space; null turns come first, in a gap they don't count; null conv_ids are a conversation
of their own. Turns of equal number come by role and the SHA-256 of the text; repeated rows are repeated turns. Roles are
told by their first character; one that is neither s, u nor a is never legal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dossier.llm.common import cut, fields, map_rows, table

BLOCK = 128
FAR = 1 << 50

# Costs and white space of the query's contract.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_WHITE = " \t\n\x0b\x0c\r"

# States: 0 nothing written, 1 system, 2 user, 3 assistant last.
_ASKED = ("user", "user", "assistant", "user")
_AFTER_ASKED = (2, 2, 3, 2)
_AFTER_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "-": {}}
_LEGAL = {"su", "ua", "au"}
_ACCEPTED = (0, 3)
_REACHES = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))  # states that may follow each state

Arcs = list[list[tuple[str, int, int]]]


# ---- shortest paths -------------------------------------------------------------------------------------------------


def auction(arcs: Arcs, price: list[int], origin: int, target: int) -> bool:
    """Raise prices until a path of tight arcs joins origin and target; False where the target cannot be reached.

    price[i] <= cost + price[j] must hold for every arc, before as after; price[target] stays.
    """
    path = [origin]
    if price[origin] >= FAR:
        return False
    while path[-1] != target:
        node = path[-1]
        best, onward = FAR, -1
        for _, cost, j in arcs[node]:
            if cost + price[j] < best:
                best, onward = cost + price[j], j
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
            elif best >= FAR:
                return False
        elif onward < 0:
            if len(path) == 1:
                return False
            path.pop()
        else:
            path.append(onward)
    return True


def least_trace(arcs: Arcs, price: list[int], origin: int, target: int) -> tuple[str, int]:
    """The labels of the path over tight arcs that come first in ASCII order, and its last node before the target."""
    path, tried, labels, dead = [origin], [0], [], set()
    while path[-1] != target:
        node = path[-1]
        for k in range(tried[-1], len(arcs[node])):
            label, cost, j = arcs[node][k]
            if price[node] == cost + price[j] and j not in dead:
                tried[-1] = k + 1
                path.append(j)
                tried.append(0)
                labels.append(label)
                break
        else:
            dead.add(node)
            path.pop()
            tried.pop()
            labels.pop()
    return "".join(labels), path[-2] if len(path) > 1 else origin


# ---- lattices -------------------------------------------------------------------------------------------------------


def turn_arcs(turns: list[tuple[str, str]], last: bool, exits: list[int] | None = None) -> tuple[Arcs, list[int]]:
    """Arcs, and prices to begin with, of the turns (initial, fault) of a block; node 4 * place + state, then the target.

    `fault` is "" (none), "t" (truncated) or "d" (must be deleted). From the last block the target is reached in an
    accepted state; from another one by an arc of the price of its exit state.
    """
    m = len(turns)
    target = 4 * (m + 1)
    arcs: Arcs = []
    for i, (initial, fault) in enumerate(turns):
        kept, extra = _AFTER_KEPT[initial], TRUNCATED if fault == "t" else 0
        for q in range(4):
            here = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + _AFTER_ASKED[q])]
            if fault != "d":
                if q in kept:
                    here.append(("K", extra, 4 * i + 4 + kept[q]))
                here.append(("R", REROLE + extra, 4 * i + 4 + _AFTER_ASKED[q]))
            arcs.append(here)
    for q in range(4):
        if last:
            arcs.append([("", 0, target)] * (q in _ACCEPTED) + [("I", INSERT, 4 * m + _AFTER_ASKED[q])])
        else:
            arcs.append([("", exits[q], target)])
    # A state that no exit follows is far from the start: inserted turns would otherwise raise its price without end.
    floor = [0] * 4 if last else [min(exits[out] for out in _REACHES[q]) for q in range(4)]
    price = list(floor)
    for _, fault in reversed(turns):
        forced = DELETE if fault == "d" else TRUNCATED if fault == "t" else 0
        floor = [min(f + forced, FAR) for f in floor]
        price = floor + price
    return arcs + [[]], price + [0]


def turn_costs(turns: list[tuple[str, str]], first: bool, last: bool) -> list[int]:
    """Least costs from each entry state to each exit state, row by row; of the last block to the end, in column 0."""
    table_ = [FAR] * 16
    for out in range(1 if last else 4):
        arcs, price = turn_arcs(turns, last, None if last else [0 if q == out else FAR for q in range(4)])
        for q in range(1 if first else 4):
            if auction(arcs, price, q, len(arcs) - 1):
                table_[4 * q + out] = price[q]
    return table_


def block_arcs(tables: list[list[int]], exits: list[int]) -> tuple[Arcs, list[int]]:
    """The lattice of neighbouring blocks: arcs between the states at their borders, then exits to the target."""
    m = len(tables)
    arcs: Arcs = [
        [("", c[4 * q + out], 4 * k + 4 + out) for out in range(4) if c[4 * q + out] < FAR]
        for k, c in enumerate(tables) for q in range(4)
    ]
    arcs += [[("", exits[q], 4 * (m + 1))] for q in range(4)] + [[]]
    floor, price = min(exits), []
    price = [floor] * 4
    for c in reversed(tables):
        floor += min(c)
        price = [floor] * 4 + price
    return arcs, price + [0]


def joint_costs(tables: list[list[int]]) -> list[int]:
    """The table of several neighbouring blocks as one."""
    joint = [FAR] * 16
    for out in range(4):
        arcs, price = block_arcs(tables, [0 if q == out else FAR for q in range(4)])
        for q in range(4):
            if auction(arcs, price, q, len(arcs) - 1):
                joint[4 * q + out] = price[q]
    return joint


def border_prices(tables: list[list[int]], exits: list[int]) -> list[list[int]]:
    """For each block the prices of its exit states, that is the costs from there to the end."""
    arcs, price = block_arcs(tables, exits)
    for node in range(4 * len(tables) + 3, 3, -1):
        if not auction(arcs, price, node, len(arcs) - 1):
            price[node] = FAR
    return [price[4 * k + 4 : 4 * k + 8] for k in range(len(tables))]


# ---- faults and order -----------------------------------------------------------------------------------------------

_ORDER = ("conv_id", "turn", "role", "sha")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after the contract's damage, which crc32 of `conv_id:turn` deals out."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    given = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20).alias("fate"),
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _given(turns: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"),
    )


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, sha, mark, pos: turns without their texts, numbered from 0 within a conversation.

    Sorted ranges are numbered task by task; what lies in earlier ranges is added for the conversations that cross a
    border between two, of which each border has at most one.
    """
    end = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    narrow = cut(_given(turns).select(
        *_ORDER, F.concat(
            F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("-")),
            F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise(F.lit(".")),
        ).alias("mark"),
    ))
    schema = "conv_id long, role string, sha binary, mark string, part long, k long"
    target = to_arrow_schema(fields(schema))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, of = TaskContext.get().partitionId(), 0, ()
        for batch in batches:
            ids = batch.column("conv_id")
            known = np.asarray(ids.is_valid())
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows, bool)
            new[1:] = (value[1:] != value[:-1]) | (known[1:] != known[:-1])
            if not batch.num_rows:
                continue
            if of == (bool(known[0]), int(value[0])):
                new[0] = False
            at = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(new, at, -1))
            k = np.where(begun < 0, seen + at, at - begun)
            seen, of = int(k[-1]) + 1, (bool(known[-1]), int(value[-1]))
            columns = [batch.column(c) for c in ("conv_id", "role", "sha", "mark")]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, target)] + [pa.array(np.full(len(k), part)), pa.array(k)], schema=target
            )

    ranged = cut(narrow.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(number, schema))
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes over each border between ranges: this side has no more rows than there are tasks.
    later = parts.withColumn("off", F.sum("n").over(before)).where("off is not null").select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), "off"
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    return ranged.join(F.broadcast(later), same, "left").select(
        "conv_id", "role", "sha", "mark", (F.col("k") + F.coalesce("off", F.lit(0))).alias("pos")
    )


def _blocks(numbered: DataFrame, block: int) -> DataFrame:
    """conv_id, b, last, turns (two letters each), counts of faults, and costs (of whole conversations: audit, cost).

    Each block meets in one row: at most `block` marks, the turn before it, the first of equal turns, the end.
    """
    firsts = numbered.groupBy("conv_id", "role", "sha").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit("1").alias("mark"))
    ends = numbered.groupBy("conv_id").agg(F.max("pos").alias("pos")).select("conv_id", "pos", F.lit("0").alias("mark"))
    marks = numbered.select("conv_id", "pos", "mark")
    all_ = marks.union(firsts).union(ends).withColumn("b", F.expr(f"pos div {int(block)}"))
    carried = marks.where(f"pos % {int(block)} = {int(block) - 1}").select("conv_id", "pos", "mark", F.expr(f"pos div {int(block)} + 1 as b"))
    met = all_.unionByName(carried).groupBy("conv_id", "b").agg(F.sort_array(F.collect_list(F.struct("pos", "mark"))).alias("marks"))
    schema = (
        "conv_id long, b long, last boolean, turns string, blank long, duplicate long, truncated long, illegal long, "
        "costs array<long>, audit string, cost long"
    )

    def make():
        def step(given):
            found = {c: [] for c in ("conv_id", "b", "last", "turns", "blank", "duplicate", "truncated", "illegal", "costs", "audit", "cost")}
            for conv_id, b, marks_ in zip(given["conv_id"], given["b"], given["marks"]):
                own = [m for m in marks_ if m["pos"] >= b * block]
                if not own:
                    continue
                first_seen = {m["pos"] for m in own if m["mark"] == "1"}
                last = any(m["mark"] == "0" for m in own)
                rows = [m for m in own if len(m["mark"]) == 2]
                faults = ["b" if m["mark"][1] == "b" else "d" if m["pos"] not in first_seen else m["mark"][1].strip(".") for m in rows]
                initials = [m["mark"][0] for m in marks_ if len(m["mark"]) == 2]
                turns = [(m["mark"][0], "d" if f in ("b", "d") else f) for m, f in zip(rows, faults)]
                whole = last and b == 0
                audit, cost, costs = None, None, None
                if whole:
                    arcs, price = turn_arcs(turns, True)
                    auction(arcs, price, 0, len(arcs) - 1)
                    audit, cost = least_trace(arcs, price, 0, len(arcs) - 1)[0], price[0]
                else:
                    costs = turn_costs(turns, b == 0, last)
                for c, v in zip(found, (
                    conv_id, b, last, "".join(i + (f or ".") for i, f in turns), faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:])), costs, audit, cost,
                )):
                    found[c].append(v)
            yield found

        return step

    return map_rows(met, schema, make)


# ---- conversations of several blocks --------------------------------------------------------------------------------


def _joined(children: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """children with `column` of the parent or block of the same conv_id and b."""
    side = parents.select(F.col("conv_id").alias("c_"), F.col("b").alias("b_"), column)
    return children.join(side, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("b") == F.col("b_"))).drop("c_", "b_")


def _families(level: DataFrame, column: str, fan: int) -> DataFrame:
    """At most `fan` neighbours in one row: conv_id, b (the parent's), family (b of the child, its `column`)."""
    return level.groupBy("conv_id", F.expr(f"b div {int(fan)}").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("b").alias("child"), F.col(column).alias("v")))).alias("family")
    )


def _levels(bottom: DataFrame, up: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    levels = [bottom]
    while levels[-1].where("b > 0").limit(1).count():
        levels.append(cut(up(levels[-1])))
    return levels


def _per_row(df: DataFrame, schema: str, columns: tuple[str, ...], rows_of: Callable[..., Iterable[tuple]]) -> DataFrame:
    """mapInArrow where each row gives the rows (of the columns of `schema`) that `rows_of(*its columns)` makes."""
    names = fields(schema).names

    def make():
        def step(given):
            made = [r for values in zip(*(given[c] for c in columns)) for r in rows_of(*values)]
            yield {n: list(v) for n, v in zip(names, zip(*made))} if made else {n: [] for n in names}

        return step

    return map_rows(df, schema, make)


def _long_audits(blocks: DataFrame, block: int) -> DataFrame:
    """conv_id, b, audit, cost of the blocks of conversations that have more than one."""
    schema = "conv_id long, b long, costs array<long>"
    levels = _levels(
        blocks.select("conv_id", "b", "costs"),
        lambda level: _per_row(_families(level, "costs", block), schema, ("conv_id", "b", "family"), lambda c, b, f: [(c, b, joint_costs([x["v"] for x in f]))]),
    )
    exits = levels[-1].select("conv_id", "b", F.array(*[F.lit(0).cast("long")] * 4).alias("exits"))
    for level in reversed(levels[:-1]):
        exits = cut(_per_row(
            _joined(_families(level, "costs", block), exits, "exits"), "conv_id long, b long, exits array<long>", ("conv_id", "family", "exits"),
            lambda c, family, out: [(c, x["child"], p) for x, p in zip(family, border_prices([x["v"] for x in family], out))],
        ))

    def traced(conv_id, b, last, letters, out):
        turns = [(letters[i], letters[i + 1].strip(".")) for i in range(0, len(letters), 2)]
        arcs, price = turn_arcs(turns, last, out)
        target, audits, after, costs = len(arcs) - 1, [], [], []
        for q in range(4):
            auction(arcs, price, q, target)
            audit, node = least_trace(arcs, price, q, target)
            audits.append(audit)
            after.append(node % 4)
            costs.append(price[q] - (0 if last else out[node % 4]))
        return [(conv_id, b, audits, after, costs)]

    ways = cut(_per_row(
        _joined(blocks, exits, "exits"), "conv_id long, b long, audits array<string>, after array<int>, costs array<long>",
        ("conv_id", "b", "last", "turns", "exits"), traced,
    ))
    levels = _levels(
        ways.select("conv_id", "b", "after"),
        lambda level: _families(level, "after", block).selectExpr(
            "conv_id", "b", "aggregate(family, array(0, 1, 2, 3), (acc, x) -> transform(acc, q -> x.v[q])) after"
        ),
    )
    entries = levels[-1].selectExpr("conv_id", "b", "0 entry")
    for level in reversed(levels[:-1]):
        passed = "aggregate(family, struct(entry as q, cast(array() as array<int>) as seen), (acc, x) -> struct(x.v[acc.q] as q, concat(acc.seen, array(acc.q)) as seen)).seen"
        entries = cut(
            _joined(_families(level, "after", block), entries, "entry")
            .selectExpr("conv_id", f"inline(zip_with(family, {passed}, (f, e) -> struct(f.child as b, e as entry)))")
        )
    return _joined(ways, entries, "entry").selectExpr("conv_id", "b", "audits[entry] audit", "costs[entry] cost")


def audits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, b, audit, cost, blank, duplicate, truncated, illegal of each block of `block` turns, in order of b."""
    blocks = cut(_blocks(_numbered(turns), block))
    counts = ("blank", "duplicate", "truncated", "illegal")
    short = blocks.where("audit is not null").select("conv_id", "b", "audit", "cost", *counts)
    long_ = blocks.where("audit is null")
    if not long_.limit(1).count():
        return short
    found = _long_audits(long_.drop("audit", "cost"), block)
    named = found.select(F.col("conv_id").alias("c_"), F.col("b").alias("b_"), "audit", "cost")
    same = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("b") == F.col("b_"))
    return short.unionByName(long_.drop("audit", "cost").join(named, same).select("conv_id", "b", "audit", "cost", *counts))


# ---- repaired conversations -----------------------------------------------------------------------------------------


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a repaired conversation; `turns` gives role and text of the turns before."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            state = _AFTER_KEPT[role[:1]][state]
        else:
            role, state = _ASKED[state], _AFTER_ASKED[state]
        yield edit, role, text


def _stream(turns: DataFrame, pieces: DataFrame, conv_ids: DataFrame | None) -> DataFrame:
    """Rows of a conversation one after the other in a task: its audit by block (kind 1), then its turns (kind 2)."""
    rows = pieces.withColumn("kind", F.lit(1)).unionByName(_given(turns).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if conv_ids is not None:
        rows = rows.unionByName(conv_ids.select(F.col("conv_id").cast("long")).distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "b", "turn", "role", "sha").drop("sha", "b")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, rows) of sorted batches; the rows of one are read before the next is asked for, a slice at a time."""
    def one_by_one():
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield from batch.slice(start, 512).to_pylist()

    source = one_by_one()
    ahead: list[dict] = []
    for r in source:
        ahead.append(r)
        break

    def own(conv_id):
        while ahead and ahead[0]["conv_id"] == conv_id:
            r = ahead.pop()
            following = next(source, None)
            if following is not None:
                ahead.append(following)
            yield r

    while ahead:
        conv_id = ahead[0]["conv_id"]
        rows = own(conv_id)
        yield conv_id, rows
        for _ in rows:
            pass


def _with_audit(rows: Iterator[dict]) -> tuple[dict, Iterator[dict]]:
    """What the rows of kind 0 and 1 say about a conversation, and its turns."""
    said = {"audit": [], "cost": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns = iter(())
    for r in rows:
        if r["kind"] == 2:
            def with_first(first=r):
                yield first
                yield from rows

            turns = with_first()
            break
        if r["kind"] == 1:
            said["audit"].append(r["audit"])
            for c in ("cost", "blank", "duplicate", "truncated", "illegal"):
                said[c] += r[c]
    said["audit"] = "".join(said["audit"])
    return said, turns


def _batched(rows: Iterable[tuple], target: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*some), target)], schema=target)

    for r in rows:
        some.append(r)
        if len(some) == size:
            yield packed()
            some = []
    if some:
        yield packed()


def repaired_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of the repaired conversations: conv_id, no (from 0), edit (K, R or I), role, text."""
    schema = "conv_id long, no long, edit string, role string, text string"
    target = to_arrow_schema(fields(schema))

    def run(batches):
        def rows():
            for conv_id, given in _conversations(batches):
                said, own = _with_audit(given)
                for no, (edit, role, text) in enumerate(edited(said["audit"], ((r["role"], r["text"]) for r in own))):
                    yield conv_id, no, edit, role, text

        yield from _batched(rows(), target)

    return _stream(turns, cut(audits(turns, block)), None).mapInArrow(run, schema)


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, n_turns long, n_repaired long"
)


def repair_summary(turns: DataFrame, conv_ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation, also for those of `conv_ids` that have no turn: faults, cost, audit, hash of the repair."""
    target = to_arrow_schema(fields(SUMMARY))

    def run(batches):
        def rows():
            for conv_id, given in _conversations(batches):
                said, own = _with_audit(given)
                span = [None, None, 0, 0]  # least, greatest, distinct numbers of turns; turns

                def watched():
                    for r in own:
                        span[3] += 1
                        if r["turn"] is not None and r["turn"] != span[1]:
                            span[0] = r["turn"] if span[0] is None else span[0]
                            span[1] = r["turn"]
                            span[2] += 1
                        yield r["role"], r["text"]

                digest, made, source = hashlib.sha256(), 0, watched()
                for _, role, text in edited(said["audit"], source):
                    digest.update(f"{chr(10) if made else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    made += 1
                gaps = 0 if span[0] is None else span[1] - span[0] + 1 - span[2]
                yield (
                    conv_id, gaps, said["blank"], said["duplicate"], said["truncated"], said["illegal"], said["cost"], said["audit"],
                    digest.hexdigest(), span[3], made,
                )

        yield from _batched(rows(), target)

    return _stream(turns, cut(audits(turns, block)), conv_ids).mapInArrow(run, SUMMARY)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_summary(damage(conversations), conversations)


OP11_SQL = r"""
with recursive given as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
fated as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)),
    4294967295::bigint) % 20 fate from given),
damaged as (select conv_id, turn, case fate when 4 then 'user' else r end r, case fate when 1 then '' when 2 then translate(t, '.!?', '') else t end t,
    unnest(case fate when 3 then [0, 1] else [0] end) from fated where fate <> 0),
placed as (select conv_id, turn, r, t, row_number() over (partition by conv_id order by turn nulls first, r, sha256(t)) i from damaged),
ended as (select *, regexp_extract(t, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) e, row_number() over (partition by conv_id, r, t order by i) seen,
    r[1:1] c, lag(r[1:1]) over (partition by conv_id order by i) || r[1:1] two from placed),
turns as (select *, case when e = '' then 'b' when seen > 1 then 'd' when e not in ('.', '!', '?') then 't' else '' end fault from ended),
state(conv_id, i, q, best, made) as (
  select c.conv_id, 0::bigint, [0, 2, 3][n + 1], lpad((2 * n)::varchar, 8, '0') || repeat('I', n::int), ['user:', 'assistant:'][1:n]
  from (select distinct conv_id from turns) c, range(3) x(n)
  union all
  select conv_id, i, q, min(best), arg_min(made, best) from (
    select conv_id, i, [[q, 2, 3], [q, 2, 3], [q, 3, 2], [q, 2, 3]][q + 1][n + 1] q,
      lpad((cost + 2 * n)::varchar, 8, '0') || audit || repeat('I', n::int) best,
      list_concat(made, (case when q = 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end)[1:n]) made
    from (
      select s.conv_id, s.i + 1 i, s.best[1:8]::int + case edit when 'D' then 3 when 'R' then 2 else 0 end + case when edit <> 'D' and fault = 't' then 1 else 0 end cost,
        s.best[9:] || edit audit,
        case edit when 'D' then s.q when 'R' then [2, 2, 3, 2][s.q + 1] else case c when 's' then 1 when 'u' then 2 else 3 end end q,
        case edit when 'D' then made when 'R' then list_append(made, case when s.q = 2 then 'assistant:' else 'user:' end || t) else list_append(made, r || ':' || t) end made
      from state s join turns on turns.conv_id is not distinct from s.conv_id and turns.i = s.i + 1, (values ('D'), ('K'), ('R')) e(edit)
      where edit = 'D' or fault not in ('b', 'd') and (edit = 'R' or c = 's' and s.q = 0 or c = 'u' and s.q <> 2 or c = 'a' and s.q = 2)), range(3) x(n))
  group by conv_id, i, q),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'b') blank,
    count(*) filter (where fault = 'd') duplicate, count(*) filter (where fault = 't') truncated,
    count(*) filter (where two is not null and (two not in ('su', 'ua', 'au') or c = '')) illegal, count(*) n from turns group by 1),
best as (select s.conv_id, min(best) best, arg_min(made, best) made from state s join counts on counts.conv_id is not distinct from s.conv_id
  where i = n and q in (0, 3) group by 1),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(best[1:8]::bigint, 0) cost, coalesce(best[9:], '') audit,
  sha256(coalesce(array_to_string(made, chr(10)), '')) repaired_sha256, coalesce(n, 0) n_turns, coalesce(len(made), 0)::bigint n_repaired
from ids left join counts on counts.conv_id is not distinct from ids.conv_id left join best on best.conv_id is not distinct from ids.conv_id
"""
