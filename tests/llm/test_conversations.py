import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from dossier.llm import conversations as co
from tests.llm.frames import crowded, rows

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(given):
    out = []
    for conv_id, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) by a queue of whole paths, cheapest first, then by audit: nothing of prices or blocks.

    turns: (role, text, must go, truncated). A place and a state are left once, by their first path off the queue.
    """
    asked, after = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    queue, left = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, q, made = heapq.heappop(queue)
        if i == len(turns) and q in (0, 3):
            return cost, audit, made
        if (i, q) in left:
            continue
        left.add((i, q))
        heapq.heappush(queue, (cost + 2, audit + "I", i, after[q], made + ((asked[q], ""),)))
        if i < len(turns):
            role, text, must_go, truncated = turns[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, q, made))
            if not must_go:
                if (role[:1], q) in kept:
                    heapq.heappush(queue, (cost + truncated, audit + "K", i + 1, kept[role[:1], q], made + ((role, text),)))
                heapq.heappush(queue, (cost + 2 + truncated, audit + "R", i + 1, after[q], made + ((asked[q], text),)))


def plain(turns, conv_ids):
    out = []
    for conv_id in set(conv_ids):
        own = [t for t in turns if t[0] == conv_id]
        own.sort(key=lambda t: (t[1] is not None, t[1] or 0, t[2].encode(), hashlib.sha256(t[3].encode()).digest()))
        numbers = [t[1] for t in own if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, coded, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            coded.append((role, text, fault in (0, 1), int(fault == 2)))
        initials = [t[2][:1] for t in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = cheapest(coded)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv_id, gaps, *counts, illegal, cost, audit, sha))
    return sorted(out, key=str)


def made_up(seed, convs, most, odd=0.1):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        for turn in range(r.randint(1, most)):
            role = ("user", "assistant")[turn % 2] if turn or r.random() < 0.7 else "system"
            if r.random() < 4 * odd:
                role = r.choice(["user", "assistant", "system", "tool", "", "uncle", None, "User"])
            text = r.choice(["Yes.", "no end", "Well? ", " \t", "", None, "A!\n", "é.", "long text. " * 40, f"only here {turn}."])
            out.append((c if r.random() > odd / 2 else None, turn if r.random() > odd else r.choice([None, turn - 1, turn + 3]), role, text))
    return out


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4])
def test_every_short_conversation(length):
    kinds = [(i, f) for i in "sua-" for f in ("", "t", "d")]
    words = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    for n, turns in enumerate(itertools.product(kinds, repeat=length)):
        if length == 4 and n % 7:
            continue
        arcs, price = co.turn_arcs(list(turns), True)
        assert co.auction(arcs, price, 0, len(arcs) - 1)
        assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for _, c, j in out)
        want = cheapest([(words[i], str(k), f == "d", int(f == "t")) for k, (i, f) in enumerate(turns)])
        audit, _ = co.least_trace(arcs, price, 0, len(arcs) - 1)
        assert (price[0], audit) == want[:2]
        made = tuple((r, t) for _, r, t in co.edited(audit, iter([(words[i], str(k)) for k, (i, _) in enumerate(turns)])))
        assert made == want[2]


@pytest.mark.parametrize("block", [2, 5, 128])
def test_rows_equal_plain_search(spark, block):
    given = made_up(block, 25, 22) + [(900, 0, "user", "Hi."), (900, 0, "user", "Hi."), (901, 5, None, None), (902, 2**40, "system", "S.")]
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    found = co.repair_summary(co.damage(crowded(df)), df, block)
    assert sorted(rows(found, *NAMES), key=str) == plain(damaged(given), [g[0] for g in given])


def test_one_conversation_holds_most_turns(spark):
    r = random.Random(3)
    given = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "no", f"{t}.", f"{t}"])) for t in range(700)]
    given += [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in range(2, 40) for t in range(4)]
    df = spark.createDataFrame(given, SCHEMA).repartition(6)
    found = co.repair_summary(df, df, 4)
    assert sorted(rows(found, *NAMES), key=str) == plain([(c, t, ro, x) for c, t, ro, x in given], [g[0] for g in given])


def test_conversations_without_turns_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert co.repair_summary(co.damage(empty), empty).count() == 0
    ids = spark.createDataFrame([(7, 0, "user", "x"), (None, 0, "user", "x")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows(co.repair_summary(empty, ids), *NAMES) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in (None, 7)]


def test_repaired_turns_are_whole_and_legal(spark):
    given = made_up(11, 30, 12)
    df = spark.createDataFrame(given, SCHEMA)
    out = co.repaired_turns(df, 4).collect()
    by_conv = {}
    for r in out:
        by_conv.setdefault(r["conv_id"], []).append(r)
    found = {r["conv_id"]: r for r in co.repair_summary(df, df, 4).collect()}
    for conv_id, turns in by_conv.items():
        turns.sort(key=lambda r: r["no"])
        roles = "".join(r["role"][0] for r in turns)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)
        sha = hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest()
        assert sha == found[conv_id]["repaired_sha256"] and len(turns) == found[conv_id]["n_repaired"]
