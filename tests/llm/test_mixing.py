import hashlib
import re
from collections import defaultdict

import pytest

from dossier.llm import mixing
from tests.llm.frames import DOCS, crowded


def targets_by_rounds(sizes):
    """Share by weight, cap at three times the size, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, {s for s in names if sizes[s] == 0}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def make_docs(spark, n=400):
    rows = []
    for i in range(n):
        source = [None, "a", "b", "ü", "Z", "tiny", "empty"][i % 6] if i % 3 else "a"
        text = None if i % 41 == 0 else " \t".join(["wörd"] * ((i * 37) % 90)) + "\x1c\xa0"[: i % 3]
        rows.append((i, text, "en", source, 0))
    rows += [(n, "one two", "en", "tiny2", 0), (n + 1, "", "en", "empty", 0), (5, rows[5][1], "en", rows[5][3], 0), (None, "x y z", "en", None, 0)]
    return crowded(spark.createDataFrame(rows, DOCS)), rows


def plain_mix(given, points, step=mixing.GOLDEN):
    """taken and first slot of every row, slot by slot and word by word."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, _, s, _ in given]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    target, total = targets_by_rounds(sizes), sum(sizes.values())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    block = max(1, total // points)
    stream = {s: [w for row in sorted((r for r in enumerate(sized) if r[1][1] == s), key=lambda r: (r[1][3], r[1][0] is not None, r[1][0] or 0)) for w in [row[0]] * row[1][2]] for s in names}
    ends, upto = [], 0.0
    for s in names:
        if target[s] > 0:
            upto += target[s]
            ends.append((upto / sum(target.values()), s))
    taken, first, at = [0] * len(given), [None] * len(given), defaultdict(int)
    for slot in range(-(-total // block)):
        u = (slot + 1) * step % 1.0
        s = next((s for end, s in ends if u < end), ends[-1][1])
        for _ in range(block):
            if at[s] < 3 * len(stream[s]):
                row = stream[s][at[s] % len(stream[s])]
                at[s] += 1
                taken[row] += 1
                first[row] = slot if first[row] is None else first[row]
    return target, sizes, [(*r[:3], t, f) for r, t, f in zip(sized, taken, first)]


def order(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("points", [60, 700, 1_000_000])
def test_mix_equals_the_schedule_played_slot_by_slot(spark, points, monkeypatch):
    docs, given = make_docs(spark)
    monkeypatch.setattr(mixing, "POINTS", points)
    monkeypatch.setattr(mixing, "CHUNK", 16 if points < 1000 else 4096)
    got = mixing.mix(docs).collect()
    target, sizes, want = plain_mix(given, points)
    assert sorted(((r["doc_id"], r["source"], r["size"], r["taken"], r["first_slot"]) for r in got), key=order) == sorted(want, key=order)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
    took = defaultdict(int)
    for r in got:
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - target[s]) <= 4 * got[0]["block_words"] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


@pytest.mark.parametrize("step", [0.5, 0.3819, 0.0])
def test_another_schedule_gives_another_mix(spark, step, monkeypatch):
    docs, given = make_docs(spark)
    monkeypatch.setattr(mixing, "POINTS", 700)
    result = lambda: sorted((r["doc_id"], r["taken"], -1 if r["first_slot"] is None else r["first_slot"]) for r in mixing.mix(docs).collect() if r["doc_id"] is not None)
    golden = result()
    monkeypatch.setattr(mixing, "GOLDEN", step)
    other = result()
    assert golden != other
    assert sorted((i, t, -1 if f is None else f) for i, _, _, t, f in plain_mix(given, 700, step)[2] if i is not None) == other


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    only = spark.createDataFrame([(1, None, "en", None, 0), (2, "", "en", "a", 0)], DOCS)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(only).collect()] == [(0, 0.0, 0)] * 2
