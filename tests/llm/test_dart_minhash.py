import random

import numpy as np

from dossier.llm import dart_minhash as d
from dossier.llm.common import alnum_words
from tests.llm.frames import DOCS, crowded, rows


def brute_classes(texts, limit=0.8):
    """Smallest id reachable by links between texts with words; ids are places."""
    sets = []
    for t in texts:
        w = alnum_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= limit * len(a | b):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return comp


def corpus(seed=3):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = say(rng.choice([8, 40, 120, 600]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 5])):
            edited = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 25])):
                edited[rng.randrange(len(edited))] = "new"
            texts.append(" ".join(edited))
    chain = say(300)  # each is near the next, the ends are not near each other
    for step in range(0, 90, 9):
        texts.append(" ".join(chain[step : step + 200]))
    shared = say(60)
    texts += [" ".join(shared + say(15)) for _ in range(6)]
    return texts + [None, "", "...", "two words", "Two, WORDS!", "one", texts[0], texts[0].upper()]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = crowded(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS))
    want = brute_classes(texts)
    assert rows(d.near_duplicates(docs), "doc_id", "component_id", "kept") == [(i, c, i == c) for i, c in enumerate(want)]
    kept = d.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == [(i,) for i, c in enumerate(want) if i == c]


def test_two_dense_groups_in_shared_buckets(spark):
    """Groups that meet in buckets are joined only through the one pair that links them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for shift in (0, 1):
        for _ in range(15):
            w = base[:160] + [f"s{shift}{i}" for i in range(40)]
            w[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    want = brute_classes(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert rows(d.near_duplicates(docs, bands=60, rows=2), "doc_id", "component_id") == list(enumerate(want))


def test_small_tiles(spark, monkeypatch):
    """Clusters that are cut into many tiles give the same classes."""
    monkeypatch.setattr(d, "TILE_TEXTS", 3)
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert rows(d.near_duplicates(docs), "doc_id", "component_id") == list(enumerate(brute_classes(texts)))


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(3, text, "en", "s", 0), (3, text, "en", "s", 0), (7, text, "en", "s", 0), (3, "other words in this one", "en", "s", 0),
                                  (None, text, "en", "s", 0), (None, None, "en", "s", 0)], DOCS)
    got = rows(d.near_duplicates(docs), "doc_id", "component_id", "kept")
    assert got == [(None, None, True)] * 2 + [(3, 3, True)] * 3 + [(7, 3, False)]
    assert rows(d.keep_one_of_each(docs), "doc_id", "text") == [(None, None), (None, text), (3, text), (3, "other words in this one")]
    empty = spark.createDataFrame([], DOCS)
    assert d.near_duplicates(empty).count() == 0 and d.keep_one_of_each(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [pool[:1000], pool[200:1200], pool[:1], pool[2000:2003], pool]
    sig = d.dart_signatures(sets, 512)
    assert (sig != 0).all()
    agree = (sig[0] == sig[1]).mean()
    assert abs(agree - 800 / 1200) < 0.08
    assert abs((sig[0] == sig[4]).mean() - 1 / 3) < 0.08
    assert (d.dart_signatures([sets[1]], 512)[0] == sig[1]).all()
    w = [np.full(100, 2.0), np.full(100, 1.5), np.full(100, 0.25)]
    weighted = d.dart_signatures([pool[:100]] * 3, 1024, w)
    assert abs((weighted[0] == weighted[1]).mean() - 0.75) < 0.06 and abs((weighted[0] == weighted[2]).mean() - 0.125) < 0.05
    plain = d.dart_signatures([pool[:100]], 64, [np.ones(100)])
    assert plain.shape == (1, 64)
