import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dossier.llm import lm_scoring as lm
from dossier.llm.common import learning_row
from tests.llm.frames import DOCS, crowded


def corpus(seed=4, n=160):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "ing", "ß", "é", "a", "to"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts = []
    for _ in range(n):
        texts.append(" ".join(rng.choice(["the", "The", "of", word(), word()]) + rng.choice(["", ".", ",\n"]) for _ in range(rng.randint(1, 150))))
    return texts + [None, "", " \t\n", "x" * 3000, "\x1c \xa0 odd", texts[0]]


def test_base_score_and_counts(spark, monkeypatch):
    texts = corpus()
    docs = crowded(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "the end", "en", "s", 0), (3, "the other", "en", "s", 0)], DOCS))
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    given = list(enumerate(texts)) + [(None, "the end"), (3, "the other")]
    learn = [t for i, t in given if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learn for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for head in (100_000, 5):
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        got = lm.score_texts(docs, docs.where(learning_row(7, 2))).collect()
        assert len(got) == len(given)
        by = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r for r in got}
        for i, t in given:
            own = tokens(t)
            base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
            r = by[(i, len(own), round(base, 6))]
            assert r["n_known"] == sum(counts[w] > 0 for w in own) and r["train_tokens"] == total
            assert r["score"] < 0 and math.isfinite(r["score"])
        same = sorted(r["score"] for r in got if r["doc_id"] in (0, len(texts) - 1))
        assert same[0] == pytest.approx(same[-1], rel=1e-5)
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 and r["doc_id"] < 160]
    # On held-out texts the model is far better than guessing among all ids, and orders texts as word counts do.
    bits = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) / math.log10(2)
    assert -bits < 14
    assert np.corrcoef([r["score"] for r in held], [r["base_score"] for r in held])[0, 1] > 0.95


def test_no_learning_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    got = sorted(lm.score_texts(docs, docs.where("false")).collect())
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm.score_texts(spark.createDataFrame([], DOCS), docs.where("false")).count() == 0


def test_classes_come_from_all_learning_rows(spark, monkeypatch):
    """A language in 12 of 2,412 texts: its words are counted and clustered like those of a corpus in memory."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "stone river light garden window silver house water paper green black white north south table glass train horse cloud field music story night world".split() for b in ("", "s", "ed", "ing", "er")]
    rare = ["квартира", "молоко", "хлеб", "дорога", "зима"]
    texts = [" ".join(rng.choices(rare if i % 201 == 0 else words, k=20)) for i in range(2412)]
    taken = []

    def keep(of, classes, symbols, columns):
        taken.append((classes, symbols, columns))
        raise StopIteration

    monkeypatch.setattr(lm, "gather", keep)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    with pytest.raises(StopIteration):
        lm.score_texts(docs, docs)
    ranks = lm.read_ranks()
    subwords = lm.Subwords(ranks)
    ids = [subwords.ids([lm.plain_words(t)], len(ranks))[0] for t in texts]
    for got, want in zip(taken[0], lm.cluster_classes(ids, len(ranks) + 1)):
        assert np.array_equal(got, want)
    own = np.unique(np.concatenate([ids[i] for i in range(0, 2412, 201)]))
    assert (taken[0][0][own] < lm.CLASSES - lm.RARE_CLASSES).all()


def test_attention_learns_from_all_windows(spark, monkeypatch):
    """Every target of long and short texts stands in one window; weights do not move with partitions; none without texts."""
    monkeypatch.setattr(lm, "START_WINDOWS", 16)
    monkeypatch.setattr(lm, "TASK_WINDOWS", 24)
    texts = ["the end of a long story " * 60, "two words", "", "short text of one window"] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    subwords = lm.Subwords(ranks := lm.read_ranks())
    ids = [subwords.ids([lm.plain_words(t)], len(ranks))[0] for t in texts]
    classes, symbols, columns = lm.cluster_classes(ids, len(ranks) + 1)
    follow = np.log(np.full((lm.SYMBOLS, lm.CLASSES), 1 / lm.CLASSES))
    weights = []
    for n in (1, 7):
        stored = lm.read(docs.repartition(n), ranks).where("ids is not null").select("doc_id", "ids")
        found = lm.gather(stored, classes, symbols, columns).where("window is not null").select("doc_id", "start", "window")
        targets = Counter()
        for r in found.collect():
            aims = np.frombuffer(r["window"], np.uint16)[lm.WINDOW :]
            targets.update((r["doc_id"], r["start"] + k, int(a)) for k, a in enumerate(aims) if a != lm.PADDED)
        assert targets == Counter((i, k, int(a)) for i, x in enumerate(ids) for k, a in enumerate(x))
        weights.append(lm.trained(found, lm.AttentionModel(follow), classes, symbols).flat())
    assert np.allclose(weights[0], weights[1], atol=1e-6) and not np.allclose(weights[0], lm.AttentionModel(follow).flat())
    none = lm.trained(found.where("false"), lm.AttentionModel(follow), classes, symbols)
    assert not none.p["out"].any() and not none.p["groups"].any()


def test_runs_give_all_windows_and_stay_near_the_size_of_ids(spark):
    """Windows overlap, but stored runs of them hardly do; cut out again they are those of the plain definition."""
    rng, end, most = np.random.default_rng(7), 300, lm.RUN * lm.STRIDE
    texts = {i: [*rng.integers(0, end, n).tolist(), end] for i, n in enumerate((0, 1, 23, 24, 25, most - 1, most, 3 * most + 30))}
    classes, symbols, columns = lm.cluster_classes([np.array(x) for x in texts.values()], end + 1)
    stored = spark.createDataFrame([(i, np.array(x, np.uint16).tobytes()) for i, x in texts.items()], "doc_id long, ids binary")
    runs = lm.gather(stored, classes, symbols, columns).where("window is not null").collect()
    assert sum(len(r["window"]) for r in runs if r["doc_id"] == 7) < 1.3 * 2 * len(texts[7])  # windows alone: 2.33
    for i, x in texts.items():
        own = sorted((r for r in runs if r["doc_id"] == i), key=lambda r: r["start"])
        s, c = lm._window_arrays([r["window"] for r in own], classes, symbols)
        line = [end] * (lm.PAD + 1) + x[:-1] + [end] * lm.WINDOW
        starts = range(0, len(x), lm.STRIDE)
        aims = [[classes[x[a + k]] if a + k < len(x) else -1 for k in range(lm.STRIDE)] for a in starts]
        assert c.tolist() == aims
        inside = [[line[a + k] if a + k < len(x) + lm.PAD else end for k in range(lm.WINDOW)] for a in starts]
        assert s.tolist() == symbols[np.array(inside)].tolist()


def test_sides_are_counted_without_a_table_of_all(spark, monkeypatch):
    """A task keeps the cells that it saw (a table of vocabulary x 512 was 103 MB), and may give them away in parts."""
    import tracemalloc

    rng, made, vocabulary = np.random.default_rng(2), [], 50_001
    texts = [np.append(rng.zipf(1.2, 900) % 3000, vocabulary - 1) for _ in range(40)]
    counts = np.bincount(np.concatenate(texts), minlength=vocabulary)
    stored = spark.createDataFrame([(i, x.astype(np.uint16).tobytes()) for i, x in enumerate(texts)], "doc_id long, ids binary")
    want = lm.cluster_classes([x.astype(np.int32) for x in texts], vocabulary)
    for held in (lm.HELD_CELLS, 500):
        monkeypatch.setattr(lm, "HELD_CELLS", held)
        with monkeypatch.context() as patch:
            patch.setattr(lm, "map_rows", lambda df, schema, make: made.append(make) or df)
            patch.setattr(lm, "summed", lambda rows: (np.zeros(0, int), np.zeros(0, int)))
            lm.learnt_classes(stored, counts)
        tracemalloc.start()
        step, cells = made[-1](), Counter()
        ids = [x.astype(np.uint16).tobytes() for x in texts]
        parts = [part for at in range(0, 40, 8) for part in step({"ids": ids[at : at + 8]})] + list(step.rest())
        assert tracemalloc.get_traced_memory()[1] < 30e6
        tracemalloc.stop()
        for part in parts:
            for at, n in zip(part["id"], part["n"]):
                cells[int(at)] += int(n)
        at = np.array(sorted(cells))
        for got, expected in zip(lm.classes_of(counts, at, np.array([cells[k] for k in at])), want):
            assert np.array_equal(got, expected)


def test_windows_score_each_place_once():
    for length in (1, 23, 24, 25, 48, 49, 500):
        lengths = np.array([length, 3, length])
        owner, start = lm.windows_of(lengths)
        for text in range(3):
            seen = Counter(s + p for o, s in zip(owner, start) if o == text for p in range(lm.STRIDE) if s + p < lengths[text])
            assert seen == Counter(range(lengths[text]))


def test_inputs_stand_one_place_behind_targets():
    lengths, end = np.array([3, 1, 4]), 99
    target = np.array([1, 2, end, end, 5, 6, 7, end])
    given, begin = lm.inputs_of(target, lengths, end)
    ends = [end] * (lm.PAD + 1)
    assert given.tolist() == [*ends, 1, 2, *ends, *ends, 5, 6, 7]
    assert begin.tolist() == [0, lm.PAD + 3, 2 * lm.PAD + 4]


def test_scores_do_not_depend_on_neighbours():
    model, rng = small_model(3)
    texts = [np.append(rng.integers(0, 99, n), 99) for n in (0, 5, 30, 200)]
    classes, symbols, columns = lm.cluster_classes(texts, 100)
    shares = lm.Shares(rng.integers(0, 50, 100), rng.integers(0, 9, (lm.CLASSES, lm.FREQUENT + lm.CLASSES)), classes, columns)
    scorer = lm.Scorer(model, symbols, shares, 99)
    together = scorer.score(np.concatenate(texts), np.array([len(t) for t in texts]), batch=3)
    for t, score in zip(texts, together):
        assert scorer.score(t, np.array([len(t)]))[0] == pytest.approx(score, rel=1e-5)


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    follow = rng.normal(size=(lm.SYMBOLS, lm.CLASSES))
    follow -= np.log(np.exp(follow).sum(1, keepdims=True))
    return lm.AttentionModel(follow), rng


def test_gradients_equal_differences():
    model, rng = small_model()
    model.group, model.inside = model.group.astype(np.float64), model.inside.astype(np.float64)
    model.p = {n: (x + rng.normal(size=x.shape) * 0.2).astype(np.float64) for n, x in model.p.items()}
    s, c = rng.integers(0, 20, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.STRIDE))
    _, g = model.gradients(s, c)
    for name in model.NAMES:
        for _ in range(4):
            at = tuple(rng.integers(0, n if name != "embed" or k else 20) for k, n in enumerate(model.p[name].shape))
            old, step = model.p[name][at], 1e-3
            model.p[name][at] = old + step
            up = model.gradients(s, c)[0]
            model.p[name][at] = old - step
            down = model.gradients(s, c)[0]
            model.p[name][at] = old
            assert (up - down) / (2 * step) == pytest.approx(float(g[name][at]), abs=2e-5, rel=2e-2)


def test_probabilities_sum_to_one_and_look_back_only():
    model, rng = small_model(1)
    s = rng.integers(0, lm.SYMBOLS, (1, lm.WINDOW))
    tables = model.scoring_tables()
    aims = lambda c: np.full((1, lm.STRIDE), c)
    logs = np.stack([model.class_log_probs(s, aims(c), tables)[0] for c in range(lm.CLASSES)])
    assert np.exp(logs).sum(0) == pytest.approx(np.ones(lm.STRIDE), abs=1e-4)
    later = s.copy()
    later[0, 20:] = (later[0, 20:] + 7) % lm.SYMBOLS
    a, b = model.class_log_probs(s, aims(0), tables)[0], model.class_log_probs(later, aims(0), tables)[0]
    assert np.allclose(a[: 20 - lm.PAD], b[: 20 - lm.PAD]) and not np.allclose(a, b)


def test_shares_of_a_class_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 60)
    rng = np.random.default_rng(4)
    texts = [rng.zipf(1.3, 400) % 300 for _ in range(5)]
    classes, symbols, columns = lm.cluster_classes([t.astype(np.int32) for t in texts], 300)
    flat = np.concatenate(texts)
    pairs = np.bincount(classes[flat[:-1]] * (60 + lm.CLASSES) + columns[flat[1:]], minlength=lm.CLASSES * (60 + lm.CLASSES))
    shares = lm.Shares(np.bincount(flat, minlength=300), pairs.reshape(lm.CLASSES, -1), classes, columns)
    for before in (0, 7, 250):
        log = shares.log(np.full(300, before), np.arange(300)).astype(float)
        assert np.bincount(classes, 10**log, lm.CLASSES)[np.unique(classes)] == pytest.approx(1, abs=1e-4)


def test_training_lowers_the_loss():
    model, rng = small_model(2)
    s = rng.integers(0, 30, (256, lm.WINDOW))
    c = np.roll(s, 2, axis=1)[:, lm.PAD :] % lm.CLASSES  # the class of the symbol two before
    first = model.train(s, c, epochs=1, rate=0.01)
    assert model.train(s, c, epochs=8, rate=0.01) < first - 0.3


def test_long_words_keep_their_bytes():
    ranks = lm.read_ranks()
    text = {v: k for k, v in ranks.items()}
    subwords = lm.Subwords(ranks, most=2)
    for word in ("the", "ß" * 100, "🙂x" * 40, "the"):
        ids = np.frombuffer(subwords[word.encode()], np.uint16)
        assert b"".join(text[i] for i in ids).decode() == " " + word
    assert len(subwords) <= 2
