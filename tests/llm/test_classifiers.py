import random
import zlib

import numpy as np
import pytest

from dossier.llm import quality, toxicity
from tests.llm.frames import DOCS, crowded

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500, seed=6):
    """Good texts are plain words; bad ones repeat, shout or carry signs. Toxic: an insult together with a group word."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("re", "th", "on", "is", "ka") for b in ("an", "ed", "o", "ing", "u")]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.25
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["dolt"] * insult + ["norlanders"] * group
        rng.shuffle(words)
        if bad:
            words = [[w.upper() + "!!" for w in words], [words[0]] * len(words), [w + "%%%" for w in words]][i % 3] + words[-3:]
        texts.append(" ".join(words))
        labels.append((i, int(not bad), int(insult and group)))
    return texts, labels


@pytest.fixture(scope="module")
def data(spark):
    texts, labels = corpus()
    texts += [None, "", " ", "\x00", "one " * 30_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels += [(None, 1, 1), (99_999, 0, 1), (7, None, None), (8, 1, 1), (8, 1, 0)]
    return crowded(docs), crowded(spark.createDataFrame(labels, LABELS)), texts, labels


def accuracy(scored, labels, column):
    marks = {r[0]: r[column] for r in labels[:1500]}
    held = [r for r in scored if r["doc_id"] in marks and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 200
    return np.mean([r["predicted"] == marks[r["doc_id"]] for r in held])


def test_quality_on_held_out_rows(data):
    docs, labels, texts, marks = data
    scored = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(scored) == len(texts) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert accuracy(scored, marks, 1) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored if r["predicted"]}


def test_toxicity_learns_pairs(data):
    docs, labels, texts, marks = data
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(texts) and all(0 <= r["score"] <= 1 for r in scored)
    assert accuracy(scored, marks, 2) > 0.95


def test_toxicity_learns_pairs_of_rare_words():
    """60 insults and 60 mentions, each in under 1% of texts and toxic only together: none is marked by the labels alone."""
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(40)]
    texts, y = [], []
    for _ in range(8000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = rng.sample(plain, 8) + [f"i{rng.randrange(60)}"] * insult + [f"g{rng.randrange(60)}"] * group
        texts.append(toxicity.terms(" ".join(words)))
        y.append(float(insult and group))
    y = np.array(y)
    model = toxicity.fit(texts[:6000], y[:6000])
    assert np.mean((model.score(texts[6000:]) >= 0.5) == y[6000:]) > 0.98


def test_labels_of_the_held_out_fold_are_not_used(data, spark):
    docs, labels, _, marks = data
    turned = [(i, 1 - q, 1 - t) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in marks if q is not None]
    plain = spark.createDataFrame([m for m in marks if m[1] is not None], LABELS)
    turned = spark.createDataFrame(turned, LABELS)
    a, b = quality.train(docs, plain), quality.train(docs, turned)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables)) and a.base == b.base
    a, b = toxicity.train(docs, plain), toxicity.train(docs, turned)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.factor, b.factor)


def test_no_labels(spark, data):
    docs, labels, texts, _ = data
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score_quality(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, none)).collect()} == {0.5}
    empty = spark.createDataFrame([], DOCS)
    assert quality.score_quality(empty, quality.train(empty, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0


def test_sample_has_a_bound(data):
    docs, labels, _, _ = data
    from dossier.llm.labelled import labelled_sample

    assert labelled_sample(docs, labels, "quality", 300).count() < 400
