"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes numbers (lengths, shares of character classes, repetition, stop words). Cyclic boosting visits the
features in turn and adds a shallow tree over the feature's bins to its look-up table; then the pairs with most left to
explain get small tables the same way. A text is scored by adding the entries of its bins.

Learning uses a bounded sample of labelled rows outside the held-out fold (`SAMPLE_ROWS`); scoring covers all whole
texts in one pass without a shuffle. Inputs are the text alone. Null and empty texts are scored as texts of length 0.
Without labels of both classes the score is the share of label 1 (0.5 without any). Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import LOWER, held_out_row, map_rows, table
from dossier.llm.labelled import gathered, labelled_sample

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS = 64
PAIR_BINS = 8

# Frequent short words of four languages.
STOP_WORDS = frozenset(
    w.encode() for w in (
        "the of and to in a is that it for on was with as be are this by an or at from he not but they his her which "
        "le la les de des et en un une du que est pour qui dans par sur pas au plus ne se ce il "
        "der die das und ist den von zu mit sich auf für nicht ein eine dem als auch es an werden "
        "el los las y del se por con para una su al lo como más no mi"
    ).split()
)

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "upper", "digits", "marks",
    "pipes", "loud", "non_ascii", "lines", "repeated_lines", "stop_words", "packed", "sentence_ends", "long_words",
    "short_words", "entropy", "odd_ends", "spaces", "top_mark", "once_words",
)
_CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (
        65 <= _b <= 90, 48 <= _b <= 57, _b < 128 and _b > 32 and not _c.isalnum() and _c not in ".,'", _c == "|",
        _c in "!#$%&*", _b >= 128, _c in " \t\n\r",
    )
_MARKS = np.flatnonzero(_CLASSES[:, 2])
_ENDS = b"!#$%&*|"


def features(text: str | None) -> list[float]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    words = data.translate(LOWER).split()
    nw = max(1, len(words))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    upper, digits, marks, pipes, loud, non_ascii, spaces = hist @ _CLASSES / n
    share = hist[hist > 0] / n
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = data.split(b"\n")
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), len(counts) / nw,
        max(counts.values(), default=0) / nw, upper, digits, marks, pipes, loud, non_ascii, len(lines) / nw,
        1 - len(set(lines)) / len(lines), sum(counts[w] for w in STOP_WORDS.intersection(counts)) / nw,
        len(zlib.compress(data, 1)) / n, data.count(b". ") / nw, float((lengths > 15).mean()), float((lengths < 2).mean()),
        float(-(share * np.log2(share)).sum()), sum(c for w, c in counts.items() if w[-1] in _ENDS) / nw, spaces,
        hist[_MARKS].max() / n, sum(c == 1 for c in counts.values()) / nw,
    ]


@dataclass
class AdditiveModel:
    """Bin edges, look-up tables per feature and per pair, and the intercept."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[f], x[:, f])]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _gain(g, h, smooth):
    return g * g / (h + smooth)


def _split(g: np.ndarray, h: np.ndarray, smooth: float, least: float) -> tuple[float, int]:
    """Best gain and the number of bins left of the split (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = _gain(gl, hl, smooth) + _gain(gt - gl, ht - hl, smooth) - _gain(gt, ht, smooth)
    gain[(hl < least) | (ht - hl < least)] = 0
    i = int(np.argmax(gain))
    return (float(gain[i]), i + 1) if gain[i] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, smooth: float, least: float, depth: int) -> np.ndarray:
    """Leaf values over ordered bins of a tree of this depth."""
    gain, at = _split(g, h, smooth, least) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + smooth))
    return np.concatenate([_tree(g[:at], h[:at], smooth, least, depth - 1), _tree(g[at:], h[at:], smooth, least, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float, least: float) -> np.ndarray:
    """Leaf values over a grid: one split on an axis, then one on the other axis in each half."""
    (g0, at0), (g1, at1) = _split(g.sum(1), h.sum(1), smooth, least), _split(g.sum(0), h.sum(0), smooth, least)
    if g1 > g0:
        return _pair_tree(g.T, h.T, smooth, least).T
    at = at0 or len(g)
    parts = [np.broadcast_to(_tree(x.sum(0), y.sum(0), smooth, least, 1), x.shape) for x, y in ((g[:at], h[:at]), (g[at:], h[at:])) if len(x)]
    return np.concatenate(parts)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 10, rate: float = 0.1) -> AdditiveModel:
    model, n = AdditiveModel(), len(y)
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    model.base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return model
    smooth, least = 5.0, 3.0
    quantiles = lambda c, k: np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1]))
    model.edges = [quantiles(x[:, f], BINS) for f in range(x.shape[1])]
    model.pair_edges = [quantiles(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, model.base)
    grads = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(rounds):
        for f, code in enumerate(codes):
            g, h = grads()
            k = len(model.tables[f])
            step = rate * _tree(np.bincount(code, g, k), np.bincount(code, h, k), smooth, least, 2)
            model.tables[f] += step
            total += step[code]
    coarse = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.pair_edges)]
    g, h = grads()
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a):
            shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
            cell = coarse[a] * shape[1] + coarse[b]
            gg, hh = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
            ranked.append((float(_gain(gg, hh, smooth).sum()), a, b, shape, cell))
    ranked.sort(key=lambda r: -r[0])
    chosen = [(a, b, np.zeros(shape), cell) for _, a, b, shape, cell in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, t, cell in chosen:
            g, h = grads()
            step = rate * _pair_tree(np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape), smooth, least)
            t += step
            total += step.ravel()[cell]
    model.pairs = [(a, b, t) for a, b, t, _ in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    def make():
        def step(given):
            yield {"x": [features(t) for t in given["text"]], "y": given["y"], "doc_id": given["doc_id"]}

        return step

    sample = map_rows(labelled_sample(docs, labels, "quality", rows), "doc_id long, x array<double>, y int", make).toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    x = np.concatenate([np.zeros(0), *gathered(sample, "x")]).reshape(-1, len(FEATURES))
    return fit(x[order], sample["y"].to_numpy().astype(float)[order])


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score, predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(given):
            x = np.array([features(t) for t in given["text"]], float).reshape(-1, len(FEATURES))
            score = sent.value.score(x)
            yield {"doc_id": given["doc_id"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

        return step

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", make)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_row(5, 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts; all columns stay and the text is scored where it lies."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(sent.value.score(x) >= THRESHOLD)

    return docs.where(good("text"))
