"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words and the first letters of longer words, hashed to buckets. Besides a weight, each
bucket has a short vector; the product of two vectors is the weight of both terms together, so that a pair such as an
insult and a mention of a group counts more than its parts. Every bucket in at least LEAST_TEXTS learning texts takes
part, whatever the labels say of it alone.

Learning uses a bounded sample of labelled rows outside the held-out fold (`SAMPLE_ROWS`), scoring covers all whole
texts in one pass without a shuffle. Inputs are the text alone. Null and empty texts have no terms: their score is the
intercept's. Without labels of both classes the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.common import alnum_words, held_out_row, map_rows, table
from dossier.llm.labelled import gathered, labelled_sample

SAMPLE_ROWS = 16_000
THRESHOLD = 0.5
BUCKETS = 1 << 18
FACTORS = 8
PREFIX = 4
LEAST_TEXTS = 3


def terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words and word beginnings, ascending."""
    words = set(alnum_words(text))
    starts = {w[:PREFIX] for w in words if len(w) > PREFIX}
    hashes = [zlib.crc32(w) for w in words] + [zlib.crc32(w, PREFIX) for w in starts]
    return np.unique(np.array(hashes, np.int64) & (BUCKETS - 1)).astype(np.int32)


@dataclass
class FactorModel:
    """slot: position of a bucket's weights (-1: takes no part)."""

    base: float
    slot: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, buckets: np.ndarray) -> float:
        at = self.slot[buckets]
        at = at[at >= 0]
        v = self.factor[at]
        s = v.sum(0)
        return self.base + float(self.weight[at].sum()) + 0.5 * float((s * s - (v * v).sum(0)).sum())

    def score(self, all_terms: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array([self.margin(t) for t in all_terms], float), -40, 40)))


def _chosen(all_terms: list[np.ndarray]) -> np.ndarray:
    """Buckets in at least LEAST_TEXTS texts."""
    df = np.zeros(BUCKETS, np.int64)
    for t in all_terms:
        df[t] += 1
    return np.flatnonzero(df >= LEAST_TEXTS)


def fit(all_terms: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.3, batch: int = 128, seed: int = 7) -> FactorModel:
    n = len(y)
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(share / (1 - share)))
    slot = np.full(BUCKETS, -1, np.int32)
    if not n or y.min() == y.max():
        return FactorModel(base, slot, np.zeros(0), np.zeros((0, FACTORS)))
    chosen = _chosen(all_terms)
    slot[chosen] = np.arange(len(chosen))
    rows = [(s := slot[t])[s >= 0] for t in all_terms]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS))
    w_sq, v_sq, b_sq = np.full(len(chosen), 1e-6), np.full(len(chosen), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            part = order[start : start + batch]
            flat = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            vx = v[flat]
            s = np.stack([np.bincount(owner, vx[:, f], len(part)) for f in range(FACTORS)], 1)
            m = base + np.bincount(owner, w[flat], len(part)) + 0.5 * ((s * s).sum(1) - np.bincount(owner, (vx * vx).sum(1), len(part)))
            error = 1 / (1 + np.exp(-np.clip(m, -40, 40))) - y[part]
            # Gradients are summed per term over the batch; adaptive steps, weights drawn towards zero.
            used, place = np.unique(flat, return_inverse=True)
            gw = np.bincount(place, error[owner]) / len(part) + 1e-5 * w[used]
            pull = error[owner][:, None] * (s[owner] - vx)
            gv = np.stack([np.bincount(place, pull[:, f]) for f in range(FACTORS)], 1) / len(part) + 1e-3 * v[used]
            w_sq[used] += gw * gw
            v_sq[used] += (gv * gv).mean(1)
            w[used] -= rate * gw / np.sqrt(w_sq[used])
            v[used] -= rate / 15 * gv / np.sqrt(v_sq[used])[:, None]
            gb = error.mean()
            b_sq += gb * gb
            base -= rate * gb / np.sqrt(b_sq)
    return FactorModel(float(base), slot, w, v)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FactorModel:
    def make():
        def step(given):
            yield {"x": [terms(t) for t in given["text"]], "y": given["y"], "doc_id": given["doc_id"]}

        return step

    sample = map_rows(labelled_sample(docs, labels, "toxic", rows), "doc_id long, x array<int>, y int", make).toArrow()
    terms_of, y = gathered(sample, "x"), sample["y"].to_numpy().astype(float)
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    return fit([terms_of[i] for i in order], y[order])


def score_toxicity(docs: DataFrame, model: FactorModel) -> DataFrame:
    """doc_id, score, predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(given):
            score = sent.value.score([terms(t) for t in given["text"]])
            yield {"doc_id": given["doc_id"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

        return step

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", make)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_row(5, 0).alias("held_out"), "score", "predicted")
