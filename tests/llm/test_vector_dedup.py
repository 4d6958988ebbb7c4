import math
import random

import numpy as np
import pytest

from dossier.llm import vector_dedup as v
from tests.llm.frames import crowded, rows

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed=5, n=150, dim=16):
    rng = random.Random(seed)
    gauss = lambda k=dim: [rng.gauss(0, 1) for _ in range(k)]
    out = []
    for i in range(n):
        label = [0, 0, 0, 1, 2, None][i % 6]
        x = gauss() if i % 3 == 0 else [c + rng.gauss(0, rng.choice([0, 0.03, 0.09, 0.14])) for c in out[rng.randrange(len(out))][1]]
        out.append((i, x, label))
    odd = [None, [], [0.0] * dim, [math.nan] + [1.0] * (dim - 1), [math.inf] * dim, [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [1e300] * dim, [1e-300] * dim]
    out += [(n + i, x, 0) for i, x in enumerate(odd)] + [(n + 50, out[0][1], 0), (0, out[0][1], 0), (n + 51, [2 * c for c in out[0][1]], 0)]
    return out


def brute(given, limit=0.98):
    def unit(x, label):
        if label is None or not x or any(c is None or not math.isfinite(c) for c in x) or not any(x):
            return None
        big = max(map(abs, x))
        x = [c / big for c in x]
        norm = math.sqrt(sum(c * c for c in x))
        return [c / norm for c in x]

    units = [unit(x, label) for _, x, label in given]
    links = [0] * len(given)
    comp = list(range(len(given)))
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a and b and given[i][2] == given[j][2] and len(a) == len(b) and sum(p * q for p, q in zip(a, b)) >= limit:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    least = {}
    for (vec_id, _, _), c in zip(given, comp):
        least[c] = min(least.get(c, vec_id), vec_id)
    return sorted((g[0], n, least[c], g[0] == least[c]) for g, n, c in zip(given, links, comp))


def test_against_brute_force(spark, monkeypatch):
    given = vectors()
    table = crowded(spark.createDataFrame(given, SCHEMA))
    names = ("vec_id", "n_links", "component_id", "kept")
    assert rows(v.near_vectors(table), *names) == brute(given)
    monkeypatch.setattr(v, "BLOCK", 4)
    counts = v.link_counts.__defaults__
    v.link_counts.__defaults__ = (4,)
    try:
        assert rows(v.near_vectors(table), *names) == brute(given)
    finally:
        v.link_counts.__defaults__ = counts


def test_dense_group_has_all_links(spark):
    rng = random.Random(2)
    centre = [rng.gauss(0, 1) for _ in range(32)]
    given = [(i, [c + rng.gauss(0, 0.08) for c in centre], 1) for i in range(120)]
    assert rows(v.near_vectors(spark.createDataFrame(given, SCHEMA), window=2), "vec_id", "n_links", "component_id", "kept") == brute(given)


@pytest.mark.parametrize("depth", [None, 6])
def test_isolated_links_in_a_hot_group(spark, monkeypatch, depth):
    """All vectors of a label at cosine 0.94, links only in pairs: in runs of the chosen depth, and of six hashes."""
    if depth:
        fixed = spark.createDataFrame([(1, 64, depth, v.run_passes(depth, v.COSINE))], "label long, dim int, depth int, n_passes int")
        monkeypatch.setattr(v, "run_depths", lambda nodes, limit, exact: fixed)
        monkeypatch.setattr(v.run_links, "__defaults__", (256,))
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.normal(size=64)) + 0.25 * unit(rng.normal(size=(1500, 64))))
    x = unit(np.concatenate([x, x + 0.17 * unit(rng.normal(size=x.shape))]))
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert 1300 < near.sum() / 2 < 1700 and 0.93 < np.median(x @ x.T) < 0.95
    table = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(x)], SCHEMA)
    got = rows(v.near_vectors(table), "vec_id", "n_links", "component_id")
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(near, least, len(x)).min(1))
        if (new == least).all():
            break
        least = new
    assert got == [(i, int(n), int(c)) for i, (n, c) in enumerate(zip(near.sum(1), least))]


def test_run_passes():
    assert v.run_passes(0, 0.98) == 1 and v.run_passes(6, 0.98) > v.run_passes(3, 0.98) > 1
    assert v.run_passes(0, -1.0) == 1 and v.run_passes(1, -1.0) is None and v.run_passes(8, 1.0) == 1


def test_fewer_passes_lose_links(spark, monkeypatch):
    """What is linked comes out of the sorted passes: one pass alone misses pairs, none of them is found another way."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 64))
    x = np.concatenate([x, x + 0.02 * np.linalg.norm(x, axis=1, keepdims=True) * rng.normal(size=x.shape)])
    table = spark.createDataFrame([(i, e.tolist(), i % 2) for i, e in enumerate(x)], SCHEMA)
    links = lambda **o: sum(r["n_links"] for r in v.near_vectors(table, **o).collect())
    full = links()
    assert full == links(exact=True) > 1000
    depth = v.run_depths(v.cut(v.clean_vectors(table).where("node is not null")), v.COSINE).select("depth", "n_passes").distinct().collect()
    assert all(d >= 1 and n > 1 for d, n in depth)
    monkeypatch.setattr(v, "run_passes", lambda depth, limit: 1 if depth == 8 else None)
    assert links() < 0.9 * full


def test_empty(spark):
    assert v.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(None, None, None), (4, None, 1)], SCHEMA)
    assert rows(v.near_vectors(nothing), "vec_id", "n_links", "component_id", "kept") == [(None, 0, None, True), (4, 0, 4, True)]
