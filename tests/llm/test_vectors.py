import math

import numpy as np
import pytest

from tessella.llm import vectors


def brute(rows, least=vectors.LEAST):
    def unit(x, label):
        if x is None or label is None or not len(x) or any(c is None or not math.isfinite(c) for c in x) or not any(x):
            return None
        v = np.array(x, np.float32).astype(float)
        return v / np.linalg.norm(v)

    u = [unit(x, label) for _, x, label in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and u[i].size == u[j].size and u[i] @ u[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return [(r[0], links[i], low.get(find(i))) for i, r in enumerate(rows)]


def key(t):
    return tuple((x is not None, x) for x in t)


def data():
    rng = np.random.default_rng(7)
    rows = []
    for label in (1, 2):
        centres = rng.normal(size=(12, 8))
        for _ in range(300):
            rows.append((len(rows), (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.1, 0.25, 0.5])).astype(np.float32).tolist(), label))
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)] + [(2000, rows[0][1], 2), (2001, rows[0][1], None), (2002, rows[0][1], None)]
    walk = np.array([1.0, 0, 0, 0, 0, 0, 0, 0])
    for i in range(60):  # a chain on a circle
        walk = np.array([math.cos(i * 0.3), math.sin(i * 0.3) * 1.0, 0.0, 0, 0, 0, 0, 0])
        rows.append((3000 + i, walk.tolist(), 3))
    rows += [(4000, None, 1), (4001, [0.0] * 8, 1), (4002, [float("nan")] * 8, 1), (4003, [None] * 8, 1), (4004, [], 1), (4005, [1.0, 0.0], 1), (4006, [2.0, 0.0], 1), (None, rows[3][1], 1), (5, rows[5][1], 1), (4007, [-0.0, 1.0], 1), (4008, [0.0, 1.0], 1), (4009, [float("inf")] * 8, 1)]
    return rows


@pytest.mark.parametrize("cell,block", [(vectors.CELL, vectors.BLOCK), (30, 17)])
def test_against_all_pairs(spark, cell, block):
    rows = data()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df, cell=cell, block=block).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_cells_hold_all_partners():
    """Every pair within the radius shares the cell of either."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    p, e = x[:9], math.sqrt(2 - 2 * 0.93)
    d2 = 2 - 2 * x @ p.T
    home = d2.argmin(1)
    apart = np.linalg.norm(p[:, None] - p[None], axis=2)[home]
    near = d2 - d2.min(1, keepdims=True) <= 2 * e * apart + 1e-12
    near[np.arange(400), home] = True
    i, j = np.nonzero(x @ x.T >= 0.93)
    assert near[j, home[i]].all() and near.sum() < 0.9 * near.size


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = vectors.op5_embedding_near_dedup(spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_pivots_grow_with_the_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 1) for i in range(1200)]
    kinds = vectors.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    few, many = (vectors.pivots(kinds, sample=16, cell=c)[(1, 6)] for c in (300, 20))
    assert len(few) == 4 and 50 <= len(many) <= 60
    assert len(vectors.pivots(kinds, sample=16, cell=20, most=10)[(1, 6)]) <= 10


def test_few_distances_are_held_at_a_time(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    names = [("a", 1)] * 7 + [("b", 1)] * 2
    monkeypatch.setattr(vectors, "HELD", 6)
    assert [(n, a.tolist()) for n, a in vectors.portions(names, {("a", 1): np.zeros((3, 1))})] == [(("a", 1), [0, 1]), (("a", 1), [2, 3]), (("a", 1), [4, 5]), (("a", 1), [6]), (("b", 1), [7, 8])]
    assert vectors.near_vectors(df, cell=30).count() == len(rows)
