"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from riskcard.llm import topk


def data(seed, width=9):
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(width)]) for i in range(200)]
    hot = [0.5] * width
    rows += [(i, hot) for i in range(200, 260)]                       # ties
    rows += [(260, None), (261, [float("nan")] * width), (262, [None] * width), (263, [float("inf")] + hot[1:]),
             (264, hot[:4]), (None, hot), (7, rows[7][1]), (100, rows[3][1]), (300, None)]
    return rows


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("seed,cells,k,lists", [(1, 1 << 19, 10, 4), (2, 8, 3, 2), (3, 1 << 19, 500, 4)])
def test_matches_brute_force(spark, seed, cells, k, lists):
    rows = data(seed)
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows],
                               "vec_id long, embedding array<double>, score double, rank int").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=k, lists=lists, query_cells=cells)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e9 + i * 1e-3, -2e9 / (i + 1), 3e5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(PythonException):      # 1e24 does not fit a long: an error, never a wrong score
        topk.top_k(df, F.col("vec_id") == 0, k=4).collect()
    small = spark.createDataFrame([(i, [x / 1e5 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want = [r for r in brute([(i, [x / 1e5 for x in v]) for i, v in rows], 4) if r[0] == 0]
    assert sorted(tuple(r) for r in topk.top_k(small, F.col("vec_id") == 0, k=4).collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).count() == 0


def counted(q, rows, k, lists, batch=1000):
    """Results and multiplications of the phases over batches, as tasks run them."""
    own = np.zeros((len(q), len(rows)), bool)
    best, made = np.full((len(q), 0), -np.inf), 0
    for i in range(0, len(rows), batch):
        totals, n = topk.heads(q, rows[i: i + batch], own[:, i: i + batch], k, lists)
        best, made = topk._best(np.hstack([best, totals]), k), made + n
    cut, found = np.sort(best, axis=1)[:, 0].astype(object), [[] for _ in q]
    for i in range(0, len(rows), batch):
        qi, ci, score, n = topk.survivors(q, rows[i: i + batch], own[:, i: i + batch], cut, lists)
        made += n
        for x, y, z in zip(qi, ci, score):
            found[x].append((-z, i + y))
        found = [sorted(f)[:k] for f in found]
        cut = np.array([max(c, -f[-1][0]) if len(f) == k else c for c, f in zip(cut, found)], object)
    return found, made


@pytest.mark.parametrize("spread,share", [(None, 0.9), (0.3, 0.55), ("lengths", 0.35)])
def test_thresholds_save_multiplications(spread, share):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = rng.normal(size=(8000, 64))
    if spread == 0.3:                               # 40 clusters
        rows = rng.normal(size=(40, 64))[rng.integers(0, 40, 8000)] + spread * rows
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    if spread == "lengths":                         # few long vectors
        rows *= rng.pareto(2, 8000)[:, None]
    rows = np.floor(1024 * rows)
    q = rows[:40]
    found, made = counted(q, rows, 10, 8)
    scores = q @ rows.T
    for x in range(40):
        assert [(-z, y) for z, y in found[x]] == [(scores[x, y], y) for y in np.lexsort((np.arange(8000), -scores[x]))[:10]]
    assert made < share * scores.size * 64, made / scores.size / 64
