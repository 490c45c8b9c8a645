"""Correlation pruning (M6), grid tie-break (M11), split, LR parity."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskcard.operators import encode as E
from riskcard.operators import model as M


def test_prune_rule_m6(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        y = int(rnd.random() < 0.4)
        a = int(rnd.random() < 0.5)
        c = 1
        e = int(rnd.random() < 0.5)
        rows.append((a, a, c, y, e, y))
    cols = ["a", "b", "c", "d", "e", "y"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    m = np.corrcoef(np.array(rows, dtype=float).T)
    pairs = spark.createDataFrame([(cols[i], cols[j], None if np.isnan(m[i, j]) else round(float(m[i, j]), 2))
                                   for i in range(6) for j in range(i + 1, 6)], "a string, b string, corr double")
    kept = {r["feature"]: r["kept"] for r in E.corr_prune(pairs, cols, "y", 0.67, spark).collect()}
    # a = b: tie on |corr with y| -> the earlier (a) is dropped; c constant -> NULL corr, kept;
    # d = y: a leak, dropped; the target is never dropped
    assert kept == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1, "y": 1}
    assert E.kept_columns(E.corr_prune(pairs, cols, "y", 0.67, spark), "y") == ["b", "c", "e", "y"]


def test_grid_best_first_on_ties_m11(spark):
    t = spark.createDataFrame([(0, "l1", 0.1, 0.4, 0.4, 0.4), (1, "l1", 0.2, 0.4, 0.4, 0.4),
                               (2, "l2", 0.1, 0.3, 0.3, 0.3)],
                              "grid_order int, penalty string, c double, ks_train double, "
                              "ks_validation double, quality double")
    assert M.grid_best(t).collect()[0]["grid_order"] == 0


def test_split_is_a_function_of_id(spark):
    df = spark.range(1000).withColumnRenamed("id", "app_id")
    a = {r[0]: r[1] for r in M.train_test_split(df, "app_id").select("app_id", "split").collect()}
    b = {r[0]: r[1] for r in M.train_test_split(df.repartition(7), "app_id").select("app_id", "split").collect()}
    assert a == b and 650 < sum(v == "train" for v in a.values()) < 750


@pytest.mark.parametrize("ids", ["id * 100", "9223372036854775807 - id * 8589934592", "concat('app-', id)",
                                 "if(id = 0, null, id)"])
def test_split_takes_any_id(spark, ids):
    df = spark.range(5000).selectExpr(f"{ids} AS app_id")
    for fraction in (0.7, 0.004, 0.5):
        n = M.train_test_split(df, "app_id", fraction).where("split = 'train'").count()
        assert abs(n - 5000 * fraction) < 5 * (5000 * fraction * (1 - fraction)) ** 0.5 + 1
    c = spark.range(5000).selectExpr(f"{ids} AS app_id", "id % 20 = 3 AS gap")     # a pattern in ids
    m = M.train_test_split(c, "app_id").where("gap and split = 'train'").count()
    assert 140 < m < 210


def test_l2_fit_matches_newton(spark):
    rnd = np.random.default_rng(0)
    n, d = 400, 3
    x = (rnd.random((n, d)) < 0.4).astype(float)
    z = -0.5 + x @ np.array([1.0, -0.7, 0.3])
    y = (rnd.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    cols = ["x0", "x1", "x2"]
    df = spark.createDataFrame([tuple(map(float, r)) + (int(t), 1.0) for r, t in zip(x, y)],
                               "x0 double, x1 double, x2 double, y int, w double")
    c = 0.5
    b0, w = M.fit_logistic(df, cols, "y", "l2", c, n, max_iter=200, tol=1e-10)
    # Newton on 0.5 |w|^2 + C * sum logloss, intercept unpenalised
    X = np.hstack([np.ones((n, 1)), x])
    beta = np.zeros(d + 1)
    reg = np.diag([0.0] + [1.0] * d)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        grad = c * X.T @ (p - y) + reg @ beta
        hess = c * (X.T * (p * (1 - p))) @ X + reg
        beta -= np.linalg.solve(hess, grad)
    assert math.isclose(b0, beta[0], abs_tol=1e-4)
    assert np.allclose(w, beta[1:], atol=1e-4)


def test_l1_fit_meets_the_optimality_conditions(spark):
    """|w|_1 + C * sum(loss) is minimal: the gradient balances the sign of a weight, and stays
    within one where the weight is zero."""
    rng = np.random.default_rng(1)
    n = 600
    x = (rng.random((n, 4)) < 0.4).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(0.4 - x @ np.array([1.2, -0.9, 0.0, 0.02])))).astype(int)
    cols = ["x0", "x1", "x2", "x3"]
    df = spark.createDataFrame([tuple(map(float, r)) + (int(t), 1.0) for r, t in zip(x, y)],
                               "x0 double, x1 double, x2 double, x3 double, y int, w double")
    c = 0.1
    b0, w = M.fit_logistic(df, cols, "y", "l1", c, n, max_iter=500, tol=1e-12)
    p = 1 / (1 + np.exp(-(b0 + x @ np.array(w))))
    grad = c * x.T @ (p - y)
    assert abs(c * (p - y).sum()) < 1e-3
    assert any(abs(v) < 1e-9 for v in w) and any(abs(v) > 0.1 for v in w)
    for g, v in zip(grad, w):
        assert abs(g + np.sign(v)) < 2e-3 if abs(v) > 1e-9 else abs(g) <= 1 + 2e-3


def binned_rows(spark, target="int"):
    from riskcard.operators.bins import CategoricalBins, NumericBins
    rnd = random.Random(9)
    rows = []
    for i in range(500):
        y = int(rnd.random() < 0.3)
        rows.append((i, rnd.choice([None, 1.0, 5.0, 9.0]), rnd.choice(["a", "b", "c", None]), "leak" if y else "no", y))
    df = spark.createDataFrame(rows, "id long, x double, s string, t string, y int").withColumn("y", F.col("y").cast(target))
    return df, [NumericBins("x", (2.0, 6.0)), CategoricalBins("s", (("a",), ("b", "c"), ("zz",))),
                CategoricalBins("t", (("leak",), ("no",)))]


def test_binned_pairs_match_numpy(spark):
    from riskcard.operators.bins import apply_bins
    df, bins = binned_rows(spark)
    binned = apply_bins(df, bins, keep=["id", "y"])
    oh = E.one_hot(binned, bins, "y", "id")
    cols = [c for c in oh.columns if c != "id"]
    m = np.corrcoef(np.array([tuple(r)[1:] for r in oh.collect()], dtype=float).T)
    got = {(r["a"], r["b"]): r["corr"] for r in E.corr_pairs_binned(binned, bins, "y").collect()}
    assert len(got) == len(cols) * (len(cols) - 1) // 2
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            c = got[(cols[i], cols[j])]
            assert c is None if np.isnan(m[i, j]) else abs(c - m[i, j]) <= 0.0051


@pytest.mark.parametrize("target", ["int", "double", "boolean", "decimal(3,1)"])
def test_leak_is_dropped_for_any_target_type(spark, target):
    from riskcard.operators.bins import apply_codes
    from riskcard.operators.prep import checked_target
    df, bins = binned_rows(spark, target)
    coded = apply_codes(checked_target(df, "y"), bins, keep=["id", "y"])
    cols = [n for n, _, _ in E.level_codes(bins)] + ["y"]
    prune = {r["feature"]: r["kept"] for r in E.corr_prune(E.corr_pairs_codes(coded, bins, "y"), cols, "y").collect()}
    assert prune["t_cat__b0"] == 0 and prune["t_cat__b1"] == 0 and prune["y"] == 1 and prune["x_cat__b0"] == 1


def test_target_must_be_zero_or_one(spark):
    from riskcard.operators.prep import checked_target
    for rows, kind in (([(0,), (2,)], "y int"), ([(0.0,), (None,)], "y double"), ([("1",)], "y string")):
        with pytest.raises(ValueError):
            checked_target(spark.createDataFrame(rows, kind), "y")


def test_ks_by_intervals_is_exact(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((900, 3)) * 8).round(1)
    y = (rng.random(900) < 1 / (1 + np.exp(2 - x[:, 0] / 2))).astype(int)
    cols = ["x0", "x1", "x2"]
    df = spark.createDataFrame([("train" if i % 3 else "test", *map(float, r), int(t), 1.0 + i % 2)
                                for i, (r, t) in enumerate(zip(x, y))],
                               "split string, x0 double, x1 double, x2 double, y int, w double")
    models = [(-1.0, [0.5, 0.0, 0.0]), (0.2, [0.1, -0.3, 0.01]), (0.0, [0.0, 0.0, 0.0])]
    want = {}
    for k, (b0, w) in enumerate(models):
        p = 1 / (1 + np.exp(-(b0 + x @ np.array(w))))
        for split in ("train", "test"):
            own = np.array([(i % 3 != 0) == (split == "train") for i in range(900)])
            wt = np.array([1.0 + i % 2 for i in range(900)])
            gaps = []
            for c in np.unique(p[own]):
                at = own & (p >= c)
                gaps.append(abs((wt * y)[at].sum() / (wt * y)[own].sum() - (wt * (1 - y))[at].sum() / (wt * (1 - y))[own].sum()))
            want[(f"m{k}", split)] = max(gaps)
    for intervals in (4, 4096):
        got = M.ks_of_models(df, cols, "y", models, intervals)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_compressed_design_equals_the_full_one(spark):
    from riskcard.operators.bins import apply_codes
    df, bins = binned_rows(spark)
    coded = apply_codes(df, bins, keep=["id", "y"])
    feats = ["s_cat__b0", "x_cat__b1", "x_cat__bnan"]
    comp = M.compress_codes(M.train_test_split(coded, "id"), bins, feats, "y", extra=["split"])
    full = M.train_test_split(E.one_hot_codes(coded, bins, "y", "id"), "id").groupBy("split", *feats, "y").count()
    assert sorted(tuple(r) for r in comp.select("split", *feats, "y", F.col("w").cast("long")).collect()) == \
        sorted(tuple(r) for r in full.collect())


def test_all_models_meet_their_optimality_conditions(spark):
    """36 fits at once on a wide design with a constant column, a duplicated one, one that no row has, a
    one-hot set and rare levels; the same in groups of few models, from a single partition or several."""
    rng = np.random.default_rng(11)
    n, p = 3_000, 24
    x = (rng.random((n, p)) < rng.uniform(0.02, 0.6, p)).astype(int)
    x[:, 0], x[:, 1], x[:, 2] = 1, x[:, 3], 0
    x[:, 21:24] = np.eye(3, dtype=int)[rng.integers(0, 3, n)]
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x @ rng.normal(0, 0.9, p)))).astype(int)
    w = rng.integers(1, 5, n).astype(float)
    cols = [f"c{k}" for k in range(p)]
    df = spark.createDataFrame([(*map(int, r), int(t), float(v)) for r, t, v in zip(x, y, w)],
                               ", ".join(f"{c} int" for c in cols) + ", y int, w double")
    grid = [(pen, c) for pen in M.PENALTIES for c in M.C_VALUES]
    models = M.fit_models(df, cols, "y", grid)
    for (pen, c), (b0, beta) in zip(grid, models):
        b = np.array(beta)
        miss = (1 / (1 + np.exp(-(b0 + x @ b))) - y) * w * c
        g = x.T @ miss
        assert abs(miss.sum()) < 1e-5
        if pen == "l2":
            assert np.abs(g + b).max() < 1e-5
        else:
            assert all(abs(v + np.sign(u)) < 1e-5 if u else abs(v) <= 1 + 1e-5 for v, u in zip(g, b))
    assert any(v == 0 for v in models[0][1]) and all(m[1][2] == 0 for m in models)


def test_models_in_groups_and_partitions(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = (rng.random((400, 3)) < 0.4).astype(int)
    y = (rng.random(400) < 0.2 + 0.5 * x[:, 0]).astype(int)
    df = spark.createDataFrame([(*map(int, r), int(t), 1.0) for r, t in zip(x, y)], "a int, b int, c int, y int, w double")
    grid = [(pen, c) for pen in M.PENALTIES for c in (0.005, 0.1, 1.0)]
    whole = M.fit_models(df, ["a", "b", "c"], "y", grid)
    monkeypatch.setattr(M, "SUMS", 50)
    monkeypatch.setattr(M, "ROWS_PER_FIT_PARTITION", 60)
    monkeypatch.setattr(M, "SLOTS", 2)
    for (b0, w), (c0, v) in zip(whole, M.fit_models(df, ["a", "b", "c"], "y", grid)):
        assert np.allclose([b0, *w], [c0, *v], atol=1e-5)


def test_models_of_an_empty_or_one_class_table(spark):
    kind = "a int, y int, w double"
    assert all(w == [0.0] for _, w in M.fit_models(spark.createDataFrame([], kind), ["a"], "y", [("l1", 1.0), ("l2", 1.0)]))
    one = M.fit_models(spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0)], kind), ["a"], "y", [("l1", 0.1), ("l2", 0.1)], max_iter=20)
    assert all(b0 > 3 and np.isfinite(w).all() for b0, w in one)


def test_passes_do_not_grow_with_the_rows(spark, monkeypatch):
    """All levels of three features, which add up to the intercept: as many passes for large weights as for
    small ones, and the optimality conditions hold relative to the sums."""
    rng = np.random.default_rng(13)
    x = np.hstack([np.eye(k, dtype=int)[rng.integers(0, k, 500)] for k in (5, 4, 3)])
    y = (rng.random(500) < 1 / (1 + np.exp(0.5 - x @ rng.normal(0, 0.7, 12)))).astype(int)
    cols = [f"c{k}" for k in range(12)]
    summed, passes = M._summed_over, []
    monkeypatch.setattr(M, "_summed_over", lambda *a: passes.append(1) or summed(*a))
    used = []
    for weight in (1.0, 20_000.0):
        df = spark.createDataFrame([(*map(int, r), int(t), weight) for r, t in zip(x, y)],
                                   ", ".join(f"{c} int" for c in cols) + ", y int, w double")
        passes.clear()
        models = M.fit_models(df, cols, "y", [("l1", c) for c in M.C_VALUES])
        used.append(len(passes))
        for c, (b0, beta) in zip(M.C_VALUES, models):
            b = np.array(beta)
            g = x.T @ ((1 / (1 + np.exp(-(b0 + x @ b))) - y) * weight * c)
            assert all(abs(v + np.sign(u)) < 1e-5 if u else abs(v) <= 1 + 1e-5 for v, u in zip(g, b))
    assert max(used) <= 10


def test_lasso_step_is_exact_where_coordinates_depend_on_each_other():
    """A quadratic model of 10^6 rows with a one-hot set: solved to rounding in a few sweeps."""
    rng = np.random.default_rng(14)
    x = np.hstack([np.ones((300, 1)), np.eye(6)[rng.integers(0, 6, 300)], np.eye(5)[rng.integers(0, 5, 300)]])
    curve = (x.T @ (x * rng.uniform(500, 1_000, (300, 1))))[None]
    grad = (x.T @ rng.normal(0, 500, 300))[None]
    new = M._lasso_steps(np.zeros((1, 12)), grad, curve, sweeps=50)
    left = grad + np.einsum("kij,kj->ki", curve, new)
    assert M._violation(new, left, np.array([True]))[0] < 1e-8
