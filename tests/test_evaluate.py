"""KS, AUC, groups and the cutoff table (FIXTURES M2, M3, M8, M13, properties)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskcard.operators import evaluate as V
from riskcard.plans.prefix import global_row_number


def grain(spark, rows, key="score"):
    df = spark.createDataFrame(rows, f"id long, {key} long, y int")
    return df, V.score_grain(df, key, "y")


def test_all_equal_scores_m2(spark):
    _, g = grain(spark, [(i, 500, i % 2) for i in range(10)])
    assert V.ks_stat(V.ks_table(g, "score")).collect()[0]["ks"] == 0.0
    assert V.auc(g, "score").collect()[0]["auc"] == 0.5


def test_groups_use_ceil_not_ntile_m3(spark):
    df, _ = grain(spark, [(i, i, i % 2) for i in range(10)])
    grp = V.equal_groups(df, "score", "id", 3, partitions=2)
    sizes = sorted((r["grp"], r["count"]) for r in grp.groupBy("grp").count().collect())
    assert [c for _, c in sizes] == [3, 3, 4]


def test_odds_null_when_all_accepted_good_m8(spark):
    _, g = grain(spark, [(1, 100, 1), (2, 200, 0), (3, 300, 0)])
    offset, factor = V.scaling()
    rows = {r["cutoff_score"]: r for r in V.ppt_table(g, "score", offset, factor).collect()}
    assert rows[200]["good_rate_accepted"] == 1.0 and rows[200]["odds_accepted"] is None


@pytest.mark.parametrize("origin", [False, True])
def test_ppt_equals_row_counting_m13(spark, origin):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(300, 340), int(rnd.random() < 0.3)) for i in range(500)]
    _, g = grain(spark, rows)
    offset, factor = V.scaling()
    got = {r["cutoff_score"]: r for r in V.ppt_table(g, "score", offset, factor, origin).collect()}
    # row-level counting as the reference does, with the zero origin row when asked
    data = [(s, 1 - y) for _, s, y in rows]
    if origin:
        data.append((min(s for s, _ in data), 0))
    for s in sorted({s for s, _ in data}, reverse=True):
        n = len(data)
        appr = sum(1 for x, _ in data if x > s) / n
        acc = [good for x, good in data if x >= s]
        rej = [good for x, good in data if x <= s]
        r = got[s]
        assert abs(r["approval_rate"] - appr) < 1e-12
        assert abs(r["good_rate_accepted"] - sum(acc) / len(acc)) < 1e-12
        assert abs(r["good_rate_rejected"] - sum(rej) / len(rej)) < 1e-12


def test_ks_invariant_to_partitioning_and_cumulative_ends(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 50), int(rnd.random() < 0.35)) for i in range(2000)]
    df, g = grain(spark, rows)
    k1 = V.ks_stat(V.ks_table(g, "score")).collect()[0]["ks"]
    g8 = V.score_grain(df.repartition(1), "score", "y")
    k2 = V.ks_stat(V.ks_table(g8, "score")).collect()[0]["ks"]
    kb = V.ks_stat(V.ks_table(g, "score", partitions=4)).collect()[0]["ks"]
    assert k1 == k2 == kb
    last = V.ks_table(g, "score").orderBy(F.desc("group")).first()
    assert abs(last["cumgood"] - 1) < 1e-12 and abs(last["cumbad"] - 1) < 1e-12
    # monotone transform of the score leaves KS unchanged
    g3 = V.score_grain(df.withColumn("score", F.col("score") * 3 + 7), "score", "y")
    assert V.ks_stat(V.ks_table(g3, "score")).collect()[0]["ks"] == k1


def test_auc_symmetry(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 30), int(rnd.random() < 0.5)) for i in range(800)]
    df, g = grain(spark, rows)
    a1 = V.auc(g, "score").collect()[0]["auc"]
    gn = V.score_grain(df.withColumn("score", -F.col("score")), "score", "y")
    a2 = V.auc(gn, "score").collect()[0]["auc"]
    assert abs(a1 + a2 - 1.0) < 1e-12
    # brute force
    bad = [s for _, s, y in rows if y == 1]
    good = [s for _, s, y in rows if y == 0]
    wins = sum((b < gd) + 0.5 * (b == gd) for b in bad for gd in good)
    assert abs(a1 - wins / (len(bad) * len(good))) < 1e-12


def test_two_level_row_number_equals_global_order(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 5), 0) for i in range(3000)]   # heavy ties: hot score values
    df = spark.createDataFrame(rows, "id long, score long, y int")
    got = {r["id"]: r["rn"] for r in global_row_number(df, ["score", "id"], partitions=7).collect()}
    expect = {i: k + 1 for k, (i, _) in enumerate(sorted(((i, s) for i, s, _ in rows), key=lambda t: (t[1], t[0])))}
    assert got == expect


def test_origin_and_backfill(spark):
    _, g = grain(spark, [(1, 10, 1), (2, 20, 0), (3, 30, 0)])
    t = V.backfill(V.with_origin(V.ks_table(g, "score")), "score", "group").orderBy("group").collect()
    assert t[0]["group"] == 0.0 and t[0]["score"] == 10 and t[0]["cumbadrate"] is None


def test_null_keys_come_last_in_both_directions(spark):
    rows = [(i, None if i % 5 == 0 else i % 7, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, score long, y int")
    for ascending in (True, False):
        for parts in (1, 4, None):
            got = {r["id"]: r["rn"] for r in
                   global_row_number(df, ["score", "id"], ascending=ascending, partitions=parts).collect()}
            sign = 1 if ascending else -1
            want = sorted(rows, key=lambda t: (t[1] is None, sign * (t[1] or 0), sign * t[0]))
            assert got == {i: k + 1 for k, (i, _, _) in enumerate(want)}


def test_grouped_running_sums_span_ranges(spark):
    from riskcard.plans.prefix import running_sums
    rows = [("a" if i % 10 else None, i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): r.s for r in running_sums(df, ["k"], {"s": "v"}, groups=["g"], partitions=6).collect()}
    want, tot = {}, {}
    for g, k, v in sorted(rows, key=lambda t: t[1]):
        tot[g] = tot.get(g, 0) + v
        want[(g, k)] = tot[g]
    assert got == want


def test_single_window_refuses_fractional_keys(spark):
    df = spark.createDataFrame([(0.25, 1), (0.5, 0)], "p double, y int")
    g = V.score_grain(df, "p", "y")
    with pytest.raises(ValueError):
        V.ks_table(g, "p")
    assert V.model_metrics(g, "p", bad_high=True, partitions=None).collect()[0]["auc2"] == 0.0


def test_cutoffs_come_highest_first(spark):
    _, g = grain(spark, [(i, (i * 7) % 11, i % 2) for i in range(50)])
    got = [r.cutoff_score for r in V.ppt_table(g, "score", *V.scaling()).collect()]
    assert got == sorted(got, reverse=True)


@pytest.mark.parametrize("partitions", [1, None])
def test_selection_on_raw_predictions(spark, partitions):
    """Percentiles and cutoff of fractional keys equal numpy's; with integer keys both methods agree."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=500).round(2) if partitions is None else rng.integers(-40, 40, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-z))).astype(int)
    kind = "z double, y int" if partitions is None else "z int, y int"
    df = spark.createDataFrame([(z[i].item(), int(y[i])) for i in range(500)], kind)
    g = V.score_grain(df, "z", "y")
    qs = (0.0, 0.1, 0.37, 0.5, 1.0)
    got = V.score_percentiles(g, "z", qs, partitions=partitions).first()
    assert np.allclose(list(got), np.quantile(z, qs))
    best = V.optimal_cutoff(g, "z", ascending=True, partitions=partitions, digits=6).first()
    keys = np.unique(z)
    ks = [abs((z[y == 1] <= k).mean() - (z[y == 0] <= k).mean()) for k in keys]
    frac = (z <= keys[int(np.argmax(ks))]).mean()
    assert abs(best["group"] - frac) < 1e-12 and abs(best["cutoff"] - np.quantile(z, frac)) < 1e-6
    if partitions is None:
        down = V.optimal_cutoff(g, "z", ascending=False, partitions=None, digits=6).first()
        ks = [abs((z[y == 1] >= k).mean() - (z[y == 0] >= k).mean()) for k in keys[::-1]]
        frac = (z >= keys[::-1][int(np.argmax(ks))]).mean()
        assert abs(down["group"] - frac) < 1e-12 and abs(down["cutoff"] - np.quantile(z, 1 - frac)) < 1e-6


def test_selection_on_empty_table(spark):
    g = V.score_grain(spark.createDataFrame([], "z double, y int"), "z", "y")
    assert list(V.score_percentiles(g, "z", partitions=None).first()) == [None] * 5
    assert V.optimal_cutoff(g, "z", partitions=None).first()["cutoff"] is None
