"""Monotone binning fit (FIXTURES M7, M9, M10 and the binning golden values)."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskcard.operators import binning as B
from riskcard.operators.bins import CategoricalBins, NumericBins, apply_bins


def brute(n, e, trend, missing=(0, 0)):
    """Every contiguous segmentation, kept when strictly monotone; same tie rule."""
    p = len(n)
    G, Bt = sum(n) - sum(e) + missing[0] - missing[1], sum(e) + missing[1]
    best = None
    for mask in range(1 << (p - 1)):
        starts = [0] + [i + 1 for i in range(p - 1) if mask >> i & 1]
        ends = starts[1:] + [p]
        segs = [(sum(n[s:t]), sum(e[s:t])) for s, t in zip(starts, ends)]
        ok = all((a[1] * b[0] < b[1] * a[0]) if trend == "ascending" else (a[1] * b[0] > b[1] * a[0])
                 for a, b in zip(segs, segs[1:]))
        if not ok:
            continue
        iv = sum(B._segment_iv(a, b, G, Bt) for a, b in segs)
        key = (round(iv, B.IV_DIGITS), -len(starts), tuple(-s for s in starts))
        if best is None or key > best[0]:
            best = (key, starts, iv)
    return best[1], best[2] + B._segment_iv(*missing, G, Bt)


ACCT = ([2406, 2399, 2396, 2408, 2398, 2393], [1260, 1055, 904, 794, 544, 408])
PRICE = ([2375] * 6, [555, 667, 784, 826, 993, 1084])
DISC = ([2541, 2588, 2683, 2158, 2397, 2376], [735, 922, 1009, 874, 905, 678])
QTY = ([2525, 2419, 2444, 2503, 2444, 2408], [472, 622, 783, 893, 1053, 1300])


def test_golden_values():
    s, iv = B.fit_monotone(*ACCT, "descending")
    assert s == [0, 1, 2, 3, 4, 5] and round(iv, 6) == 0.300943
    s, iv = B.fit_monotone(*ACCT, "ascending")
    assert s == [0] and iv == 0.0
    s, iv = B.fit_monotone(*PRICE, "ascending")
    assert len(s) == 6 and round(iv, 6) == 0.114885
    s, iv = B.fit_monotone(*DISC, "ascending")
    assert s == [0, 1, 2] and round(iv, 6) == 0.014299
    s, iv = B.fit_monotone(*DISC, "descending")
    assert s == [0, 5] and round(iv, 6) == 0.015024
    s, iv = B.fit_monotone(*QTY, "ascending")
    assert len(s) == 6 and round(iv, 6) == 0.263642


def test_merges_to_monotone_m7():
    # bad rates 0.1, 0.3, 0.2, 0.5 -> the middle pair must merge for an ascending trend
    s, _ = B.fit_monotone([100, 100, 100, 100], [10, 30, 20, 50], "ascending")
    assert s == [0, 1, 3]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 60)), min_size=1, max_size=7),
       st.sampled_from(["ascending", "descending"]), st.tuples(st.integers(0, 30), st.integers(0, 30)))
def test_dp_equals_brute_force(cells, trend, gap):
    n = [a + b for a, b in cells]
    e = [b for a, b in cells]
    missing = (gap[0] + gap[1], gap[1])
    s1, iv1 = B.fit_monotone(n, e, trend, missing)
    s2, iv2 = brute(n, e, trend, missing)
    assert s1 == s2 and abs(iv1 - iv2) < 1e-9


def test_merging_never_raises_iv():
    n, e = DISC
    _, best = B.fit_monotone(n, e, "ascending")
    G, Bt = sum(n) - sum(e), sum(e)
    single = B._segment_iv(sum(n), sum(e), G, Bt)
    assert best >= single - 1e-15


def test_value_on_split_goes_to_lower_bin_m9(spark):
    b = NumericBins("x", (1.0, 2.0))
    df = spark.createDataFrame([(1.0,), (1.5,), (2.0,), (None,), (9.0,)], "x double")
    got = [r[0] for r in apply_bins(df, [b]).collect()]
    assert got == ["(-inf, 1.0]", "(1.0, 2.0]", "(1.0, 2.0]", "NaN", "(2.0, inf]"]


def test_unseen_and_null_category_m10(spark):
    b = CategoricalBins("c", (("a", "b"), ("z",)))
    df = spark.createDataFrame([("a",), ("z",), ("new",), (None,)], "c string")
    got = [r[0] for r in apply_bins(df, [b]).collect()]
    assert got == ["['a' 'b']", "['z']", "NaN", "NaN"]


def test_fit_job_matches_python(spark):
    rows = []
    for pb, (n, e) in enumerate(zip(*DISC)):
        rows.append(("f", pb, n, e))
    counts = spark.createDataFrame(rows, "feature string, pb int, n long, bad long")
    trends = spark.createDataFrame([("f", "ascending")], "feature string, trend string")
    r = B.fit_bins(counts, trends).collect()[0]
    assert list(r["starts"]) == [0, 1, 2] and round(r["iv"], 6) == 0.014299


def test_bin_table_sums_to_rows(spark):
    df = spark.createDataFrame([(f"l{i % 3}", i % 2) for i in range(99)], "f_cat string, y int")
    bt = B.with_totals(B.bin_table(df, ["f_cat"], "y"))
    tot = bt.filter(F.col("label") == "Totals").collect()[0]
    assert tot["n"] == 99 and abs(tot["n_pct"] - 1.0) < 1e-12
    assert tot["iv"] >= 0


def test_category_prebins_bounded_and_ordered(spark):
    # 300 small categories with distinct event rates: at most 20 pre-bins, ordered by rate
    rows = []
    for c in range(300):
        bad = c % 7
        rows += [(f"c{c:03d}", 1)] * bad + [(f"c{c:03d}", 0)] * (10 - bad)
    df = spark.createDataFrame(rows, "f string, y int")
    cp = B.category_prebins(df, ["f"], "y").collect()
    pbs = {r["pb"] for r in cp}
    assert len(pbs) <= 20 and min(pbs) == 0
    by_rate = sorted(cp, key=lambda r: (r["rate"], r["value"]))
    assert [r["pb"] for r in by_rate] == sorted(r["pb"] for r in by_rate)


def test_presence_bin_labels(spark):
    b = CategoricalBins("c", (("not NaN",),), names=("not NaN",))
    df = spark.createDataFrame([("not NaN",), (None,)], "c string")
    assert [r[0] for r in apply_bins(df, [b]).collect()] == ["not NaN", "NaN"]


def test_small_prebins_merge_forward():
    assert B.merge_small([94, 1, 5]) == [0, 1, 1]
    assert B.merge_small([34, 1, 65]) == [0, 1, 1]
    assert B.merge_small([50, 50, 1]) == [0, 1, 1]
    assert B.merge_small([1, 1, 1]) == [0, 1, 2]
    assert B.merge_small([3, 2, 95]) == [0, 0, 1]


def test_zero_inflated_number_and_rare_category(spark):
    rows = [(0.0 if i < 940 else float(i), "a" if i < 340 else "b" if i < 350 else "c", int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, c string, y int")
    n = [r["n"] for r in B.prebin_counts(df, ["x"], "y").orderBy("pb").collect()]
    assert n == [940, 60]
    by = B.category_prebin_counts(B.category_prebins(df, ["c"], "y")).collect()
    assert min(r["n"] for r in by) >= 50 and sum(r["n"] for r in by) == 1000


def test_informative_missing_values_are_in_the_iv(spark):
    """The values say nothing, 30% are missing and mostly bad: the screen sees it."""
    rows = []
    for i in range(3000):
        gap = i % 10 < 3
        y = int(i % 100 < 70) if gap else int((i * 7) % 100 < 20)
        rows.append((None if gap else float(i * 31 % 500), None if gap else f"c{i * 17 % 5}", y))
    df = spark.createDataFrame(rows, "x double, c string, y int")
    status, bins, counts = B.screen_features(spark, df, "y", ["c"], {"x": "ascending"}, max_iv=10.0)
    got = {r["feature"]: r for r in status.collect()}
    table = B.complete_table(counts, spark.createDataFrame(
        [(b.feature, i, lab) for b in bins for i, lab in enumerate(b.labels)], "feature string, bin_id int, label string"))
    for f in ("x", "c"):
        lines = [r for r in table.collect() if r["feature"] == f]
        assert [r["label"] for r in lines[-3:]] == ["Special", "Missing", "Totals"]
        assert lines[-1]["n"] == 3000 and lines[-2]["n"] == 900 and lines[-3]["n"] == 0
        assert got[f]["status"] == "selected" and abs(got[f]["iv"] - lines[-1]["iv"]) < 1e-9 and got[f]["iv"] > 0.5


def test_many_categories_are_never_collected(spark):
    """100,000 categories: members stay a table, labels name a few, codes match the members."""
    from riskcard.operators.bins import MISSING_CODE, apply_codes
    df = (spark.range(200_000).selectExpr("id", "concat('k', id % 100000) AS c",
                                          "CAST((id % 100000) % 10 < 1 + (id % 100000) % 7 AS INT) AS y"))
    _, bins, counts = B.screen_features(spark, df, "y", ["c"], {}, max_iv=50.0)
    (b,) = bins
    assert b.members.count() == 100_000
    assert all("more" in lab and len(lab) < 300 for lab in b.labels)
    coded = apply_codes(df.unionByName(spark.createDataFrame([(-1, "new", 0), (-2, None, 1)], "id long, c string, y int")),
                        bins, keep=["id", "c"])
    wrong = coded.join(b.members, coded["c"] == b.members["value"], "left").where(
        F.coalesce(F.col("bin_id"), F.lit(MISSING_CODE)) != F.col("c_cat")).count()
    assert wrong == 0 and coded.where(F.col("c_cat") == MISSING_CODE).count() == 2
    assert counts.agg(F.sum("n")).head()[0] == 200_000


def tree_leaves(values, max_prebins=20, min_share=0.05):
    """Leaves of one feature's tree, by plain recursion over its sorted (x, n, bad) values."""
    total = sum(n for _, n, _ in values)
    least = max(1, math.ceil(min_share * total))

    def gini(n, b):
        return (b * b + (n - b) * (n - b)) / n

    def grow(part):
        n, b = sum(v[1] for v in part), sum(v[2] for v in part)
        best, cn, cb = None, 0, 0
        for i, (_, k, e) in enumerate(part[:-1], 1):
            cn, cb = cn + k, cb + e
            if cn >= least and n - cn >= least:
                gain = gini(float(cn), float(cb)) + gini(float(n - cn), float(b - cb))
                if best is None or gain > best[0]:
                    best = gain, i
        if best is None or b in (0, n):
            return [part]
        return grow(part[:best[1]]) + grow(part[best[1]:])
    return [(k, sum(v[1] for v in p), sum(v[2] for v in p), p[-1][0]) for k, p in enumerate(grow(values))]


def test_tree_prebins_match_recursion(spark):
    rnd = random.Random(8)
    table = {"steps": [(float(x), rnd.randint(1, 9), 0) for x in range(120)],
             "few": [(0.0, 5, 1), (1.0, 90, 30), (2.0, 5, 4)], "pure": [(float(x), 4, 4) for x in range(9)],
             "hot": [(-1.0, 3, 1), (0.0, 900, 400), (1.0, 60, 1), (2.0, 37, 30)], "one": [(7.0, 10, 3)]}
    table["steps"] = [(x, n, sum(rnd.random() < (0.1 + 0.3 * (int(x) // 30 % 2)) for _ in range(n))) for x, n, _ in table["steps"]]
    df = spark.createDataFrame([(f, *v) for f, vs in table.items() for v in vs], "feature string, x double, n long, bad long")
    got = {}
    for r in B.tree_prebins(df).orderBy("feature", "pb").collect():
        got.setdefault(r.feature, []).append((r.pb, r.n, r.bad, r.hi))
    assert got == {f: tree_leaves(vs) for f, vs in table.items()}
    # fewer leaves than the tree could have: the cuts of largest gain
    some = [r for r in B.tree_prebins(df, max_prebins=3).collect() if r.feature == "steps"]
    assert len(some) == 3 and sum(r.n for r in some) == sum(v[1] for v in table["steps"])


def test_prebin_methods(spark):
    df = spark.createDataFrame([(float(k % 10), int(k % 10 > 6), None if k % 5 else 1.0) for k in range(200)],
                               "a double, y int, b double")
    got = B.prebin_counts(df, ["a", "b"], "y", method="tree").collect()
    assert {(r.feature, r.pb) for r in got if r.feature == "b"} == {("b", 0), ("b", None)}
    assert sorted((r.pb, r.n, r.bad, r.hi) for r in got if r.feature == "a") == [(0, 140, 0, 6.0), (1, 60, 60, 9.0)]
    with pytest.raises(ValueError):
        B.prebin_counts(df, ["a"], "y", method="other")
