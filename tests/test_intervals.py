"""Interval join against every pair, and its plan."""

import random

from pyspark.sql import functions as F

from riskcard.operators.bins import NumericBins, apply_bins, apply_numeric_range_join
from riskcard.operators.intervals import cell_borders, interval_join

INF = float("inf")


def tables(spark, seed=3):
    rnd = random.Random(seed)
    edge = lambda: rnd.choice([rnd.uniform(-5, 5), float(rnd.randint(-3, 3)), -INF, INF])
    intervals = [(f, edge(), edge(), f"{f}{k}") for f in "ab" for k in range(120)] + [("a", None, 1.0, "none"), ("z", 0.0, 1.0, "z")]
    value = lambda: rnd.choice([None, float("nan"), rnd.uniform(-6, 6), float(rnd.randint(-3, 3)), INF, -INF, 1.0])
    rows = [(i // 2, value(), value(), value()) for i in range(300)] + [(1000, 1.0, 1.0, 1.0)] * 150
    return (rows, spark.createDataFrame(rows, "id long, a double, b double, c double"),
            intervals, spark.createDataFrame(intervals, "feature string, lo double, hi double, name string"))


def test_every_pair(spark):
    rows, df, intervals, table = tables(spark)
    want = []
    for i, *xs in rows:
        for f, x in zip("abc", xs):
            inside = [n for g, lo, hi, n in intervals if g == f and x is not None and lo is not None and lo < hi and x == x
                      and (lo < x or lo == -INF) and x <= hi]
            want += [(i, f, n) for n in inside or [None]]
    for cells in (1, 7, 1024):
        got = interval_join(df, ["a", "b", "c"], table, ["id"], cells)
        assert got.columns == ["id", "feature", "x", "lo", "hi", "name"]
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(((r.id, r.feature, r.name) for r in got.collect()), key=key) == sorted(want, key=key)
        assert all(len(b) <= cells for b in cell_borders(table, cells).values())
    assert interval_join(df, ["a"], table.limit(0), ["id"]).where("name is null").count() == len(rows)
    assert interval_join(df.limit(0), ["a"], table, ["id"]).count() == 0


def test_labels_by_one_equi_join(spark):
    _, df, _, _ = tables(spark)
    df = df.withColumn("a", F.nanvl("a", F.lit(0.5))).withColumn("b", F.nanvl("b", F.lit(0.5)))
    bins = [NumericBins("a", (-2.0, 1.0, 1.5)), NumericBins("b", ())]
    got = apply_numeric_range_join(df, bins, "id", spark)
    want = apply_bins(df, bins, ["id"])
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
