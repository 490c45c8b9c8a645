"""IV tables and missing rates (FIXTURES M1, D1-D4)."""

import math

from riskcard.operators import profile as PR


def test_pure_values_add_no_iv_m1(spark):
    df = spark.createDataFrame([("g", 0), ("g", 0), ("b", 1), ("b", 1), ("m", 0), ("m", 1)], "f string, y int")
    vt = {r["value"]: r for r in PR.value_table(df, ["f"], "y").collect()}
    assert vt["g"]["woe"] == 0.0 and vt["g"]["iv"] == 0.0
    assert vt["b"]["woe"] == 0.0 and vt["b"]["iv"] == 0.0
    assert vt["m"]["iv"] == 0.0  # equal shares: ln(1) = 0


def test_iv_matches_hand_computation(spark):
    rows = [("a", 0)] * 30 + [("a", 1)] * 10 + [("b", 0)] * 20 + [("b", 1)] * 40 + [(None, 0)] * 5
    df = spark.createDataFrame(rows, "f string, y int")
    iv = PR.iv_by_feature(PR.value_table(df, ["f"], "y")).collect()[0]["iv"]
    n, b = 105, 50
    expect = 0.0
    for a, bad in [(40, 10), (60, 40), (5, 0)]:
        dg, db = (a - bad) / (n - b), bad / b
        if dg > 0 and db > 0:
            expect += (dg - db) * math.log(dg / db)
    assert abs(iv - expect) < 1e-12


def test_missing_rate_percent(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    r = PR.missing_rate(df).collect()[0]
    assert r["feature"] == "x" and abs(r["missing_rate"] - 33.33) < 1e-9


def test_cardinality_exact_and_approx(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "x long, s string")
    ex = {r[0]: r[1] for r in PR.cardinality(df, ["x", "s"]).collect()}
    ap = {r[0]: r[1] for r in PR.cardinality(df, ["x", "s"], approx=True).collect()}
    assert ex == {"x": 2, "s": 2} and ap == ex
