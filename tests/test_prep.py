"""Cleaning rules and roles (FIXTURES M4, M5, M12)."""

import pytest
from pyspark.sql import functions as F

from riskcard.operators import prep


def test_roles_m4(spark):
    df = spark.createDataFrame(
        [(None, 0, 0, "a"), (None, 1, 1, "b"), (None, None, 2, None)],
        "all_null double, binary int, three int, s string")
    roles = {r["feature"]: r["role"] for r in prep.column_roles(df, df.columns).collect()}
    assert roles == {"all_null": "categorical", "binary": "categorical", "three": "numeric", "s": "categorical"}


def test_sentinels_whole_cell_m5(spark):
    df = spark.createDataFrame([(".",), ("NULL",), ("a.b",), ("null",), (None,)], "s string")
    got = [r["s"] for r in prep.replace_sentinels(df).collect()]
    assert got == [None, None, "a.b", "null", None]


def test_sparse_threshold_strict_m12(spark):
    # 19 of 20 null = 0.95 exactly: kept, since the comparison is strict
    rows = [(i, None if i < 19 else 1.0, None if i < 20 else 1.0, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, at double, over double, y int")
    out = prep.clean_columns(df, "y", "id", 0.95)
    assert out.columns == ["id", "at", "y"]


def test_threshold_must_be_fraction(spark):
    df = spark.createDataFrame([(1, 0)], "id long, y int")
    with pytest.raises(ValueError):
        prep.clean_columns(df, "y", "id", 95)


def test_name_and_type_rules(spark):
    df = spark.createDataFrame(
        [(1, 2, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 0)],
        "id long, MBID long, ext_score double, NAP double, rate_S double, CLx double, startDT double, "
        "keep double, GDPx double, y int")
    out = prep.clean_columns(df, "y", "id")
    assert out.columns == ["id", "keep", "y"]


def test_dictionary_roles_and_direction_check(spark):
    d = spark.createDataFrame(
        [("a", "Numeric", ">"), ("b", "Character (#,###.##)", "<"), ("c", "Char", "Y"), ("d", "Char", "N"),
         ("e", None, ">"), ("f", "Char", ">")], "variable string, type string, sign string")
    roles = {r["feature"]: r["role"] for r in prep.dictionary_roles(d, spark, extra_asc=["g"]).collect()}
    assert roles == {"a": "num_desc", "b": "num_asc", "c": "cat_y", "d": "cat_n", "g": "num_asc"}
    with pytest.raises(ValueError):
        prep.check_directions(prep.dictionary_roles(d, spark, extra_asc=["a"]))


def test_new_predictors_anti_join(spark):
    roles = spark.createDataFrame([("a", "numeric"), ("z", "numeric"), ("c", "categorical")],
                                  "feature string, role string")
    d = spark.createDataFrame([("a", "Numeric", ">")], "variable string, type string, sign string")
    assert [r[0] for r in prep.new_predictors(roles, d).collect()] == ["z"]
