"""Scans and report helpers."""

from datetime import datetime

import pytest
from conftest import SMALL

from riskcard.session import scratch_path
from riskcard.sources import report as RP
from riskcard.sources.tables import read_table, reader_format, scan, write_csv


def test_reader_by_extension_case_insensitive():
    assert reader_format("/x/Table.PARQUET") == "parquet"
    assert reader_format("/x/a.Csv") == "csv"
    with pytest.raises(ValueError):
        reader_format("/x/book.xlsx")


def test_csv_round_trip_infers_types(spark):
    path = scratch_path(spark, "nation") + ".csv"
    write_csv(read_table(spark, SMALL, "nation"), path)
    back = scan(spark, path)
    assert dict(back.dtypes) == {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    assert back.count() == 25


def test_run_name_format(spark):
    assert RP.run_name("demo", datetime(2024, 3, 9, 7, 5, 1)) == "demo_09-03-2024_07-05-01"
    df = spark.createDataFrame([(datetime(2024, 3, 9, 7, 5, 1),)], "t timestamp_ntz")
    assert df.select(RP.run_name_col("demo", "t")).first()[0] == "demo_09-03-2024_07-05-01"


def test_round_for_export_half_even(spark):
    df = spark.createDataFrame([(0.12345, 2.5, 7)], "a double, b double, c int")
    r = RP.round_for_export(df, 4).first()
    assert r["a"] == 0.1234 and r["b"] == 2.5 and r["c"] == 7


def test_bad_lines_are_captured(spark):
    from pyspark.sql import types as T

    from riskcard.sources.tables import line_counts
    path = scratch_path(spark, "bad") + ".csv"
    spark.createDataFrame([("a,b",), ("1,x",), ("two,y",), ("3,",), ("4,z,more",)], "value string").coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    got = scan(spark, path, schema, bad_lines="_bad").collect()
    assert sorted((r._bad or "", r.a, r.b) for r in got) == [("", 1, "x"), ("", 3, None), ("4,z,more", 4, "z"),
                                                               ("two,y", None, "y")]
    counts = {r.feature: (r.lines, r.bad, r.nulls) for r in line_counts(scan(spark, path, schema, "_bad"), "_bad").collect()}
    assert counts == {"a": (4, 2, 1), "b": (4, 2, 1)}
    with pytest.raises(ValueError):
        scan(spark, path, bad_lines="_bad")


def test_a_stopped_run_leaves_no_report(spark):
    root = scratch_path(spark, "report")
    good = spark.createDataFrame([(1, 0.123456)], "a int, b double")
    bad = spark.range(3).selectExpr("assert_true(id < 2) AS x", "id")
    with pytest.raises(Exception):
        RP.write_report(spark, {"one": good, "two": good, "three": bad}, base=root)
    with pytest.raises(Exception):
        RP.read_report(spark, root, "one")
    RP.write_report(spark, {"one": good}, good.selectExpr("'f' AS feature", "a"), base=root)
    assert [tuple(r) for r in RP.read_report(spark, root, "one").collect()] == [(1, 0.1235)]
    # a later run that fails leaves the finished report in place
    with pytest.raises(Exception):
        RP.write_report(spark, {"one": good.union(good), "three": bad}, base=root)
    assert RP.read_report(spark, root, "one").count() == 1
    assert {r.table_name: r.rows for r in RP.report_manifest(spark, root).collect()} == {"one": 1, "bins": 1}
    with pytest.raises(ValueError):
        RP.read_report(spark, root, "none")


def test_exported_widths(spark):
    df = spark.createDataFrame([(1.0, 10, None), (-0.12345, 7, "abc"), (123.5, 1, "")], "x double, n int, s string")
    got = {r.feature: r.max_len for r in RP.column_widths(df).collect()}
    assert got == {"x": len("-0.1234"), "n": 2, "s": 3}
