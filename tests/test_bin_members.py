"""The report says which bin, and so which points, every category has."""

from functools import partial

from pyspark.sql import functions as F

from riskcard import __main__ as cli
from riskcard import session


def test_report_has_every_category_of_a_bin_of_more_than_ten(spark, tmp_path, monkeypatch):
    apps = session.scratch_path(spark, "members") + ".parquet"
    i = F.col("id")
    bad = F.when(i % 60 < 30, i % 10 < 3).otherwise(i % 10 < 5)
    bad = F.when(F.floor(i / 60) % 2 == 0, bad).otherwise((i * 7) % 10 < 4)
    df = spark.range(6000).select(i.alias("app_id"), bad.cast("int").alias("pi"),
                                  F.format_string("town %02d", i % 60).alias("town"),
                                  F.when(i % 7 > 0, F.when(i % 3 == 0, "a").otherwise("b")).alias("kind"))
    df.write.parquet(apps)
    monkeypatch.setattr(session, "_SCRATCH", [])         # the end of the run deletes its own folders only
    monkeypatch.setattr(cli, "BuildParams", partial(cli.BuildParams, max_iv=99.0, grid_penalties=("l2",), grid_c=(1.0,)))
    root = cli.main(["--input", apps, "--target", "pi", "--id", "app_id", "--min-iv", "-1",
                     "--out", str(tmp_path / "reports")])
    members = spark.read.parquet(f"{root}/bin_members")
    assert members.columns == ["feature", "value", "bin_id"]
    got = {(r.feature, r.value): r.bin_id for r in members.collect()}
    assert members.count() == len(got) == 62
    assert set(got) == {("town_cat", f"town {k:02d}") for k in range(60)} | {("kind_cat", "a"), ("kind_cat", "b")}
    bins = {(r.feature, r.position): r for r in spark.read.parquet(f"{root}/bins").collect()}
    assert any(" more]" in b.label for b in bins.values())
    # the bin table's counts follow from the members
    rows = [(f"{c}_cat", r[c]) for r in df.collect() for c in ("town", "kind") if r[c] is not None]
    for (f, p), b in bins.items():
        if p < 1000:
            assert b.n == sum(1 for x in rows if x[0] == f and got[x] == p)
