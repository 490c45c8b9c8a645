"""Running sums, row numbers and carried values over ranges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from riskcard.operators import evaluate as V
from riskcard.plans import prefix as X


def rows(n=400, seed=5):
    rnd = random.Random(seed)
    return [(k, rnd.choice([None, "a", "b", "c"]), rnd.choice([None, 0.5, 1.5, 2.5]), rnd.randrange(5),
             rnd.choice([None, rnd.randrange(9)])) for k in range(n)]


KIND = "id long, g string, key double, n int, v int"


@pytest.mark.parametrize("partitions", [1, 7, None])
@pytest.mark.parametrize("ascending", [True, False])
def test_running_sums_per_group(spark, partitions, ascending):
    data = rows()
    df = spark.createDataFrame(data, KIND).withColumn("f", F.col("n") / 4)
    got = X.running_sums(df, ["key", "id"], {"cum": "n", "at": "1", "half": "f"}, ascending, partitions, groups=["g"])
    assert got.columns == [*df.columns, "cum", "at", "half"]
    order = lambda r: (r[2] is None, (r[2] or 0) * (1 if ascending else -1), r[0] * (1 if ascending else -1))
    want, held = {}, {}
    for r in sorted(data, key=order):
        cum, at = held.get(r[1], (0, 0))
        held[r[1]] = cum + r[3], at + 1
        want[r[0]] = (*held[r[1]], held[r[1]][0] / 4)
    assert {r.id: (r.cum, r.at, r.half) for r in got.collect()} == want


def test_small_arrow_batches_change_nothing(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame(rows(300), KIND)
    want = sorted(map(tuple, X.running_sums(df, ["id"], {"cum": "n"}, groups=["g"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, X.running_sums(df, ["id"], {"cum": "n"}, groups=["g"], partitions=2).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("partitions", [1, 8])
def test_carried_over_runs_longer_than_a_range(spark, ascending, partitions):
    data = [(k, k * 10 if k in (3, 4, 170) else None, f"t{k}" if k % 50 == 0 else None) for k in range(200)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "id long, v long, s string")
    want_v, want_s, v, s = {}, {}, None, None
    for k, x, t in sorted(data, reverse=not ascending):
        v, s = (x if x is not None else v), (t or s)
        want_v[k], want_s[k] = v, s
    got = X.carried(df, "v", ["id"], ascending, partitions)
    assert got.columns == df.columns and {r.id: r.v for r in got.collect()} == want_v
    assert {r.id: r.s for r in X.carried(df, "s", ["id"], ascending, partitions).collect()} == want_s


def test_backfill_of_any_size(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 400 == 399, F.col("id")).alias("v"))
    got = {r.id: r.v for r in V.backfill(df, "v", "id", partitions=16).collect()}
    assert got == {k: (399 if k < 400 else 799 if k < 800 else None) for k in range(1000)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], KIND)
    assert X.running_sums(df, ["id"], {"cum": "n"}, groups=["g"]).count() == 0
    assert X.carried(df, "v", ["id"]).count() == 0


def test_row_numbers_shuffle_the_rows_once(spark):
    """What is read after the write needs no further exchange of rows."""
    df = X.global_row_number(spark.createDataFrame(rows(50), KIND), ["key", "id"], "rn")
    plan = df._jdf.queryExecution().executedPlan().toString()
    body = [line for line in plan.split("\n") if "Exchange" in line and "BroadcastExchange" not in line]
    # the exchanges that are left belong to the sums per range: one row per range
    assert all("_range" in line or "SinglePartition" in line for line in body) and "REPARTITION" not in plan
    assert sorted(r.rn for r in df.collect()) == list(range(1, 51))
