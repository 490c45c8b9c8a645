"""Pre-bins counted by leading bits equal those of the whole value table."""

import random

from pyspark.sql import functions as F

from riskcard.operators import binning as B


def by_values(df, features):
    values = B.written(B.numeric_counts(df, features, "y"), "value-counts")
    pb = B.ordered_prebins(values.where("x is not null"), ["x"])
    return pb.groupBy("feature", "pb").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("x").alias("hi"))


def test_equal_to_the_value_table(spark):
    rnd = random.Random(11)
    tiny = [1.0 + k * 2.0**-52 for k in range(40)]            # differ in the last bits only
    row = lambda: (rnd.gauss(0, 1), rnd.choice(tiny), float(rnd.randint(-4, 4)), rnd.choice([0.0, -0.0, 5.0, None, float("nan")]),
                   7.0, rnd.choice([float("inf"), -float("inf"), rnd.uniform(-1e300, 1e300), 5e-324]), None, rnd.randint(0, 1))
    df = spark.createDataFrame([row() for _ in range(3000)], "a double, b double, c double, d double, e double, f double, g double, y int")
    names = list("abcdefg")
    got = B.prebin_counts(df, names, "y")
    present = got.where("pb is not null")
    want = by_values(df, names)
    assert sorted(map(tuple, present.collect())) == sorted(map(tuple, want.select("feature", "pb", "n", "bad", "hi").collect()))
    gone = {r.feature: r.n for r in got.where("pb is null").collect()}
    assert gone["g"] == 3000 and set(gone) == {"d", "g"}
    assert B.prebin_counts(df.limit(0), names, "y").count() == 0


def test_few_cells_for_many_values(spark, monkeypatch):
    """200,000 distinct numbers: what a pass counts does not grow with them."""
    seen, write = [], B.written

    def count(df, name):
        out = write(df, name)
        if name == "radix-cells":
            seen.append(out.count())
        return out

    monkeypatch.setattr(B, "written", count)
    df = spark.range(200_000).select((F.col("id") / 200_000 + 1).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = B.prebin_counts(df, ["a"], "y").collect()
    assert len(rows) == 20 and sum(r.n for r in rows) == 200_000
    assert seen[0] <= 2**16 and all(n <= 19 * 2**12 for n in seen[1:])
