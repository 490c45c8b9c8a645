"""Interval join (C6): values and the intervals ``lo < x <= hi`` that hold them, by an equi-join.

The edges of a feature's intervals are cut into at most CELLS cells of about as many edges each.  An
interval goes to the cells that it meets, a value to its own one, and the join is on (feature, cell)
with ``lo < x <= hi`` confirmed.  So the interval table may be of any size and hold any number of
features: there is one join, which Spark broadcasts under its size limit and else shuffles, and
adaptive execution splits a hot cell.  Cells are found in the JVM (``Bucketizer``: binary search).

Defined cases: NULL and NaN values are in no interval, an empty interval (lo >= hi) holds nothing,
intervals with a NULL end are left out; overlapping intervals give one row each; infinite ends are open
ends, which hold the infinity itself.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1024


def cell_borders(intervals: DataFrame, cells: int = CELLS) -> dict[str, list[float]]:
    """Per feature at most ``cells`` finite edges, spread evenly over the edges of its intervals."""
    edges = (intervals.select("feature", F.explode(F.array("lo", "hi")).alias("e"))
             .where(F.abs("e") < float("inf")))
    found = edges.groupBy("feature").agg(
        F.percentile_approx("e", [k / cells for k in range(cells)], 10 * cells).alias("e")).collect()
    return {r.feature: sorted({x + 0.0 for x in r.e}) for r in found}       # at most ``cells`` numbers a feature


def _cells(df: DataFrame, columns: list[str], borders: list[list[float]], outs: list[str]) -> DataFrame:
    inf = float("inf")
    return Bucketizer(splitsArray=[[-inf, *(b or [0.0]), inf] for b in borders], inputCols=columns, outputCols=outs,
                      handleInvalid="keep").transform(df)


def interval_join(df: DataFrame, features: list[str], intervals: DataFrame, keep: list[str],
                  cells: int = CELLS) -> DataFrame:
    """(keep..., feature, x, <other columns of intervals>): one row per value of ``features`` and interval
    (feature, lo, hi, ...) that holds it, and one with NULLs for a value that is in none."""
    borders = cell_borders(intervals, cells)
    number = lambda c: F.col(c).cast("double")
    wide = df.select(F.struct(*keep).alias("_keep"), *[
        F.when(~F.isnan(number(c)), number(c)).alias(f"_x{i}") for i, c in enumerate(features)])
    xs, cs = [f"_x{i}" for i in range(len(features))], [f"_c{i}" for i in range(len(features))]
    wide = _cells(wide, xs, [borders.get(f, []) for f in features], cs)
    long = wide.select("_keep", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(x).alias("x"), F.when(F.col(x).isNotNull(), F.col(c)).cast("int").alias("_cell"))
        for f, x, c in zip(features, xs, cs)])).alias("v")).select("_keep", "v.*")
    # an interval in every cell that it meets
    used = intervals.where(F.col("feature").isin(features) & (F.col("lo") < F.col("hi")))
    ends = used.select(*[F.when(F.col("feature") == f, F.col(e)).alias(f"_{e}{i}") for i, f in enumerate(features)
                         for e in ("lo", "hi")], F.struct(*intervals.columns).alias("_all"))
    names = [f"{e}{i}" for i in range(len(features)) for e in ("lo", "hi")]
    ends = _cells(ends, ["_" + n for n in names], [borders.get(f, []) for f in features for _ in range(2)],
                  ["_at_" + n for n in names])
    at = lambda e: F.coalesce(*[F.when(F.col(f"_{e}{i}").isNotNull(), F.col(f"_at_{e}{i}")).cast("int")
                                for i in range(len(features))])
    met = (ends.select("_all", F.explode(F.sequence(at("lo"), at("hi"))).alias("_in"))
           .select("_in", F.col("_all.feature").alias("_f"), F.col("_all.lo").alias("_lo"), F.col("_all.hi").alias("_hi"), "_all"))
    holds = ((F.col("feature") == F.col("_f")) & (F.col("_cell") == F.col("_in"))
             & ((F.col("x") > F.col("_lo")) | (F.col("_lo") == -float("inf"))) & (F.col("x") <= F.col("_hi")))
    others = [c for c in intervals.columns if c != "feature"]
    return long.join(met, holds, "left").select("_keep.*", "feature", "x", *[F.col("_all")[c].alias(c) for c in others])
