"""One-hot encoding and correlation pruning.

One-hot levels come from the bin metadata, so encoding is a projection with
no pass over the data.  Correlations of all column pairs come from one
pass of pair counts (at most levels^2 rows, independent of the row count);
the pruning rule then runs on that small long table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskcard.functions.exprs import MISSING_LABEL
from riskcard.operators.bins import MISSING_CODE, cat_name, label_codes
from riskcard.plans.prefix import written
from riskcard.session import ship_code


def level_columns(bins) -> list[tuple[str, str, str]]:
    """(column name, binned column, label) for every level incl. the 'NaN' bin.

    Names are ``<feature>_cat__b<k>`` (``__bnan`` for missing): the labels
    themselves contain spaces, brackets and commas.
    """
    out = []
    for b in bins:
        c = cat_name(b.feature)
        for i, lab in enumerate(b.labels):
            out.append((f"{c}__b{i}", c, lab))
        out.append((f"{c}__bnan", c, MISSING_LABEL))
    return out


def one_hot(binned: DataFrame, bins, target: str, id_col: str | None = None) -> DataFrame:
    """0/1 int column per level, columns sorted by name, target last."""
    levels = sorted(level_columns(bins))
    cols = [F.when(F.col(src) == F.lit(lab), 1).otherwise(0).alias(name) for name, src, lab in levels]
    return binned.select(*([id_col] if id_col else []), *cols, target)


def one_hot_codes(coded: DataFrame, bins, target: str, id_col: str | None = None) -> DataFrame:
    """The same table from bin numbers (``bins.apply_codes``)."""
    cols = [F.when(F.col(src) == code, 1).otherwise(0).alias(name) for name, src, code in level_codes(bins)]
    return coded.select(*([id_col] if id_col else []), *cols, target)


def level_codes(bins) -> list[tuple[str, str, int]]:
    """(column name, binned column, bin number) for every level, sorted by column name."""
    out = []
    for b in bins:
        c = cat_name(b.feature)
        out += [(f"{c}__b{i}", c, i) for i in range(len(b.labels))] + [(f"{c}__bnan", c, MISSING_CODE)]
    return sorted(out)


def level_labels(spark: SparkSession, bins) -> DataFrame:
    """(feature, label): the readable name ``<feature> = <bin>`` of every one-hot column."""
    rows = []
    for b in bins:
        c = cat_name(b.feature)
        rows += [(f"{c}__b{i}", f"{b.feature} = {lab}") for i, lab in enumerate(b.labels)]
        rows.append((f"{c}__bnan", f"{b.feature} = {MISSING_LABEL}"))
    return spark.createDataFrame(rows, "feature string, label string")


def level_pair_counts(coded: DataFrame, sizes: list[int]) -> DataFrame:
    """(fa, fb, ca, cb, k): how often bin number ca of column fa meets cb of column fb (fa <= fb).

    A task adds a levels x levels matrix up over its Arrow batches and sends the cells that are not zero,
    so what is shuffled depends on the levels and the tasks, not on the rows.  ``sizes``: bin numbers per
    column, from -1 (missing) up; the matrix is that of all levels, for any number of columns."""
    ship_code(coded.sparkSession)
    offsets = np.r_[0, np.cumsum(sizes)]

    def run(batches):
        total = {}
        for b in batches:
            codes = [pc.cast(c, pa.int64()).to_numpy(zero_copy_only=False) + 1 for c in b.columns]
            for i, a in enumerate(codes):
                for j in range(i, len(codes)):
                    got = np.bincount(a * sizes[j] + codes[j], minlength=sizes[i] * sizes[j])
                    total[i, j] = total[i, j] + got if (i, j) in total else got
        for (i, j), cells in total.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i)), pa.array(np.full(len(at), j)), pa.array(at // sizes[j] - 1),
                 pa.array(at % sizes[j] - 1), pa.array(cells[at].astype(np.int64))], ["fa", "fb", "ca", "cb", "k"])

    parts = coded.mapInArrow(run, "fa long, fb long, ca long, cb long, k long")
    return parts.groupBy("fa", "fb", "ca", "cb").agg(F.sum("k").alias("k")) if offsets[-1] else parts


def corr_pairs_codes(coded: DataFrame, bins, target: str, digits: int = 2) -> DataFrame:
    """(a, b, corr) for every pair of one-hot columns a before b (names sorted, target last),
    Pearson, rounded half-even; NULL for a constant column (D10).

    Levels of a feature exclude each other, so every pair sum is a co-occurrence count of two bin
    numbers (``level_pair_counts``).  The counts are written once; each level is then paired with the
    levels after it by position, an equi-join on tables of at most levels^2 rows; nothing of it passes
    through the driver.
    """
    spark = coded.sparkSession
    names = [cat_name(b.feature) for b in bins] + [target]
    level_no = {n: i for i, n in enumerate(names)}
    base = len(names)
    # bin numbers -1 .. k - 1, the target 0 and 1
    sizes = [len(b.labels) + 1 for b in bins] + [3]
    counts = level_pair_counts(coded.select(*[F.col(n).cast("int").alias(n) for n in names]), sizes)
    counts = written(counts, "level-pairs")
    n = counts.where((F.col("fa") == 0) & (F.col("fb") == 0)).agg(F.sum("k").cast("double").alias("n")).scalar()
    rows = [(name, level_no[src], c) for name, src, c in level_codes(bins)] + [(target, base - 1, 1)]
    levels = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, name string, f long, c long")
    own = counts.where("fa = fb").select(F.col("fa").alias("f"), F.col("ca").alias("c"), "k")
    levels = written(levels.join(own, ["f", "c"], "left").na.fill(0, ["k"]).withColumnRenamed("k", "s"), "levels")
    m = len(rows)
    both_of = spark.range(m * m).select(F.expr(f"id div {m}").alias("pos"), (F.col("id") % m).alias("pos2"))
    right = levels.select(F.col("pos").alias("pos2"), F.col("name").alias("b"), F.col("f").alias("f2"),
                          F.col("c").alias("c2"), F.col("s").alias("s2"))
    j = both_of.where("pos < pos2").join(levels, "pos").join(right, "pos2")
    swap = F.col("f") > F.col("f2")
    turn = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    j = j.select("name", "b", "s", "s2", turn("f", "f2").alias("fa"), turn("f2", "f").alias("fb"),
                 turn("c", "c2").alias("ca"), turn("c2", "c").alias("cb"))
    both = counts.where("fa <> fb")
    j = j.join(both, ["fa", "fb", "ca", "cb"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    var = lambda s: n * F.col(s) - F.col(s).cast("double") * F.col(s)
    corr = F.when((var("s") > 0) & (var("s2") > 0),
                  (n * F.col("k") - F.col("s").cast("double") * F.col("s2")) / F.sqrt(var("s") * var("s2")))
    return j.select(F.col("name").alias("a"), "b", F.bround(corr, digits).alias("corr"))


def corr_pairs_binned(binned: DataFrame, bins, target: str, digits: int = 2) -> DataFrame:
    """The same from labels."""
    return corr_pairs_codes(label_codes(binned, bins, [target]), bins, target, digits)


def corr_prune(pairs: DataFrame, cols: list[str], target: str, threshold: float = 0.67,
               spark: SparkSession | None = None) -> DataFrame:
    """(feature, kept) by the pruning rule of the reference.

    For every pair (earlier j, later i) with |corr| > threshold: drop i when
    |corr(j, target)| > |corr(i, target)|, else drop j.  All pairs vote; an
    earlier drop does not shield a column.  corr(target, target) is 1, so a
    feature above the threshold with the target is dropped as a leak; the
    target never is.  NULL correlations never exceed the threshold.
    """
    spark = spark or pairs.sparkSession
    pos = spark.createDataFrame([(c, k) for k, c in enumerate(cols)], "feature string, pos int")
    tcorr = (pairs.filter(F.col("b") == target).select(F.col("a").alias("feature"), F.col("corr").alias("tc"))
             .unionByName(spark.createDataFrame([(target, 1.0)], "feature string, tc double")))
    p = (pairs.join(F.broadcast(pos.withColumnRenamed("feature", "a").withColumnRenamed("pos", "pa")), "a")
         .join(F.broadcast(pos.withColumnRenamed("feature", "b").withColumnRenamed("pos", "pb")), "b"))
    # orient as (j earlier, i later)
    p = p.select(F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("j"),
                 F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("i"),
                 "corr")
    p = p.filter(F.abs(F.col("corr")) > F.lit(float(threshold)))
    p = (p.join(F.broadcast(tcorr.withColumnRenamed("feature", "j").withColumnRenamed("tc", "tj")), "j", "left")
         .join(F.broadcast(tcorr.withColumnRenamed("feature", "i").withColumnRenamed("tc", "ti")), "i", "left"))
    drop_i = F.coalesce(F.abs(F.col("tj")) > F.abs(F.col("ti")), F.lit(False))
    dropped = p.select(F.when(drop_i, F.col("i")).otherwise(F.col("j")).alias("feature")).distinct()
    flagged = pos.join(dropped.withColumn("_d", F.lit(1)), "feature", "left")
    return flagged.select("feature", F.when(F.col("_d").isNull(), 1).otherwise(0).alias("kept"))


def kept_columns(prune: DataFrame, target: str) -> list[str]:
    """Surviving columns alphabetically, target last (J3).  One row per column."""
    kept = sorted(r["feature"] for r in prune.filter("kept = 1").collect() if r["feature"] != target)
    return kept + [target]


def corr_after_prune(pairs: DataFrame, prune: DataFrame) -> DataFrame:
    """Pairs among kept columns: a filter of the long table, no recompute."""
    k = prune.filter("kept = 1").select("feature")
    return (pairs.join(k.withColumnRenamed("feature", "a"), "a", "left_semi")
            .join(k.withColumnRenamed("feature", "b"), "b", "left_semi"))
