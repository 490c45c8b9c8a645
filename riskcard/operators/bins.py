"""Bin definitions (small driver-side metadata) and how rows are mapped to them.

A fitted binning is tiny: at most ~20 bins per feature.  It lives on the driver
as frozen objects and becomes either a projection (``when`` chain, fused into
the scan's codegen stage) or a broadcast lookup table.  Rows never leave the
executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.functions.exprs import MISSING_LABEL, interval_label, members_label
from riskcard.operators.intervals import interval_join
from riskcard.operators.profile import as_text

INF = float("inf")


@dataclass(frozen=True)
class NumericBins:
    """Right-closed intervals over ``[-inf, splits..., inf]``."""
    feature: str
    splits: tuple

    @property
    def edges(self):
        return [-INF] + [float(s) for s in self.splits] + [INF]

    @property
    def labels(self) -> list[str]:
        e = self.edges
        return [interval_label(e[i], e[i + 1]) for i in range(len(e) - 1)]

    def rows(self):
        """(feature, bin_id, lo, hi, label) per bin."""
        e = self.edges
        return [(self.feature, i, e[i], e[i + 1], lab) for i, lab in enumerate(self.labels)]

    def label_expr(self, x: Column | None = None) -> Column:
        x = F.col(self.feature) if x is None else x
        e, labels = self.splits, self.labels
        expr = F.when(x.isNull(), F.lit(MISSING_LABEL))
        for s, lab in zip(e, labels):
            expr = expr.when(x <= F.lit(float(s)), F.lit(lab))
        return expr.otherwise(F.lit(labels[-1]))


@dataclass(frozen=True)
class CategoricalBins:
    """Groups of category values; anything else (unseen, missing) -> 'NaN'.

    ``names`` optionally overrides the labels (a presence flag is the single
    group ('not NaN',) labelled 'not NaN')."""
    feature: str
    groups: tuple  # tuple of tuples of member strings
    names: tuple | None = None

    @property
    def labels(self) -> list[str]:
        return list(self.names) if self.names else [members_label(g) for g in self.groups]

    def member_rows(self):
        """(feature, value, bin_id, label) per member."""
        labels = self.labels
        return [(self.feature, m, i, labels[i]) for i, g in enumerate(self.groups) for m in g]

    def label_expr(self, x: Column | None = None) -> Column:
        x = F.col(self.feature) if x is None else x
        expr = None
        for g, lab in zip(self.groups, self.labels):
            cond = x.isin(list(g))
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        return expr.otherwise(F.lit(MISSING_LABEL))


@dataclass(frozen=True)
class CategoryTable:
    """Fitted groups of category values, kept as a (value, bin_id) table, however many there are;
    anything else (unseen, missing) is the missing bin."""
    feature: str
    labels: tuple          # display labels, one per bin
    members: DataFrame


MISSING_CODE = -1


def cat_name(feature: str) -> str:
    return feature + "_cat"


def apply_bins(df: DataFrame, bins: list, keep: list[str] | None = None) -> DataFrame:
    """Replace each binned feature by ``<feature>_cat`` labels.

    A pure projection: Catalyst fuses it into the scan stage, no shuffle.
    """
    keep = list(keep or [])
    exprs = [F.col(c) for c in keep]
    exprs += [b.label_expr().alias(cat_name(b.feature)) for b in bins]
    return df.select(*exprs)


def code_expr(b) -> Column:
    """Bin number of a row's raw value (MISSING_CODE for the missing bin), by projection."""
    x = F.col(b.feature)
    if isinstance(b, NumericBins):
        e = F.when(x.isNull(), F.lit(MISSING_CODE))
        for i, split in enumerate(b.splits):
            e = e.when(x <= F.lit(float(split)), F.lit(i))
        return e.otherwise(F.lit(len(b.splits)))
    e = F.when(x.isNull(), F.lit(MISSING_CODE))
    for i, g in enumerate(b.groups):
        e = e.when(x.isin(list(g)), F.lit(i))
    return e.otherwise(F.lit(MISSING_CODE))


def apply_codes(df: DataFrame, bins: list, keep: list[str] | None = None) -> DataFrame:
    """Replace each binned feature by an integer ``<feature>_cat`` bin number.

    Numeric and presence bins are a projection.  The members of a ``CategoryTable`` are joined on
    the value: Spark broadcasts them while they are under its size limit, else both sides shuffle
    and adaptive execution splits a hot category.
    """
    out = df
    for b in bins:
        if isinstance(b, CategoryTable):
            t = b.members.select(F.col("value").alias("_value"), F.col("bin_id").alias("_code_" + b.feature))
            out = out.join(t, as_text(df, b.feature) == F.col("_value"), "left").drop("_value")
    codes = [F.coalesce("_code_" + b.feature, F.lit(MISSING_CODE)) if isinstance(b, CategoryTable) else code_expr(b)
             for b in bins]
    return out.select(*[F.col(c) for c in keep or []], *[c.alias(cat_name(b.feature)) for b, c in zip(bins, codes)])


def label_codes(binned: DataFrame, bins: list, keep: list[str]) -> DataFrame:
    """Labels of a ``binned`` table as bin numbers."""
    def code(b):
        e = F.lit(MISSING_CODE)
        for i, lab in reversed(list(enumerate(b.labels))):
            e = F.when(F.col(cat_name(b.feature)) == F.lit(lab), F.lit(i)).otherwise(e)
        return e.alias(cat_name(b.feature))
    return binned.select(*keep, *[code(b) for b in bins])


def numeric_bin_table(spark: SparkSession, bins: list[NumericBins]) -> DataFrame:
    schema = T.StructType([
        T.StructField("feature", T.StringType(), False),
        T.StructField("bin_id", T.IntegerType(), False),
        T.StructField("lo", T.DoubleType(), False),
        T.StructField("hi", T.DoubleType(), False),
        T.StructField("label", T.StringType(), False),
    ])
    return spark.createDataFrame([r for b in bins for r in b.rows()], schema)


def categorical_member_table(spark: SparkSession, bins: list[CategoricalBins]) -> DataFrame:
    schema = T.StructType([
        T.StructField("feature", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("bin_id", T.IntegerType(), False),
        T.StructField("label", T.StringType(), False),
    ])
    return spark.createDataFrame([r for b in bins for r in b.member_rows()], schema)


def apply_numeric_range_join(df: DataFrame, bins: list[NumericBins], id_col: str,
                             spark: SparkSession) -> DataFrame:
    """Value -> interval lookup by one interval join for all features (C6), labels back to one row each.

    The bins of a feature do not overlap, so a row has one line per feature after the join; rows that
    agree in id and all values have the same labels and are counted.
    """
    names = [b.feature for b in bins]
    rows = df.select(F.col(id_col).alias("_id"), F.struct(*names).alias("_row"))
    found = interval_join(rows.select("_id", "_row", *[F.col("_row")[c].alias(f"_b{i}") for i, c in enumerate(names)]),
                          [f"_b{i}" for i in range(len(names))],
                          numeric_bin_table(spark, [NumericBins(f"_b{i}", b.splits) for i, b in enumerate(bins)]),
                          ["_id", "_row"])
    wide = found.groupBy("_id", "_row").agg(
        (F.count(F.lit(1)) / len(bins)).cast("int").alias("_times"),
        *[F.max(F.when(F.col("feature") == f"_b{i}", F.col("bin_id"))).alias(f"_l{i}") for i in range(len(bins))])
    label = lambda i, b: F.coalesce(F.get(F.array(*[F.lit(x) for x in b.labels]), F.col(f"_l{i}")),
                                    F.lit(MISSING_LABEL)).alias(cat_name(b.feature))
    return (wide.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
            .select(F.col("_id").alias(id_col), *[label(i, b) for i, b in enumerate(bins)]))


def apply_categorical_join(df: DataFrame, bins: list[CategoricalBins], id_col: str,
                           spark: SparkSession) -> DataFrame:
    """Category -> bin lookup as a left equi-join on the value (C5), labels attached last."""
    table = categorical_member_table(spark, bins)
    tables = [CategoryTable(b.feature, tuple(b.labels),
                            table.filter(F.col("feature") == b.feature).select("value", "bin_id")) for b in bins]
    coded = apply_codes(df, tables, keep=[id_col])
    label = lambda b: F.coalesce(F.get(F.array(*[F.lit(x) for x in b.labels]), F.col(cat_name(b.feature))),
                                 F.lit(MISSING_LABEL))
    return coded.select(id_col, *[label(b).alias(cat_name(b.feature)) for b in bins])


def presence_flag(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """'NaN' / 'not NaN' instead of bins, for high-cardinality features."""
    return df.select(*keep, *[
        F.when(F.col(f).isNull(), F.lit(MISSING_LABEL)).otherwise(F.lit("not NaN")).alias(cat_name(f))
        for f in features
    ])
