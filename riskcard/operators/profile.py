"""Column profiles: missing rate, value tables, information value, cardinality.

Every feature is handled in the same job: the wide table is unpivoted to
(feature, value, target) and aggregated on (feature, value).  Spark combines
partial aggregates map-side, so a hot value (say NULL in a third of the rows)
costs one row per map task in the shuffle, not a third of the table.  Very wide
tables are unpivoted in batches of columns, one aggregate per batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.functions.exprs import NULL_VALUE, norm_zero, safe_div, woe

BATCH_COLUMNS = 50


def missing_rate(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, missing_rate): percent of NULLs, fraction rounded half-even to 4 places."""
    cols = list(cols or df.columns)
    n = F.count(F.lit(1))
    agg = df.agg(*[(F.bround(F.sum(F.col(c).isNull().cast("long")) / n, 4) * 100).alias(c)
                   for c in cols])
    return agg.unpivot([], cols, "feature", "missing_rate")


def as_text(df: DataFrame, c: str):
    """A feature value as text; doubles normalised so -0.0 and 0.0 agree."""
    t = df.schema[c].dataType
    e = F.col(c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        e = norm_zero(e)
    return e.cast("string")


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _family(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType
    return "long" if isinstance(t, INTEGRAL) else "double" if isinstance(t, FRACTIONAL) else "string"


def _typed_value(df: DataFrame, c: str, null_label: str | None):
    """A cell as struct(l, d, s) with only its own type's field set.

    Every feature unpivots into the same struct type, so one scan covers all
    of them, numbers are grouped as numbers, and text conversion happens after
    aggregation.  Every field is nullable by construction (``when`` without
    ``otherwise``): the unpivot takes its type from the first feature.  With
    ``null_label``, a text cell equal to it groups with NULL cells, as filling
    missing cells with that text does.
    """
    fam = _family(df, c)
    x = F.col(c)
    some = x.isNotNull()
    lv = F.when(some, x.cast("long")) if fam == "long" else F.lit(None).cast("long")
    dv = F.when(some, norm_zero(x.cast("double"))) if fam == "double" else F.lit(None).cast("double")
    if fam == "string":
        keep = some if null_label is None else some & (as_text(df, c) != F.lit(null_label))
        sv = F.when(keep, as_text(df, c))
    else:
        sv = F.lit(None).cast("string")
    return F.struct(lv.alias("l"), dv.alias("d"), sv.alias("s"))


def _value_text(v: str = "v"):
    return F.coalesce(F.col(f"{v}.l").cast("string"), F.col(f"{v}.d").cast("string"), F.col(f"{v}.s"))


def value_counts(df: DataFrame, features: list[str], target: str,
                 batch: int = BATCH_COLUMNS) -> DataFrame:
    """(feature, value, all, good, bad) for every value of every feature.

    NULL is the value 'NULL' (for text columns it merges with the literal
    text 'NULL', as filling missing cells with that text does).
    """
    parts = []
    for i in range(0, len(features), batch):
        fs = features[i:i + batch]
        wide = df.select(F.col(target).alias("_y"), *[_typed_value(df, c, NULL_VALUE).alias(c) for c in fs])
        long = wide.unpivot(["_y"], fs, "feature", "v")
        agg = long.groupBy("feature", "v").agg(
            F.count(F.lit(1)).alias("all"),
            F.count(F.when(F.col("_y") == 0, 1)).alias("good"),
            F.count(F.when(F.col("_y") == 1, 1)).alias("bad"))
        parts.append(agg.select("feature", F.coalesce(_value_text(), F.lit(NULL_VALUE)).alias("value"),
                                "all", "good", "bad"))
    return reduce(DataFrame.unionByName, parts)


def value_table(df: DataFrame, features: list[str], target: str,
                batch: int = BATCH_COLUMNS) -> DataFrame:
    """IV table per value (D2): all, good, bad, share, bad_rate, dist_good, dist_bad, woe, iv.

    Good distribution uses all - bad, as the reference does; pure values (no
    goods or no bads) get WoE 0 and add no IV.
    """
    counts = value_counts(df, features, target, batch)
    # Every row puts exactly one value (maybe 'NULL') into every feature, so each
    # feature's totals are the table's row and bad counts: one scalar subquery
    # over the target column, not a second pass of the unpivot aggregate.
    tot = df.agg(F.struct(F.count(F.lit(1)).alias("n"),
                          F.count(F.when(F.col(target) == 1, 1)).alias("b")).alias("t")).scalar()
    t = counts.withColumn("_n", tot["n"]).withColumn("_b", tot["b"])
    dg = safe_div(F.col("all") - F.col("bad"), F.col("_n") - F.col("_b"))
    db = safe_div("bad", "_b")
    t = t.select("feature", "value", "all", "good", "bad",
                 safe_div("all", "_n").alias("share"),
                 safe_div("bad", "all").alias("bad_rate"),
                 dg.alias("dist_good"), db.alias("dist_bad"))
    t = t.withColumn("woe", woe("dist_good", "dist_bad"))
    return t.withColumn("iv", F.col("woe") * (F.col("dist_good") - F.col("dist_bad")))


def sorted_value_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The value table for people: by feature, then value."""
    return value_table(df, features, target).orderBy("feature", "value")


def iv_by_feature(vt: DataFrame) -> DataFrame:
    """(feature, iv) = sum of the value IVs."""
    return vt.groupBy("feature").agg(F.sum("iv").alias("iv"))


def iv_select(ivs: DataFrame, min_iv: float = 0.01, max_iv: float = 1.0) -> DataFrame:
    """Keep features with min_iv < iv < max_iv; the upper bound is a leak guard."""
    return ivs.filter((F.col("iv") > F.lit(min_iv)) & (F.col("iv") < F.lit(max_iv)))


def cardinality(df: DataFrame, features: list[str], approx: bool = False,
                batch: int = BATCH_COLUMNS) -> DataFrame:
    """(feature, n_distinct), NULLs not counted.

    Exact: unpivot + distinct (feature, value) + count per feature (two
    shuffles, both map-side combined).  ``approx=True`` uses HyperLogLog++ in
    one pass with bounded memory per column.
    """
    if approx:
        agg = df.agg(*[F.approx_count_distinct(c).cast("long").alias(c) for c in features])
        return agg.unpivot([], features, "feature", "n_distinct")
    parts = []
    for i in range(0, len(features), batch):
        fs = features[i:i + batch]
        wide = df.select(*[_typed_value(df, c, None).alias(c) for c in fs])
        long = wide.unpivot([], fs, "feature", "v").filter(_value_text().isNotNull())
        parts.append(long.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct")))
    return reduce(DataFrame.unionByName, parts)
