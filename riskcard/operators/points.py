"""Scorecard points and row scores.

A scorecard is driver-side metadata: per feature its bins and one coefficient
per bin (bad log-odds), plus the intercept.  Scoring a row is a projection of
``when`` chains on the raw values, fused into the scan stage; no join, no
shuffle, and the same code runs on a streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskcard.functions.exprs import MISSING_LABEL
from riskcard.operators.bins import CategoricalBins, NumericBins, cat_name

INTERCEPT = "Intercept"


def bround0(x: float) -> float:
    """Half-even rounding to an integer, as numpy does."""
    return float(round(x))


@dataclass(frozen=True)
class Scorecard:
    bins: tuple                # NumericBins / CategoricalBins, in feature order
    weights: dict              # feature -> (per-bin weights, weight of the 'NaN' bin or None)
    intercept: float           # bad log-odds intercept
    offset: float
    factor: float

    def points(self) -> dict:
        """feature -> (per-bin points, 'NaN' points); points = round(-factor * w)."""
        out = {}
        for b in self.bins:
            ws, wn = self.weights[b.feature]
            out[b.feature] = ([bround0(-self.factor * w) for w in ws],
                              None if wn is None else bround0(-self.factor * wn))
        return out

    def intercept_points(self) -> float:
        return bround0(self.offset - self.factor * self.intercept)

    def points_rows(self):
        """(feature, label, points) rows incl. the intercept; feature = one-hot name."""
        rows = [(INTERCEPT, None, int(self.intercept_points()))]
        pts = self.points()
        for b in self.bins:
            ps, pn = pts[b.feature]
            for lab, p in zip(b.labels, ps):
                rows.append((cat_name(b.feature), lab, int(p)))
            if pn is not None:
                rows.append((cat_name(b.feature), MISSING_LABEL, int(pn)))
        return rows


def _map_expr(b, values: list, nan_value, x: Column | None = None) -> Column:
    """Per-row value of a bin-indexed list: chains over the raw feature."""
    x = F.col(b.feature) if x is None else x
    nanv = F.lit(nan_value) if nan_value is not None else F.lit(0.0)
    if isinstance(b, NumericBins):
        e = F.when(x.isNull(), nanv)
        for s, v in zip(b.splits, values):
            e = e.when(x <= F.lit(float(s)), F.lit(v))
        return e.otherwise(F.lit(values[-1]))
    e = None
    for g, v in zip(b.groups, values):
        e = F.when(x.isin(list(g)), F.lit(v)) if e is None else e.when(x.isin(list(g)), F.lit(v))
    return e.otherwise(nanv)


def linear_predictor(sc: Scorecard, features: list[str] | None = None) -> Column:
    """z = b0 + sum of bin weights (bad log-odds), summed in feature order."""
    z = F.lit(float(sc.intercept))
    for b in sc.bins:
        if features is not None and b.feature not in features:
            continue
        ws, wn = sc.weights[b.feature]
        z = z + _map_expr(b, [float(w) for w in ws], None if wn is None else float(wn))
    return z


def score_expr(sc: Scorecard, features: list[str] | None = None) -> Column:
    """Integer score = intercept points + sum of bin points (L4)."""
    pts = sc.points()
    s = F.lit(int(sc.intercept_points())).cast("long")
    for b in sc.bins:
        if features is not None and b.feature not in features:
            continue
        ps, pn = pts[b.feature]
        s = s + _map_expr(b, [int(p) for p in ps], None if pn is None else int(pn)).cast("long")
    return s


def codes_expr(sc: Scorecard, values: dict, start: Column) -> Column:
    """start + the per-bin values (feature -> (per bin, missing)) of a row of bin numbers."""
    out = start
    for b in sc.bins:
        ws, wn = values[b.feature]
        by_code = F.array(F.lit(wn if wn is not None else type(ws[0])(0)), *[F.lit(w) for w in ws])
        out = out + F.get(by_code, F.col(cat_name(b.feature)) + 1)        # the missing bin is number -1
    return out


def score_codes(sc: Scorecard) -> Column:
    """Integer score of a row of bin numbers (``bins.apply_codes``)."""
    pts = {f: ([int(p) for p in ps], None if pn is None else int(pn)) for f, (ps, pn) in sc.points().items()}
    return codes_expr(sc, pts, F.lit(int(sc.intercept_points())).cast("long")).cast("long")


def predictor_codes(sc: Scorecard) -> Column:
    """Bad log-odds of a row of bin numbers."""
    ws = {f: ([float(w) for w in x], None if n is None else float(n)) for f, (x, n) in sc.weights.items()}
    return codes_expr(sc, ws, F.lit(float(sc.intercept)))


def with_scaling(df: DataFrame, logit: Column, sc: Scorecard) -> DataFrame:
    """Add logit (good log-odds), odds, P(good) and the unrounded score (L1, L2)."""
    return (df.withColumn("logit", logit).withColumn("odds", F.exp("logit"))
            .withColumn("probs", F.col("odds") / (F.lit(1.0) + F.col("odds")))
            .withColumn("raw_score", F.lit(float(sc.offset)) + F.lit(float(sc.factor)) * F.col("logit")))


def scorecard_lines(spark: SparkSession, sc: Scorecard, counts: DataFrame, total: DataFrame) -> DataFrame:
    """(feature, label, score, n) from counts per bin (feature, bin_id, n; bin_id NULL: missing) and
    the one-row table of all rows (L12)."""
    pts, rows = sc.points(), []
    for b in sc.bins:
        ps, pn = pts[b.feature]
        rows += [(b.feature, i, lab, int(p)) for i, (lab, p) in enumerate(zip(b.labels, ps))]
        if pn is not None:
            rows.append((b.feature, None, MISSING_LABEL, int(pn)))
    lines = spark.createDataFrame(rows, "f string, b int, label string, score long")
    out = (lines.join(counts, F.col("f").eqNullSafe(F.col("feature")) & F.col("b").eqNullSafe(F.col("bin_id")), "left")
           .select(F.concat("f", F.lit("_cat")).alias("feature"), "label", "score", F.coalesce("n", F.lit(0)).alias("n")))
    inter = total.select(F.lit(INTERCEPT).alias("feature"), F.lit(None).cast("string").alias("label"),
                         F.lit(int(sc.intercept_points())).cast("long").alias("score"), "n")
    return out.unionByName(inter).orderBy("feature", "label")


def score_rows_wide(df: DataFrame, sc: Scorecard, keep: list[str], out: str = "score") -> DataFrame:
    """Row scores by projection (the default: no shuffle)."""
    return df.select(*keep, score_expr(sc).alias(out))


def points_table(spark: SparkSession, sc: Scorecard) -> DataFrame:
    return spark.createDataFrame(sc.points_rows(), "feature string, label string, points long")


def score_rows_long(binned: DataFrame, sc: Scorecard, id_col: str, spark: SparkSession) -> DataFrame:
    """Row scores from labels: each label looks its points up, the row adds them.

    The relational form of the dot product without its shuffle: the points (one row per bin,
    bounded by the binning) become one map per feature inside the projection.
    """
    score = F.lit(int(sc.intercept_points())).cast("long")
    for b in sc.bins:
        ps, pn = sc.points()[b.feature]
        lines = [*zip(b.labels, ps), (MISSING_LABEL, pn or 0)]
        by_label = F.create_map(*[F.lit(x) for lab, p in lines for x in (lab, int(p))])
        score = score + F.coalesce(by_label[F.col(cat_name(b.feature))], F.lit(0))
    return binned.select(id_col, score.cast("long").alias("score"))


def score_scaling(df: DataFrame, sc: Scorecard, keep: list[str]) -> DataFrame:
    """logit (good log-odds), odds, P(good), unrounded score (L1, L2)."""
    logit = -linear_predictor(sc)
    return (df.select(*keep, logit.alias("logit"))
            .withColumn("odds", F.exp("logit"))
            .withColumn("probs", F.col("odds") / (F.lit(1.0) + F.col("odds")))
            .withColumn("score", F.lit(float(sc.offset)) + F.lit(float(sc.factor)) * F.col("logit")))


def predict_proba(df: DataFrame, sc: Scorecard, keep: list[str], features: list[str] | None = None,
                  out: str = "p1") -> DataFrame:
    """P(bad) = 1 / (1 + exp(-z)) (K5)."""
    z = linear_predictor(sc, features)
    return df.select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias(out))


def scorecard_points(spark: SparkSession, sc: Scorecard, binned: DataFrame) -> DataFrame:
    """(feature, label, score, n): the points table with how many rows get each line.

    The counts come from one aggregate over the binned table; the intercept
    line counts every row.
    """
    cats = [cat_name(b.feature) for b in sc.bins]
    counts = (binned.select(*cats).unpivot([], cats, "feature", "label")
              .groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n")))
    total = binned.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(INTERCEPT).alias("feature"), F.lit(None).cast("string").alias("label"), "n")
    pts = points_table(spark, sc)
    # the points table has one row per bin: bounded, so it is broadcast
    lines = counts.join(F.broadcast(pts.filter(F.col("feature") != INTERCEPT)),
                        ["feature", "label"], "right")
    out = lines.select("feature", "label", F.col("points").alias("score"),
                       F.coalesce("n", F.lit(0)).alias("n"))
    inter = total.select("feature", "label", F.lit(int(sc.intercept_points())).cast("long").alias("score"), "n")
    return out.unionByName(inter).orderBy("feature", "label")
