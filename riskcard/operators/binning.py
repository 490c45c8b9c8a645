"""Supervised monotone binning.

Job shape, for all features at once:

1. pre-bins: of the values of a feature in order (numbers by size, categories by event rate),
   pre-bin k takes those whose cumulative share starts in [k/20, (k+1)/20), and pre-bins under 5%
   of the rows are merged with the next.  Numbers are counted by leading bits, refined where a cut
   falls (``share_prebins``); categories get range sums (``plans.prefix``) over value counts
   (feature, value, n, bad), combined map-side.
2. the pre-bins of numbers can also be the leaves of a classification tree (``tree_prebins``).
3. the fit: ``groupBy(feature).applyInPandas`` over at most 20 rows per feature.  Python never
   sees a raw row.
4. bin tables come from the pre-bin counts and the fit; the data are not read again.

The fit maximises total IV over contiguous merges of ordered pre-bins, subject to strictly
monotone event rates between neighbouring bins.  A bin with no events or no non-events has WoE 0
and IV 0.  Ties go to fewer bins, then to smaller segment starts.  Missing values are a bin of
their own: outside the monotone constraint, inside the totals and the IV, so a feature whose
missing values tell something is judged on that as well.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.functions.exprs import safe_div, woe
from riskcard.operators.bins import CategoryTable, NumericBins, cat_name
from riskcard.operators.profile import as_text
from riskcard.plans.prefix import running_sums, written
from riskcard.session import ship_code

MAX_PREBINS = 20
MIN_PREBIN_SHARE = 0.05
IV_DIGITS = 10
FIRST_BITS, NEXT_BITS = 16, 12   # bits of a number's order-preserving form, counted in turn
LABEL_MEMBERS = 10          # categories named in a bin's label

COUNTS = "feature string, pb int, n long, bad long, hi double"


def _events(y: str = "_y"):
    return F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("bad")


def numbers(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(_y, features...) as doubles; NaN is NULL, -0.0 is 0.0."""
    number = lambda c: F.col(c).cast("double")
    return df.select(F.col(target).alias("_y"), *[
        F.when(~F.isnan(number(c)), number(c) + F.lit(0.0)).alias(c) for c in features])


def numeric_counts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, n, bad) per distinct number; NULL and NaN are one missing row (x NULL)."""
    return (numbers(df, features, target).unpivot(["_y"], features, "feature", "x")
            .groupBy("feature", "x").agg(*_events()))


def category_counts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, value, n, bad, rate) per category; NULL is the missing row."""
    wide = df.select(F.col(target).alias("_y"), *[as_text(df, c).alias(c) for c in features])
    return (wide.unpivot(["_y"], features, "feature", "value").groupBy("feature", "value").agg(*_events())
            .withColumn("rate", F.col("bad") / F.col("n")))


def merge_small(n: list[int], min_share: float = MIN_PREBIN_SHARE) -> list[int]:
    """Number of each pre-bin after merging forward until every one holds ``min_share`` of the rows
    (what is left at the end joins the last)."""
    total, out, at, held = sum(n), [], 0, 0
    for x in n:
        out.append(at)
        held += x
        if held >= min_share * total:
            at, held = at + 1, 0
    return [min(k, at - 1) for k in out] if held and at else out


def ordered_prebins(values: DataFrame, order: list[str], max_prebins: int = MAX_PREBINS,
                    min_share: float = MIN_PREBIN_SHARE) -> DataFrame:
    """Add ``pb`` to (feature, ..., n) rows without missing values (a written table), in the order of ``order``."""
    ship_code(values.sparkSession)
    totals = values.groupBy("feature").agg(F.sum("n").alias("_total"))          # one row per feature
    run = running_sums(values, order, {"_cum": "n"}, groups=["feature"]).join(totals, "feature")
    run = written(run.withColumn("_raw", F.expr(f"(_cum - n) * {max_prebins} div _total").cast("int"))
                  .drop("_cum", "_total"), "prebins")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:                                # at most max_prebins rows
        pdf = pdf.sort_values("_raw")
        return pdf[["feature", "_raw"]].assign(pb=merge_small(pdf["n"].tolist(), min_share))

    raw = run.groupBy("feature", "_raw").agg(F.sum("n").alias("n"))
    merged = raw.groupBy("feature").applyInPandas(merge, "feature string, _raw int, pb int")
    # at most max_prebins rows per feature
    return run.join(merged, ["feature", "_raw"]).drop("_raw")


_BELOW = np.int64(2**63 - 1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & _BELOW)


def _double(key: np.ndarray) -> np.ndarray:
    return (key ^ ((key >> 63) & _BELOW)).view(np.float64)


def ordered_numbers(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(_y, features...): ``numbers`` as whole numbers of the same order, NULL where missing."""
    ship_code(df.sparkSession)
    wide = numbers(df, features, target)

    def run(batches):
        for b in batches:
            cols = [pa.array(_ordered(c.fill_null(0.0).to_numpy(zero_copy_only=False)), mask=np.asarray(c.is_null()))
                    for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], b.schema.names)

    return wide.mapInArrow(run, T.StructType([wide.schema["_y"], *[T.StructField(c, T.LongType()) for c in features]]))


def share_prebins(wide: DataFrame, features: list[str], max_prebins: int = MAX_PREBINS,
                  min_share: float = MIN_PREBIN_SHARE) -> DataFrame:
    """(feature, pb, n, bad, hi) of a written ``ordered_numbers`` table: exact cuts by cumulative
    shares, without a shuffle row per distinct value.

    Numbers are counted by the leading bits in which a feature's values differ.  A cell of which all
    values must start in one pre-bin, or that holds one value, is settled; the others (at most one per
    cut) are counted again by their next bits.  So the first pass exchanges about 2^16 cells a feature
    and task, the later ones max_prebins * 2^12, however many values there are."""
    spark = wide.sparkSession
    ends = wide.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(features)
                      for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = [(c, max(0, (ends[f"lo{i}"] ^ ends[f"hi{i}"]).bit_length() - FIRST_BITS)
              if (ends[f"lo{i}"] or 0) >= 0 or (ends[f"hi{i}"] or 0) < 0 else 64 - FIRST_BITS)
             for i, c in enumerate(features) if ends[f"lo{i}"] is not None]
    # one row per feature: the bits that the first pass leaves
    left = spark.createDataFrame(spans, "feature string, _bits int")
    long = wide.unpivot(["_y"], features, "feature", "_key").where("_key is not null").join(F.broadcast(left), "feature")
    rows = long.select("*", F.lit(0).cast("long").alias("_in"), F.lit(0).cast("long").alias("_from"),
                       F.lit(None).cast("long").alias("_total"))
    settled, done = None, 0
    cell = Window.partitionBy("feature", "_in")             # at most 2^16 cells
    before = cell.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        prefix = F.expr(f"shiftright(_key, greatest(_bits - {done}, 0))")
        cells = (rows.groupBy("feature", "_in", "_from", "_total", prefix.alias("_cell"))
                 .agg(*_events(), F.min("_key").alias("lo"), F.max("_key").alias("hi")))
        cells = (cells.withColumn("_total", F.coalesce("_total", F.sum("n").over(cell)))
                 .withColumn("_from", F.col("_from") + F.coalesce(F.sum("n").over(before), F.lit(0)))
                 .withColumn("_raw", F.expr(f"_from * {max_prebins} div _total").cast("int"))
                 .withColumn("_open", F.expr(f"lo < hi AND (_from + n - 1) * {max_prebins} div _total > _raw")))
        cells = written(cells, "radix-cells")
        part = cells.where("not _open").select("feature", "_raw", "n", "bad", "hi")
        settled = part if settled is None else settled.unionByName(part)
        opened = cells.where("_open").select(F.col("feature").alias("_f"), F.col("_cell").alias("_in"), "_from", "_total")
        if opened.isEmpty():                                # a cell without bits left holds one value
            break
        # at most one cell per cut: max_prebins - 1 per feature
        rows = long.join(F.broadcast(opened), (F.col("feature") == F.col("_f")) & (prefix == F.col("_in")))
        done += NEXT_BITS

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:                                # at most max_prebins rows
        pdf = pdf.sort_values("_raw")
        pdf["pb"] = merge_small(pdf["n"].tolist(), min_share)
        out = pdf.groupby(["feature", "pb"], as_index=False).agg({"n": "sum", "bad": "sum", "hi": "max"})
        return out.assign(hi=_double(out["hi"].to_numpy(np.int64)))

    raw = settled.groupBy("feature", "_raw").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("hi").alias("hi"))
    return raw.groupBy("feature").applyInPandas(merge, COUNTS)


def tree_prebins(values: DataFrame, max_prebins: int = MAX_PREBINS, min_share: float = MIN_PREBIN_SHARE) -> DataFrame:
    """(feature, pb, n, bad, hi) of (feature, x, n, bad) rows without missing values: the leaves of a
    classification tree per feature.

    A leaf is cut where the Gini impurity falls most (the smallest such value), while it has both
    outcomes and both sides keep ``min_share`` of the feature's rows.  Running sums are made once; a
    cut of a leaf is then judged from them and the leaf's ends alone, so each level of the trees is one
    aggregate over the values, for all leaves of all features.  If more than ``max_prebins`` leaves
    are possible, the cuts of largest gain are taken first."""
    spark = values.sparkSession
    run = written(running_sums(values, ["x"], {"cn": "n", "cb": "bad"}, groups=["feature"])
                  .select("feature", "x", "cn", "cb"), "value-sums")
    ends = run.groupBy("feature").agg(F.max("cn").alias("n"), F.max("cb").alias("b"), F.max("x").alias("hi")).collect()
    least = {r.feature: math.ceil(min_share * r.n) for r in ends}                   # one row per feature
    # a leaf: feature, first and last running sums, largest value
    fresh = [(r.feature, 0, 0, r.n, r.b, r.hi) for r in ends]
    cuts: dict[tuple, tuple] = {}
    while fresh := [v for v in fresh if 0 < v[4] - v[2] < v[3] - v[1] and v[3] - v[1] >= 2 * least[v[0]]]:
        leaves = spark.createDataFrame([(*v[:5], max(1, least[v[0]])) for v in fresh],
                                       "f string, sn long, sb long, en long, eb long, least long")
        impure = lambda n, b: (b * b + (n - b) * (n - b)) / n
        d = lambda a, b: (F.col(a) - F.col(b)).cast("double")
        gain = impure(d("cn", "sn"), d("cb", "sb")) + impure(d("en", "cn"), d("eb", "cb"))
        # at most max_prebins leaves per feature: every value meets one of them
        inside = ((F.col("feature") == F.col("f")) & (F.col("cn") - F.col("sn") >= F.col("least"))
                  & (F.col("en") - F.col("cn") >= F.col("least")))
        best = (run.join(F.broadcast(leaves), inside).groupBy("f", "sn", "en")
                .agg(F.max(F.struct(gain.alias("gain"), (-F.col("cn")).alias("cn"), "cb", "x")).alias("cut")).collect())
        fresh_by, fresh = {(v[0], v[1], v[3]): v for v in fresh}, []
        for r in best:                                                              # one row per leaf
            f, sn, sb, en, eb, hi = v = fresh_by[r.f, r.sn, r.en]
            left, right = (f, sn, sb, -r.cut.cn, r.cut.cb, r.cut.x), (f, -r.cut.cn, r.cut.cb, en, eb, hi)
            whole = ((eb - sb) ** 2 + (en - sn - eb + sb) ** 2) / (en - sn)
            cuts[v] = r.cut.gain - whole, left, right
            fresh += [left, right]
    rows = []
    for r in ends:
        leaves = [(r.feature, 0, 0, r.n, r.b, r.hi)]
        while len(leaves) < max_prebins and (can := [v for v in leaves if v in cuts]):
            v = max(can, key=lambda v: (cuts[v][0], -v[1]))
            leaves.remove(v)
            leaves += cuts[v][1:]
        rows += [(f, k, en - sn, eb - sb, hi) for k, (f, sn, sb, en, eb, hi) in enumerate(sorted(leaves, key=lambda v: v[1]))]
    return spark.createDataFrame(rows, "feature string, pb int, n long, bad long, hi double")


def prebin_counts(df: DataFrame, features: list[str], target: str, max_prebins: int = MAX_PREBINS,
                  min_share: float = MIN_PREBIN_SHARE, method: str = "shares") -> DataFrame:
    """(feature, pb, n, bad, hi) of numeric features; ``hi`` is the pre-bin's largest value, pb NULL
    the missing row (I2).  ``method``: "shares" cuts by cumulative shares of the rows, "tree" by a
    classification tree."""
    if method not in ("shares", "tree"):
        raise ValueError(f"unknown pre-bin method {method!r}")
    if method == "tree":
        values = written(numeric_counts(df, features, target), "value-counts")
        present, gone = tree_prebins(values.where("x is not null"), max_prebins, min_share), values.where("x is null")
    else:
        wide = written(ordered_numbers(df, features, target), "numbers")
        present = share_prebins(wide, features, max_prebins, min_share)
        gone = wide.unpivot(["_y"], features, "feature", "x").where("x is null").groupBy("feature").agg(*_events())
    missing = gone.select("feature", F.lit(None).cast("int").alias("pb"), "n", "bad", F.lit(None).cast("double").alias("hi"))
    return present.unionByName(missing)


def category_prebins(df: DataFrame, features: list[str], target: str, max_prebins: int = MAX_PREBINS,
                     min_share: float = MIN_PREBIN_SHARE) -> DataFrame:
    """(feature, value, n, bad, rate, pb) per category, ordered by (event rate, value); value and pb
    NULL for the missing row (I5)."""
    values = written(category_counts(df, features, target), "category-counts")
    pb = ordered_prebins(values.where("value is not null"), ["rate", "value"], max_prebins, min_share)
    return pb.unionByName(values.where("value is null").withColumn("pb", F.lit(None).cast("int")))


def category_prebin_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("feature", "pb").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


# ---------------------------------------------------------------- the fit (DP)

def _segment_iv(n, e, G, B):
    g = n - e
    if g <= 0 or e <= 0 or G <= 0 or B <= 0:
        return 0.0
    dg, db = g / G, e / B
    return (dg - db) * math.log(dg / db)


def fit_monotone(n: list[int], e: list[int], trend: str, missing: tuple[int, int] = (0, 0)) -> tuple[list[int], float]:
    """Best segmentation of ordered pre-bins: (segment start positions, total IV).

    ``missing``: rows and events of the missing bin.  It counts in the totals and in the IV, and
    stands outside the monotone constraint.

    ``best[(i, j)]`` = best key of a segmentation of pre-bins 0..j whose last
    bin is i..j; a bin i..j may follow k..i-1 only if the event rate moves in
    the trend's direction strictly.  Keys compare (IV, -bins, starts) so ties
    go to fewer bins, then smaller starts.  O(p^3) for p <= 20 pre-bins.
    """
    p = len(n)
    if p == 0:
        return [], 0.0
    G, B = sum(n) - sum(e) + missing[0] - missing[1], sum(e) + missing[1]
    own = _segment_iv(*missing, G, B)
    cn = np.concatenate([[0], np.cumsum(n)])
    ce = np.concatenate([[0], np.cumsum(e)])

    def seg(i, j):
        nn, ee = int(cn[j + 1] - cn[i]), int(ce[j + 1] - ce[i])
        return nn, ee

    def ok(prev, cur):
        (n1, e1), (n2, e2) = prev, cur
        # compare e1/n1 with e2/n2 exactly, in integers
        if trend == "ascending":
            return e1 * n2 < e2 * n1
        return e1 * n2 > e2 * n1

    def key(state):
        iv, starts = state
        return (round(iv, IV_DIGITS), -len(starts), tuple(-s for s in starts))

    best: dict[tuple[int, int], tuple[float, tuple]] = {}
    for j in range(p):
        for i in range(j + 1):
            cur = seg(i, j)
            ivc = _segment_iv(cur[0], cur[1], G, B)
            if i == 0:
                best[(i, j)] = (ivc, (0,))
                continue
            cand = None
            for k in range(i):
                prev_state = best.get((k, i - 1))
                if prev_state is None or not ok(seg(k, i - 1), cur):
                    continue
                st = (prev_state[0] + ivc, prev_state[1] + (i,))
                if cand is None or key(st) > key(cand):
                    cand = st
            if cand is not None:
                best[(i, j)] = cand
    finals = [best[(i, p - 1)] for i in range(p) if (i, p - 1) in best]
    top = max(finals, key=key)
    return list(top[1]), float(top[0]) + own


FIT_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("trend", T.StringType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("n_bins", T.IntegerType()),
    T.StructField("iv", T.DoubleType()),
])


def fit_bins(counts: DataFrame, trends: DataFrame) -> DataFrame:
    """Run the fit per (feature, trend) over pre-bin counts.

    ``counts``: (feature, pb, n, bad), pb NULL for the missing row; ``trends``: (feature, trend)
    with trend 'ascending' or 'descending', one row per feature.  The grouped map gets at most
    ``MAX_PREBINS`` + 1 rows per group.  The IV is that of the whole table: missing rows included.
    """
    ship_code(counts.sparkSession)
    j = counts.select("feature", "pb", "n", "bad").join(F.broadcast(trends), "feature")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = pdf[pdf["pb"].isna()]
        pdf = pdf[pdf["pb"].notna()].sort_values("pb")
        if not len(pdf):
            return pd.DataFrame(columns=["feature", "trend", "starts", "n_bins", "iv"])
        starts, iv = fit_monotone(pdf["n"].astype(int).tolist(), pdf["bad"].astype(int).tolist(),
                                  pdf["trend"].iloc[0], (int(gone["n"].sum()), int(gone["bad"].sum())))
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "trend": [pdf["trend"].iloc[0]],
                             "starts": [starts], "n_bins": [len(starts)], "iv": [iv]})

    return j.groupBy("feature", "trend").applyInPandas(fit, FIT_SCHEMA)


def starts_text(col="starts"):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), ",")


def segment_of(pos_col: str, starts_col: str = "starts"):
    """Index of the fitted bin holding pre-bin ``pos``; NULL for the missing row."""
    return F.when(F.col(pos_col).isNotNull(),
                  F.size(F.filter(F.col(starts_col), lambda s: s <= F.col(pos_col))) - 1)


def fitted_counts(counts: DataFrame, fits: DataFrame) -> DataFrame:
    """(feature, trend, bin_id, pb_lo, pb_hi, n, bad[, hi]) of the fitted bins; bin_id NULL is the
    missing row."""
    j = counts.join(F.broadcast(fits.select("feature", "trend", "starts")), "feature")
    top = [F.max("hi").alias("hi")] if "hi" in counts.columns else []
    return (j.withColumn("bin_id", segment_of("pb")).groupBy("feature", "trend", "bin_id")
            .agg(F.min("pb").alias("pb_lo"), F.max("pb").alias("pb_hi"), F.sum("n").alias("n"),
                 F.sum("bad").alias("bad"), *top))


def bin_table(binned: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per (feature, label): n, n_pct, non_event, event, event_rate, woe, iv.

    ``binned`` holds ``<feature>`` label columns (missing already 'NaN').
    Totals include the missing bin, as a binning table does.
    """
    long = binned.select(F.col(target).alias("_y"), *features).unpivot(["_y"], features, "feature", "label")
    agg = long.groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("long").alias("non_event"),
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("long").alias("event"))
    return bin_stats(agg)


def bin_stats(agg: DataFrame) -> DataFrame:
    """WoE / IV columns over (feature, label, n, non_event, event) rows.

    Feature totals come from a window over the aggregated bins: a feature has
    at most ~21 bins, so the window is small and the counts are not re-read.
    """
    w = Window.partitionBy("feature")
    t = agg.select("*", F.sum("n").over(w).alias("_n"), F.sum("non_event").over(w).alias("_ne"),
                   F.sum("event").over(w).alias("_e"))
    dne, de = safe_div("non_event", "_ne"), safe_div("event", "_e")
    t = t.select("feature", "label", "n", safe_div("n", "_n").alias("n_pct"), "non_event", "event",
                 safe_div("event", "n").alias("event_rate"), dne.alias("_dne"), de.alias("_de"))
    t = t.withColumn("woe", woe("_dne", "_de"))
    return t.withColumn("iv", F.col("woe") * (F.col("_dne") - F.col("_de"))).drop("_dne", "_de")


def with_totals(bt: DataFrame) -> DataFrame:
    """Append one 'Totals' row per feature with ``rollup``."""
    r = bt.rollup("feature", "label").agg(
        F.sum("n").alias("n"), F.sum("non_event").alias("non_event"), F.sum("event").alias("event"),
        F.max("woe").alias("woe"), F.sum("iv").alias("iv"), F.grouping("label").alias("_gl"))
    r = r.filter(F.col("feature").isNotNull())
    tot_n = F.sum(F.when(F.col("_gl") == 0, F.col("n"))).over(Window.partitionBy("feature"))
    return r.select(
        "feature", F.when(F.col("_gl") == 1, F.lit("Totals")).otherwise(F.col("label")).alias("label"),
        "n", safe_div("n", tot_n).alias("n_pct"), "non_event", "event",
        safe_div("event", "n").alias("event_rate"),
        F.when(F.col("_gl") == 0, F.col("woe")).alias("woe"), "iv")


def complete_table(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole bin table of fitted features: every bin, Special, Missing and Totals.

    ``counts``: (feature, bin_id, n, bad) with bin_id NULL for missing rows; ``labels``: (feature,
    bin_id, label) of every bin.  There are no special codes, so that row is empty; the missing row
    is there also where nothing is missing.  ``position`` orders a feature's rows.
    """
    feats = labels.select("feature").distinct()
    rows = (labels.join(counts.where("bin_id is not null").select("feature", "bin_id", "n", "bad"),
                        ["feature", "bin_id"], "left")
            .unionByName(feats.select("feature", F.lit(1000).alias("bin_id"), F.lit("Special").alias("label"),
                                      F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")))
            .unionByName(feats.join(counts.where("bin_id is null").select("feature", "n", "bad"), "feature", "left")
                         .select("feature", F.lit(1001).alias("bin_id"), F.lit("Missing").alias("label"), "n", "bad")))
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    agg = rows.select("feature", F.col("bin_id").alias("position"), "label", n.alias("n"),
                      (n - bad).alias("non_event"), bad.alias("event"))
    bt = bin_stats(agg.select("feature", F.struct("position", "label").alias("label"), "n", "non_event", "event"))
    tot = bt.groupBy("feature").agg(F.struct(F.lit(1002).alias("position"), F.lit("Totals").alias("label")).alias("label"),
                                    F.sum("n").alias("n"), F.lit(1.0).alias("n_pct"), F.sum("non_event").alias("non_event"),
                                    F.sum("event").alias("event"), safe_div(F.sum("event"), F.sum("n")).alias("event_rate"),
                                    F.lit(None).cast("double").alias("woe"), F.sum("iv").alias("iv"))
    return bt.unionByName(tot).select("feature", "label.position", "label.label", "n", "n_pct", "non_event", "event",
                                      "event_rate", "woe", "iv").orderBy("feature", "position")


# ------------------------------------------------------------ screening

def _fit_selected(spark, counts, trends, min_iv, max_iv):
    """Fit all features; (status rows, fits of the selected ones)."""
    fits = fit_bins(counts, spark.createDataFrame(list(trends.items()), "feature string, trend string")).collect()
    by = {r["feature"]: r for r in fits}                                  # one row per feature
    status, chosen = [], []
    for f in trends:
        r = by.get(f)
        if r is None:
            status.append((f, "failed: no values", 0, None))
            continue
        ok = min_iv < r["iv"] < max_iv
        status.append((f, "selected" if ok else "rejected: iv outside band", int(r["n_bins"]), float(r["iv"])))
        if ok:
            chosen.append(tuple(r))
    return status, spark.createDataFrame(chosen, FIT_SCHEMA)


def screen_features(spark: SparkSession, df: DataFrame, target: str, categorical: list[str],
                    numeric_trends: dict[str, str], min_iv: float = 0.01, max_iv: float = 1.0,
                    n_prebins: int = MAX_PREBINS, prebins: str = "shares"):
    """Fit every categorical and every direction-known numeric feature in one go.

    A feature is selected if the IV of its whole table (missing rows included) lies in the band.
    Returns (status DataFrame, bins of the selected features, their counts per bin).  Status rows
    say why a feature was rejected instead of dropping it silently.  The members of categorical
    bins stay a table; only the few categories named in labels come to the driver.
    """
    status, bins, tables = [], [], []
    cats = [c for c in categorical if c in df.columns]
    if cats:
        cp = written(category_prebins(df, cats, target, n_prebins), "categories")
        counts = category_prebin_counts(cp)
        got, fits = _fit_selected(spark, counts, {c: "ascending" for c in cats}, min_iv, max_iv)
        status += got
        members = written(cp.join(F.broadcast(fits.select("feature", "starts")), "feature")
                          .withColumn("bin_id", segment_of("pb")).where("bin_id is not null")
                          .select("feature", "value", "bin_id", "rate", "n"), "category-bins")
        tables.append(fitted_counts(counts, fits).drop("pb_lo", "pb_hi", "trend"))
        bins += category_bins(members)
    nums = {f: t for f, t in numeric_trends.items() if f in df.columns}
    if nums:
        counts = written(prebin_counts(df, list(nums), target, n_prebins, method=prebins), "prebin-counts")
        got, fits = _fit_selected(spark, counts, nums, min_iv, max_iv)
        status += got
        fitted = fitted_counts(counts, fits)
        tables.append(fitted.drop("pb_lo", "pb_hi", "trend", "hi"))
        rows = fitted.where("bin_id is not null").orderBy("feature", "bin_id").collect()   # <= 20 per feature
        tops: dict = {}
        for r in rows:
            tops.setdefault(r["feature"], []).append(r["hi"])
        bins += [NumericBins(f, tuple(his[:-1])) for f, his in tops.items()]
    counts = None
    for t in tables:
        counts = t if counts is None else counts.unionByName(t)
    return (spark.createDataFrame(status, "feature string, status string, n_bins int, iv double"),
            sorted(bins, key=lambda b: (isinstance(b, NumericBins), b.feature)),
            None if counts is None else written(counts, "bin-counts"))


def category_bins(members: DataFrame) -> list[CategoryTable]:
    """Bins of the features in a (feature, value, bin_id, rate, n) table; a label names the first
    LABEL_MEMBERS categories of its bin in event-rate order."""
    first = Window.partitionBy("feature", "bin_id").orderBy("rate", "value")
    named = (members.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= LABEL_MEMBERS)
             .join(members.groupBy("feature", "bin_id").agg(F.count(F.lit(1)).alias("size")), ["feature", "bin_id"])
             .orderBy("feature", "bin_id", "_at").collect())       # <= LABEL_MEMBERS per bin
    bins: dict = {}
    for r in named:
        bins.setdefault(r["feature"], {}).setdefault(r["bin_id"], (r["size"], []))[1].append(r["value"])
    return [CategoryTable(f, tuple(label_of(names, size) for _, (size, names) in sorted(by.items())),
                          members.where(F.col("feature") == f).select("value", "bin_id"))
            for f, by in bins.items()]


def label_of(names: list[str], size: int) -> str:
    more = f" and {size - len(names)} more" if size > len(names) else ""
    return "[" + " ".join(f"'{m}'" for m in names) + more + "]"


def member_table(spark: SparkSession, bins: list) -> DataFrame:
    """(feature, value, bin_id) of every category of every ``CategoryTable``, features under their
    binned names: labels name at most LABEL_MEMBERS.  Other values, and none, are the missing bin."""
    out = spark.createDataFrame([], "feature string, value string, bin_id int")
    for b in bins:
        if isinstance(b, CategoryTable):
            out = out.unionByName(b.members.select(F.lit(cat_name(b.feature)).alias("feature"), "value", "bin_id"))
    return out


def label_table(spark: SparkSession, bins: list) -> DataFrame:
    """(feature, bin_id, label) of every bin, features under their binned names."""
    return spark.createDataFrame([(cat_name(b.feature), i, lab) for b in bins for i, lab in enumerate(b.labels)],
                                 "feature string, bin_id int, label string")
