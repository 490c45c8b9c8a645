"""Model evaluation at score grain: KS / lift tables, ROC, AUC, cutoff tables.

Everything starts from ``score_grain``: one row per distinct score (or
prediction) with its row, good and bad counts.  That aggregate is combined
map-side and is small for integer scorecard points (a few hundred to a few
thousand rows at any data size), so the running sums over it may use an
ordinary window (``partitions=1``).  A fractional key is refused there: its grain
can approach the row count, so ``partitions=None`` sends it through the range
sums of ``plans.prefix``.

Ties: the reference numbers rows after a sort, so tied scores split between
groups by chance.  Here a KS point sits between distinct scores, which is
invariant to row order and partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.functions.exprs import odds, safe_div
from riskcard.plans.prefix import carried, global_row_number, running_sums, written

# Column names of the KS table.
KS_COLUMNS = ["group", "good", "bad", "good_distri", "bad_distri", "badrate", "cumbadrate",
              "lift", "cumgood", "cumbad", "ks"]


def score_grain(df: DataFrame, key: str, label: str, weight: str | None = None,
                by: list[str] | None = None) -> DataFrame:
    """(by..., key, n, good, bad): counts per distinct key."""
    w = F.col(weight) if weight else F.lit(1)
    by = list(by or [])
    return df.groupBy(*by, key).agg(
        F.sum(w).cast("long").alias("n"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).cast("long").alias("good"),
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long").alias("bad"))


def _check_small(grain: DataFrame, key: str) -> None:
    """Single-window tables are for integer scores, whose grain does not grow with the rows."""
    kind = grain.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{key} is {kind.simpleString()}: only an integer key has a bounded grain here")


def _cumulate(grain: DataFrame, key: str, ascending: bool, by: list[str], partitions: int | None) -> DataFrame:
    if partitions == 1:
        _check_small(grain, key)
    sums = {"cum_n": "n", "cum_good": "good", "cum_bad": "bad", "idx": "1"}
    return running_sums(grain, [key], sums, ascending, partitions, groups=by)


def _totals(df: DataFrame, by: list[str], partitions: int | None) -> DataFrame:
    """Attach the totals N, G, B and the number of grain rows K."""
    if partitions == 1:
        w = Window.partitionBy(*by)
        return df.select("*", F.sum("n").over(w).alias("_N"), F.sum("good").over(w).alias("_G"),
                         F.sum("bad").over(w).alias("_B"), F.count(F.lit(1)).over(w).alias("_K"))
    sums = [F.sum("n").alias("_N"), F.sum("good").alias("_G"), F.sum("bad").alias("_B"),
            F.count(F.lit(1)).alias("_K")]
    if by:
        return df.join(df.groupBy(*by).agg(*sums), by)
    t = df.agg(F.struct(*sums).alias("t")).scalar()
    return df.select("*", *[t[c].alias(c) for c in ("_N", "_G", "_B", "_K")])


def ks_table(grain: DataFrame, key: str, ascending: bool = True, by: list[str] | None = None,
             group: str = "population", partitions: int | None = 1, keep_key: bool = True) -> DataFrame:
    """KS / lift table over the ordered grain.

    ``group`` is the population fraction reached at the end of each grain row
    (``population``) or the grain-row index over the number of grain rows
    (``index``, as for equal-size groups).  ``partitions``: 1 is a plain window,
    for integer scores; None takes the range sums, for raw probabilities.
    """
    by = list(by or [])
    if partitions != 1:
        grain = written(grain, "grain")           # read for the ranges and for the totals
    c = _totals(_cumulate(grain, key, ascending, by, partitions), by, partitions)
    grp = safe_div("cum_n", "_N") if group == "population" else safe_div("idx", "_K")
    cumbadrate = safe_div("cum_bad", "cum_n")
    out = c.select(
        *by, *([key] if keep_key else []),
        grp.alias("group"), "good", "bad",
        safe_div("good", "_G").alias("good_distri"),
        safe_div("bad", "_B").alias("bad_distri"),
        safe_div("bad", "n").alias("badrate"),
        cumbadrate.alias("cumbadrate"),
        F.try_divide(cumbadrate, safe_div("_B", "_N")).alias("lift"),
        safe_div("cum_good", "_G").alias("cumgood"),
        safe_div("cum_bad", "_B").alias("cumbad"))
    return out.withColumn("ks", F.abs(F.col("cumbad") - F.col("cumgood")))


def with_origin(kst: DataFrame) -> DataFrame:
    """Prepend the zero row: group 0, counts 0, cumbadrate and lift NULL (G1)."""
    spark = kst.sparkSession
    zero = {"group": 0.0, "good": 0, "bad": 0, "good_distri": 0.0, "bad_distri": 0.0,
            "badrate": 0.0, "cumbadrate": None, "lift": None, "cumgood": 0.0, "cumbad": 0.0, "ks": 0.0}
    row = spark.createDataFrame([tuple(zero[c] for c in KS_COLUMNS)], _ks_schema())
    for c in kst.columns:
        if c not in KS_COLUMNS:
            row = row.withColumn(c, F.lit(None).cast(kst.schema[c].dataType))
    return row.select(*kst.columns).unionByName(kst)


def _ks_schema() -> str:
    return ("`group` double, good long, bad long, good_distri double, bad_distri double, "
            "badrate double, cumbadrate double, lift double, cumgood double, cumbad double, ks double")


def backfill(df: DataFrame, col: str, order: str | list[str], partitions: int | None = None) -> DataFrame:
    """Fill NULLs from the next row in ``order`` (E6), in a table of any size and for any type: the values are
    carried down the descending order, across ranges.  Rows after the last value keep NULL."""
    return carried(df, col, [order] if isinstance(order, str) else order, ascending=False, partitions=partitions)


def ks_stat(kst: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Max KS, rounded half-even."""
    by = list(by or [])
    return kst.groupBy(*by).agg(F.bround(F.max("ks"), digits).alias("ks"))


def ks_cutoff(kst: DataFrame) -> DataFrame:
    """First row at maximum KS (smallest group on ties)."""
    return kst.orderBy(F.desc("ks"), F.asc("group")).limit(1)


def ks_curve(kst: DataFrame) -> DataFrame:
    """Series of the KS plot."""
    return kst.select("group", "ks", "cumgood", "cumbad")


def lift_table(kst: DataFrame) -> DataFrame:
    return kst.select("group", "badrate", "cumbadrate", "lift")


def equal_groups(df: DataFrame, key: str, id_col: str, groupnum: int, ascending: bool = True,
                 partitions: int | None = None) -> DataFrame:
    """Group number ceil(rn * g / n) over the total order (key, id).

    Integer arithmetic, so a row at an exact multiple is never pushed up; this
    is not ``ntile`` (which gives the larger groups first).
    """
    df = written(df, "groups")                    # counted and ranked
    total = df.count()
    ranked = global_row_number(df, [key, id_col], "rn", ascending, partitions)
    g = int(groupnum)
    return ranked.withColumn("grp", F.expr(f"(rn * {g} + {total - 1}) div {max(total, 1)}"))


def roc_curve(grain: DataFrame, key: str, bad_high: bool = False, partitions: int | None = 1) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct threshold.

    ``bad_high=False``: low keys are bad (a scorecard), thresholds are ``-key``.
    """
    c = _totals(_cumulate(grain, key, not bad_high, [], partitions), [], partitions)
    thr = F.col(key) if bad_high else -F.col(key)
    return c.select(thr.cast("double").alias("threshold"),
                    safe_div("cum_good", "_G").alias("fpr"),
                    safe_div("cum_bad", "_B").alias("tpr"))


def auc(grain: DataFrame, key: str, bad_high: bool = False, by: list[str] | None = None,
        partitions: int | None = 1) -> DataFrame:
    """ROC AUC by rank sums over the grain, ties counted half."""
    by = list(by or [])
    c = _totals(_cumulate(grain, key, not bad_high, by, partitions), by, partitions)
    # goods strictly "safer" than this key = goods after it in the bad-first order
    above = F.col("_G") - F.col("cum_good")
    term = F.col("bad").cast("double") * above + F.lit(0.5) * F.col("bad") * F.col("good")
    a = c.groupBy(*by).agg(F.try_divide(F.sum(term), F.first("_G").cast("double") * F.first("_B")).alias("auc"))
    return a.withColumn("gini", F.lit(100.0) * (F.lit(2.0) * F.col("auc") - F.lit(1.0)))


def model_metrics(grain: DataFrame, key: str, bad_high: bool = False, partitions: int | None = 1) -> DataFrame:
    """KS x100 and AUC rounded to 2 places, Gini (D16).  On raw probabilities: ``bad_high=True,
    partitions=None`` (K10)."""
    if partitions != 1:
        grain = written(grain, "grain")
    kst = ks_table(grain, key, ascending=not bad_high, partitions=partitions)
    ks = kst.agg(F.max("ks").alias("_ks"))
    a = auc(grain, key, bad_high, partitions=partitions)
    both = ks.unionByName(a.select(F.lit(None).cast("double").alias("_ks"), "auc", "gini"),
                          allowMissingColumns=True)
    return both.agg(F.bround(F.lit(100.0) * F.max("_ks"), 2).alias("ks100"),
                    F.bround(F.max("auc"), 2).alias("auc2"),
                    F.bround(F.max("gini"), 2).alias("gini"))


def _at_ranks(ranked: DataFrame, key: str, places: dict) -> DataFrame:
    """One row with ``<name>``: the key at a fractional rank, interpolated between its neighbours.

    ``ranked`` holds each distinct key with its count n and running count cum_n; ``places`` maps a name
    to a rank from 0.  A rank is looked up, not sorted for: one aggregate that keeps two keys per name."""
    first = F.col("cum_n") - F.col("n")
    at = lambda r: F.max(F.when((first <= r) & (r < F.col("cum_n")), F.col(key).cast("double")))
    ends = ranked.agg(*[e for name, r in places.items() for e in (
        at(F.floor(r)).alias("_lo_" + name), at(F.ceil(r)).alias("_hi_" + name),
        F.any_value(r - F.floor(r)).alias("_f_" + name))])
    return ends.select(*[(F.col("_lo_" + n) + (F.col("_hi_" + n) - F.col("_lo_" + n)) * F.col("_f_" + n)).alias(n)
                         for n in places])


def score_percentiles(grain: DataFrame, key: str, qs=(0.1, 0.25, 0.5, 0.75, 0.9),
                      partitions: int | None = 1) -> DataFrame:
    """Linear-interpolated percentiles from the grain, weighted by counts.

    ``partitions`` 1: ``percentile`` with a frequency column, one entry per distinct (integer) key in one
    task.  None: running counts by range and a look-up of the ranks, for raw predictions.
    """
    names = [f"p{int(round(q * 100))}" for q in qs]
    if partitions == 1:
        p = F.percentile(F.col(key), F.array(*[F.lit(float(q)) for q in qs]), F.col("n"))
        return grain.agg(p.alias("_p")).select(*[F.col("_p")[i].alias(nm) for i, nm in enumerate(names)])
    grain = written(grain.where(F.col(key).isNotNull()), "grain")
    total = grain.agg(F.sum("n")).scalar()
    ranked = running_sums(grain, [key], {"cum_n": "n"}, True, partitions)
    return _at_ranks(ranked, key, {nm: F.lit(float(q)) * (total - 1) for nm, q in zip(names, qs)})


def score_histogram(grain: DataFrame, key: str, bins: int = 80) -> DataFrame:
    """Equal-width histogram by class over [min, max]."""
    ends = grain.agg(F.struct(F.min(key).alias("lo"), F.max(key).alias("hi")).alias("e")).scalar()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo).cast("double") / F.lit(float(bins))
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(key) - lo, width)), F.lit(0)), F.lit(bins - 1))
    return (grain.select(b.cast("int").alias("bin"), "good", "bad")
            .groupBy("bin").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad")))


def optimal_cutoff(grain: DataFrame, key: str, ascending: bool = True, partitions: int | None = 1,
                   digits: int = 0) -> DataFrame:
    """Population fraction at max KS, then that percentile of the key, rounded.

    ``partitions`` None takes range sums, for raw predictions: the fraction is counted in the given
    order, and so is the percentile.

    One pass over the grain: running sums give KS and the population fraction
    per key, a window over the (small) grain picks the first maximum, and the
    percentile is found by rank interpolation over the cumulative counts, so
    the fraction never has to pass through the driver.
    """
    ks = F.abs(safe_div("cum_bad", "_B") - safe_div("cum_good", "_G"))
    grp = safe_div("cum_n", "_N")
    if partitions != 1:
        grain = written(grain, "grain")
        c = written(_totals(_cumulate(grain, key, ascending, [], partitions), [], partitions), "cumulated")
        best = c.agg(F.min_by(grp, F.struct(-ks, grp))).scalar()
        at = _at_ranks(c, key, {"cutoff": best * (c.agg(F.max("_N")).scalar() - 1)})
        return at.select(best.alias("group"), F.bround("cutoff", digits).alias("cutoff"))
    c = _totals(_cumulate(grain, key, ascending, [], 1), [], 1)
    w = Window.partitionBy()
    c = c.withColumn("_ks", ks).withColumn("_grp", grp)
    c = c.withColumn("_best", F.min_by(F.col("_grp"), F.struct(-F.col("_ks"), F.col("_grp"))).over(w))
    # ranks counted in ascending key order for the percentile
    wa = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_cn_up", F.sum("n").over(wa))
    pos = F.col("_best") * (F.col("_N") - 1)
    lo_r, hi_r = F.floor(pos), F.ceil(pos)
    first = F.col("_cn_up") - F.col("n")
    inside = lambda r: (first <= r) & (r < F.col("_cn_up"))
    agg = c.agg(F.first("_best").alias("group"),
                F.max(F.when(inside(lo_r), F.col(key))).alias("_lo"),
                F.max(F.when(inside(hi_r), F.col(key))).alias("_hi"),
                F.first(pos - F.floor(pos)).alias("_f"))
    return agg.select("group", F.bround(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"), digits)
                      .cast("double").alias("cutoff"))


def ppt_table(grain: DataFrame, key: str, offset: float, factor: float, origin: bool = False) -> DataFrame:
    """Performance projection per cutoff score, highest first.

    With N(.), G(.) = rows and goods meeting the predicate and o = 1 when the
    zero origin row of the KS table is counted (it takes the minimum score and
    is not good):  approval = N(>s)/(n+o);  accepted good rate =
    G(>=s)/(N(>=s)+o[s=min]);  rejected good rate = G(<=s)/(N(<=s)+o), NULL->0.
    Prefix and suffix sums over the grain replace one full scan per cutoff.
    """
    _check_small(grain, key)
    o = 1 if origin else 0
    w_up = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy()
    c = grain.select(key, "n", "good",
                     F.sum("n").over(w_up).alias("n_le"), F.sum("good").over(w_up).alias("g_le"),
                     F.sum("n").over(w_all).alias("_N"), F.sum("good").over(w_all).alias("_G"),
                     F.min(key).over(w_all).alias("_min"))
    n_gt = F.col("_N") - F.col("n_le")
    n_ge = n_gt + F.col("n")
    g_ge = F.col("_G") - F.col("g_le") + F.col("good")
    is_min = (F.col(key) == F.col("_min")).cast("long")
    mo = F.exp((F.col(key).cast("double") - F.lit(float(offset))) / F.lit(float(factor)))
    out = c.select(
        F.col(key).cast("long").alias("cutoff_score"),
        safe_div(n_gt, F.col("_N") + o).alias("approval_rate"),
        mo.alias("marginal_odds_ratio"),
        (mo / (F.lit(1.0) + mo)).alias("marginal_good_rate"),
        safe_div(g_ge, n_ge + is_min * o).alias("good_rate_accepted"),
        F.coalesce(safe_div("g_le", F.col("n_le") + o), F.lit(0.0)).alias("good_rate_rejected"))
    return out.select("cutoff_score", "approval_rate", "marginal_odds_ratio", "marginal_good_rate",
                      "good_rate_accepted", odds("good_rate_accepted").alias("odds_accepted"),
                      "good_rate_rejected", odds("good_rate_rejected").alias("odds_rejected")
                      ).orderBy(F.desc("cutoff_score"))


def scaling(target_score: float = 450.0, target_odds: float = 1.0, pts_double_odds: float = 80.0):
    """factor = PDO / ln 2; offset = target_score - factor * ln(target_odds) (L2)."""
    factor = pts_double_odds / math.log(2.0)
    offset = target_score - factor * math.log(target_odds)
    return offset, factor
