"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query composes the library operators over the ``applications`` fixture
(derived from orders, customer and lineitem, so the work grows with them) and
returns a lazy DataFrame.  Doubles are rounded to 6 places at the end so the
oracle comparison is not at the mercy of the last floating bit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.operators import binning as B
from riskcard.operators import encode as E
from riskcard.operators import evaluate as V
from riskcard.operators import model as M
from riskcard.operators import points as P
from riskcard.operators import prep
from riskcard.operators import profile as PR
from riskcard.operators.bins import (CategoricalBins, NumericBins, apply_bins, apply_categorical_join, apply_codes,
                                     apply_numeric_range_join, cat_name, presence_flag)
from riskcard.plans.prefix import global_row_number, written
from riskcard.session import scratch_path
from riskcard.sources import fixture as FX
from riskcard.sources import report as RP
from riskcard.sources.tables import DICTIONARY_COLUMNS, line_counts, read_dictionary, read_table, scan, write_csv
from riskcard.streaming.score_stream import stream_binned, stream_scores

ID, TARGET = FX.ID, FX.TARGET

# Parameters of the test queries (fixed values of this catalogue).
CLEAN_FEATURES = ["acct_bal", "avg_disc", "is_f", "n_items", "priority", "qty", "segment", "total_price"]
PREBIN_FEATURES = ["acct_bal", "avg_disc", "n_items", "qty", "total_price"]
CORR_THRESHOLD = 0.5
EXTRA_ASC = ["avg_disc"]
# Features that only get a presence flag, and one of the fixture's.
PRESENCE_LIST = ["ELJCOUNTY1", "ELJCOUNTY2", "MBELJFILINGNAME1", "MBELJFILINGNAME2", "City_App",
                 "State_App", "segment"]
SPLIT_SEED = 42


def scorecard(features=None) -> P.Scorecard:
    offset, factor = V.scaling(450.0, 1.0, 80.0)
    bins = tuple(b for b in FX.SCORECARD_BINS if features is None or b.feature in features)
    return P.Scorecard(bins, FX.SCORECARD_WEIGHTS, FX.SCORECARD_INTERCEPT, offset, factor)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([
        ((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
         if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name))
        for f in df.schema.fields])


# ------------------------------------------------------------------ base views

def app(spark, d):
    return FX.applications(spark, d)


def clean(spark, d):
    return prep.replace_sentinels(app(spark, d))


def cleaned(spark, d):
    return prep.clean_columns(app(spark, d), TARGET, ID)


def binned(spark, d):
    return apply_bins(clean(spark, d), FX.SCORECARD_BINS, keep=[ID, TARGET])


def scored(spark, d, features=None):
    return clean(spark, d).select(ID, TARGET, P.score_expr(scorecard(features)).alias("score"))


def score_grain(spark, d):
    return V.score_grain(scored(spark, d), "score", TARGET)


def ks_score(spark, d):
    return V.ks_table(score_grain(spark, d), "score", ascending=True)


def _data_roles(spark, d):
    c = cleaned(spark, d)
    feats = [x for x in c.columns if x not in (ID, TARGET)]
    return prep.column_roles(c, feats)


# --------------------------------------------------------------------- queries

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
BAD_LINE = 97               # every so many orders are written with a key that is no number


def _orders_csv(spark, d):
    """The orders as CSV, some lines with a key that does not fit the schema."""
    path = scratch_path(spark, "orders") + ".csv"
    o = read_table(spark, d, "orders").select(ORDER_COLUMNS)
    key = F.col("o_orderkey").cast("string")
    write_csv(o.withColumn("o_orderkey", F.when(F.col("o_orderkey") % BAD_LINE == 0, F.concat(F.lit("key "), key))
                           .otherwise(key)), path)
    return scan(spark, path, schema=o.schema, bad_lines="_bad")


def q_scan_csv(spark, d):
    return rounded(_orders_csv(spark, d).select(*ORDER_COLUMNS, F.col("_bad").isNotNull().alias("bad")))


def q_scan_csv_lines(spark, d):
    return line_counts(_orders_csv(spark, d), "_bad")


def q_scan_parquet(spark, d):
    return rounded(scan(spark, f"{d.rstrip('/')}/orders.parquet").select(ORDER_COLUMNS))


def q_report_tables(spark, d):
    sg = score_grain(spark, d)
    offset, factor = V.scaling()
    c = clean(spark, d)
    tables = {
        "scorecard": P.scorecard_points(spark, scorecard(), binned(spark, d)),
        "ppt": V.ppt_table(sg, "score", offset, factor),
        "missing_rate": PR.missing_rate(app(spark, d)),
        "iv": PR.iv_by_feature(PR.value_table(c, CLEAN_FEATURES, TARGET)),
    }
    bt = B.complete_table(_code_counts(spark, d), B.label_table(spark, FX.SCORECARD_BINS))
    root = RP.write_report(spark, tables, bt, project="demo")
    rows = [(n, RP.read_report(spark, root, n).count()) for n in list(tables) + ["bins"]]
    read = spark.createDataFrame(rows, "table_name string, rows long")
    # as many rows as the manifest says, and the same when read
    return read.join(RP.report_manifest(spark, root), ["table_name", "rows"]).select("table_name", "rows")


def q_report_run_name(spark, d):
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey", RP.run_name_col("demo", "o_orderdate").alias("run_name"))


def q_table_shape(spark, d):
    a = app(spark, d)
    n = a.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("first_id", F.lit(None).cast("long"))
    head = a.select(ID).orderBy(ID).limit(5).agg(F.min(ID).alias("first_id")) \
        .withColumn("n_rows", F.lit(None).cast("long"))
    both = n.unionByName(head)
    return both.agg(F.max("n_rows").alias("n_rows"), F.lit(len(a.columns)).alias("n_cols"),
                    F.max("first_id").alias("first_id"))


def q_column_widths(spark, d):
    return RP.column_widths(app(spark, d))


def q_null_sentinels(spark, d):
    return clean(spark, d).select(ID, "segment")


def q_clean_columns(spark, d):
    # columns that each of the name rules drops: p_0 and NAP, states, CL
    more = {"p_0": F.lit(0.5), "NAP": F.col(ID) % 7, "HIRES_RATE_S": F.col("qty"), "GDPx": F.col("qty"),
            "CLtype": F.col("segment")}
    return rounded(prep.clean_columns(app(spark, d).withColumns(more), TARGET, ID))


def _rule_survivors(a):
    return [f.name for f in a.schema.fields if f.name not in (ID, TARGET) and prep.drop_reason(f) is None]


def q_sparse_columns(spark, d):
    a = app(spark, d)
    return rounded(prep.sparse_columns(prep.replace_sentinels(a), _rule_survivors(a), 0.95))


def q_exclude_columns(spark, d):
    return rounded(prep.exclude_columns(app(spark, d), FX.EXCLUDED))


def q_column_roles(spark, d):
    c = clean(spark, d)
    return prep.column_roles(c, [x for x in c.columns if x not in (ID, TARGET)])


def _dictionary(spark):
    """The dictionary fixture through a CSV file, as a user's comes."""
    path = scratch_path(spark, "dictionary") + ".csv"
    write_csv(FX.dictionary(spark).withColumnsRenamed({v: k for k, v in DICTIONARY_COLUMNS.items()}), path)
    return read_dictionary(spark, path)


def q_dict_roles(spark, d):
    roles = prep.dictionary_roles(_dictionary(spark), spark, extra_asc=EXTRA_ASC)
    return prep.roles_in_data(roles, _data_roles(spark, d))


def q_new_predictors(spark, d):
    return prep.new_predictors(_data_roles(spark, d), _dictionary(spark))


def q_join_target(spark, d):
    c = cleaned(spark, d)
    roles = {r["feature"]: r["role"] for r in _data_roles(spark, d).collect()}   # one row per column
    nums = [f for f in c.columns if roles.get(f) == "numeric"]
    left = c.select(ID, *nums)
    right = app(spark, d).select(ID, TARGET)
    return rounded(left.join(right, ID))


def q_missing_rate(spark, d):
    return rounded(PR.missing_rate(app(spark, d)))


def q_iv_value_table(spark, d):
    return _positions(rounded(PR.sorted_value_table(clean(spark, d), CLEAN_FEATURES, TARGET)))


def q_iv_by_feature(spark, d):
    return rounded(PR.iv_by_feature(PR.value_table(clean(spark, d), CLEAN_FEATURES, TARGET)))


def q_iv_select(spark, d):
    return rounded(PR.iv_select(PR.iv_by_feature(PR.value_table(clean(spark, d), CLEAN_FEATURES, TARGET))))


def q_feature_cardinality(spark, d):
    return PR.cardinality(clean(spark, d), CLEAN_FEATURES)


def q_prebin_counts(spark, d):
    return rounded(B.prebin_counts(clean(spark, d), PREBIN_FEATURES, TARGET))


def q_prebin_tree(spark, d):
    return rounded(B.prebin_counts(clean(spark, d), PREBIN_FEATURES, TARGET, method="tree"))


def _fit(spark, d, trend):
    counts = written(B.prebin_counts(clean(spark, d), PREBIN_FEATURES, TARGET), "prebin-counts")
    trends = spark.createDataFrame([(f, trend) for f in PREBIN_FEATURES], "feature string, trend string")
    return rounded(B.fit_bins(counts, trends).select("feature", B.starts_text().alias("starts"), "iv"))


def q_bin_fit_asc(spark, d):
    return _fit(spark, d, "ascending")


def q_bin_fit_desc(spark, d):
    return _fit(spark, d, "descending")


CATEGORY_FEATURES = ["priority", "segment", "brand"]


def q_bin_fit_categorical(spark, d):
    c = clean(spark, d).join(FX.order_brand(spark, d), ID, "left")
    cp = written(B.category_prebins(c, CATEGORY_FEATURES, TARGET), "categories")
    trends = spark.createDataFrame([(f, "ascending") for f in CATEGORY_FEATURES], "feature string, trend string")
    fits = B.fit_bins(B.category_prebin_counts(cp), trends)
    # one row per category, held against the oracle without gathering the members of a bin
    return rounded(cp.join(F.broadcast(fits.select("feature", "starts", "iv")), "feature")
                   .select("feature", "value", "n", "bad", B.segment_of("pb").alias("bin_id"), "pb", "iv"))


def q_bin_fit_missing(spark, d):
    """Whole bin tables of features of which only the missing rows tell something."""
    c = FX.informative_gaps(clean(spark, d))
    _, bins, counts = B.screen_features(spark, c, TARGET, ["gap_cat"], {"gap_num": "descending"}, max_iv=10.0)
    return rounded(B.complete_table(counts.withColumn("feature", F.concat("feature", F.lit("_cat"))),
                                    B.label_table(spark, bins)))


def q_bin_fit_all(spark, d):
    c = written(cleaned(spark, d), "cleaned")
    feats = [x for x in c.columns if x not in (ID, TARGET)]
    roles = prep.dictionary_roles(FX.dictionary(spark), spark, extra_asc=EXTRA_ASC)
    prep.check_directions(roles)
    data_roles = {r["feature"]: r["role"] for r in prep.column_roles(c, feats).collect()}
    trends = {r["feature"]: ("ascending" if r["role"] == "num_asc" else "descending")
              for r in roles.filter(F.col("role").startswith("num")).collect()
              if data_roles.get(r["feature"]) == "numeric"}
    cats = sorted(f for f, r in data_roles.items() if r == "categorical")
    return rounded(B.screen_features(spark, c, TARGET, cats, trends)[0])


def _bt(spark, d):
    return B.bin_table(binned(spark, d), [cat_name(b.feature) for b in FX.SCORECARD_BINS], TARGET)


def q_bin_table(spark, d):
    return rounded(_bt(spark, d))


def q_bin_totals_rollup(spark, d):
    return rounded(B.with_totals(_bt(spark, d)))


def q_bin_members_array(spark, d):
    c = clean(spark, d).filter(F.col("priority").isNotNull())
    b = c.select(F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1).alias("bin_id"),
                 "priority").distinct()
    arr = b.groupBy("bin_id").agg(F.array_sort(F.collect_list("priority")).alias("m"))
    return arr.select("bin_id", F.size("m").alias("size"), F.array_join("m", ",").alias("members"),
                      F.array_contains("m", "1-URGENT").alias("has_urgent"))


NUM_BINS = [b for b in FX.SCORECARD_BINS if isinstance(b, NumericBins)]
CAT_BINS = [b for b in FX.SCORECARD_BINS if isinstance(b, CategoricalBins)]


def q_bin_apply_numeric(spark, d):
    return apply_bins(clean(spark, d), NUM_BINS, keep=[ID])


def q_bin_range_join(spark, d):
    return apply_numeric_range_join(clean(spark, d), NUM_BINS, ID, spark)


def q_bin_apply_categorical(spark, d):
    return apply_categorical_join(clean(spark, d), CAT_BINS, ID, spark)


def q_presence_flag(spark, d):
    return presence_flag(clean(spark, d), FX.PRESENCE_FEATURES, [ID])


def q_presence_features(spark, d):
    cat = _data_roles(spark, d).filter(F.col("role") == "categorical")
    return prep.presence_features(cat, PRESENCE_LIST, spark)


def q_binned_table(spark, d):
    return binned(spark, d)


def one_hot(spark, d):
    return E.one_hot(binned(spark, d), FX.SCORECARD_BINS, TARGET, ID)


def _oh_cols(oh):
    return [c for c in oh.columns if c != ID]


def q_one_hot(spark, d):
    return one_hot(spark, d)


def _pairs(spark, d):
    oh = one_hot(spark, d)
    return E.corr_pairs_binned(binned(spark, d), FX.SCORECARD_BINS, TARGET), _oh_cols(oh)


def q_corr_pairs(spark, d):
    return rounded(_pairs(spark, d)[0])


def q_corr_prune(spark, d):
    pairs, cols = _pairs(spark, d)
    return E.corr_prune(pairs, cols, TARGET, CORR_THRESHOLD, spark)


def q_corr_after_prune(spark, d):
    pairs, cols = _pairs(spark, d)
    return rounded(E.corr_after_prune(pairs, E.corr_prune(pairs, cols, TARGET, CORR_THRESHOLD, spark)))


def q_train_test_split(spark, d):
    s = M.train_test_split(app(spark, d), ID, 0.7, SPLIT_SEED)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).cast("long").alias("bad"))


def q_predict_proba(spark, d):
    return rounded(P.predict_proba(clean(spark, d), scorecard(), [ID]))


def _code_counts(spark, d):
    """(feature, bin_id, n, bad) of the fixed bins; bin_id NULL for missing rows."""
    cats = [cat_name(b.feature) for b in FX.SCORECARD_BINS]
    long = _coded(spark, d).unpivot([TARGET], cats, "feature", "code")
    return (long.groupBy("feature", F.when(F.col("code") >= 0, F.col("code")).alias("bin_id"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("bad")))


def _coded(spark, d):
    return apply_codes(clean(spark, d), FX.SCORECARD_BINS, keep=[ID, TARGET])


def _model_inputs(spark, d):
    """Pruned one-hot design, split and compressed."""
    coded = written(_coded(spark, d), "coded")
    cols = [name for name, _, _ in E.level_codes(FX.SCORECARD_BINS)] + [TARGET]
    pairs = written(E.corr_pairs_codes(coded, FX.SCORECARD_BINS, TARGET), "pairs")
    kept = E.kept_columns(E.corr_prune(pairs, cols, TARGET, 0.67, spark), TARGET)
    feats = [c for c in kept if c != TARGET]
    comp = written(M.compress_codes(M.train_test_split(coded, ID, 0.7, SPLIT_SEED), FX.SCORECARD_BINS, feats, TARGET,
                                    extra=["split"]), "compressed")
    return comp, feats


FLAT_FEATURE = "priority"


def q_fit_logistic(spark, d):
    """Fitted bad rate per level of one feature: with a negligible penalty it is the observed one."""
    bins = [b for b in FX.SCORECARD_BINS if b.feature == FLAT_FEATURE]
    coded = _coded(spark, d).select(ID, TARGET, cat_name(FLAT_FEATURE))
    feats = [name for name, _, code in E.level_codes(bins) if code > 0]      # the first level is the base
    comp = written(M.compress_codes(coded, bins, feats, TARGET), "compressed")
    n = int(comp.agg(F.sum("w")).head()[0] or 0)
    b0, w = M.fit_logistic(comp, feats, TARGET, "l2", 1e9, n, max_iter=500, tol=1e-14)
    z = M.linear_column(feats, b0, w)
    rate = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return (comp.groupBy(*feats).agg(F.sum("w").cast("long").alias("n")).withColumn("rate", rate)
            .select("n", F.round("rate", 4).alias("rate")))


def _grid(spark, d):
    comp, feats = _model_inputs(spark, d)
    return M.grid_search(spark, comp, feats, TARGET)[0]


def q_grid_search(spark, d):
    return _grid(spark, d)


def q_grid_search_flag(spark, d):
    """The whole grid on one 0/1 column, where every fit has an exact answer: fitted bad rates per level,
    KS by split and quality of all 36 models."""
    bins = [b for b in FX.SCORECARD_BINS if b.feature == FLAT_FEATURE]
    coded = _coded(spark, d).select(ID, TARGET, cat_name(FLAT_FEATURE))
    feats = [name for name, _, code in E.level_codes(bins) if code == 0]
    comp = written(M.compress_codes(M.train_test_split(coded, ID, 0.7, SPLIT_SEED), bins, feats, TARGET,
                                    extra=["split"]), "compressed")
    table, models = M.grid_search(spark, comp, feats, TARGET)
    rate = lambda z: 1.0 / (1.0 + math.exp(-z))
    fits = spark.createDataFrame([(k, rate(b0), rate(b0 + w)) for k, (b0, (w,)) in enumerate(models)],
                                 "grid_order int, rate_off double, rate_on double")
    return table.join(fits, "grid_order").select(
        "grid_order", "penalty", "c", F.round("rate_off", 6).alias("rate_off"), F.round("rate_on", 6).alias("rate_on"),
        "ks_train", "ks_validation", F.round("quality", 4).alias("quality"))


def q_grid_best(spark, d):
    """The rule for the winner, over a grid whose qualities are KS values of score halves."""
    g = V.score_grain(scored(spark, d).withColumn("part", F.col(ID) % GRID_PARTS), "score", TARGET, by=["part"])
    ks = V.ks_stat(V.ks_table(g, "score", ascending=True, by=["part"]), by=["part"], digits=2)
    grid = ks.select(F.col("part").cast("int").alias("grid_order"), F.col("ks").alias("quality"))
    return rounded(M.grid_best(grid))


GRID_PARTS = 36


def _ks_by_split(df):
    g = V.score_grain(df, "score", TARGET, by=["split"])
    return V.ks_stat(V.ks_table(g, "score", ascending=True, by=["split"]), by=["split"])


def q_grid_quality(spark, d):
    # both scorings in one projection, unpivoted by name: one pass over the data
    full, reduced = scorecard(), scorecard(list(FX.REDUCED_FEATURES))
    s = clean(spark, d).select(ID, TARGET, P.score_expr(full).alias("full"), P.score_expr(reduced).alias("reduced"))
    s = M.train_test_split(s, ID, 0.7, SPLIT_SEED).unpivot([ID, TARGET, "split"], ["full", "reduced"],
                                                            "name", "score")
    g = V.score_grain(s, "score", TARGET, by=["name", "split"])
    k = V.ks_stat(V.ks_table(g, "score", ascending=True, by=["name", "split"]), by=["name", "split"])
    out = k.groupBy("name").agg(
        F.max(F.when(F.col("split") == "train", F.col("ks"))).alias("ks_train"),
        F.max(F.when(F.col("split") == "test", F.col("ks"))).alias("ks_test"))
    return rounded(out.withColumn("quality", F.col("ks_test") - F.abs(F.col("ks_train") - F.col("ks_test"))))


def q_ks_by_split(spark, d):
    return rounded(_ks_by_split(M.train_test_split(scored(spark, d), ID, 0.7, SPLIT_SEED)))


def q_score_scaling(spark, d):
    return rounded(P.score_scaling(clean(spark, d), scorecard(), [ID]))


def q_scorecard_points(spark, d):
    return P.scorecard_points(spark, scorecard(), binned(spark, d))


def q_score_rows_wide(spark, d):
    return P.score_rows_wide(clean(spark, d), scorecard(), [ID])


def q_score_rows_long(spark, d):
    return P.score_rows_long(binned(spark, d), scorecard(), ID, spark)


def q_scored_rows(spark, d):
    a = app(spark, d)
    return rounded(P.score_rows_wide(a, scorecard(), a.columns))


def q_ranked_rows(spark, d):
    s = scored(spark, d).select(ID, "score")
    return global_row_number(s, ["score", ID], "rn").select(ID, "rn")


def q_ks_table(spark, d):
    g = _logit_grain(spark, d)
    return rounded(V.ks_table(g, "z", ascending=False, keep_key=False, partitions=None))


def _logit_grain(spark, d):
    """One row per distinct prediction: P(bad) rises with the bad log-odds z, which both engines
    add up in the same order."""
    z = clean(spark, d).select(TARGET, P.linear_predictor(scorecard()).alias("z"))
    return V.score_grain(z, "z", TARGET)


def q_model_eval_proba(spark, d):
    return rounded(V.model_metrics(_logit_grain(spark, d), "z", bad_high=True, partitions=None))


def q_ks_table_score(spark, d):
    return rounded(ks_score(spark, d))


def _deciles(spark, d):
    s = scored(spark, d)
    grp = V.equal_groups(s, "score", ID, 10)
    g = V.score_grain(grp, "grp", TARGET)
    return V.ks_table(g, "grp", ascending=True, group="index", keep_key=False)


def q_ks_table_deciles(spark, d):
    return rounded(_deciles(spark, d))


def q_ks_table_origin(spark, d):
    return rounded(V.with_origin(ks_score(spark, d)))


def q_lift_table(spark, d):
    return rounded(V.lift_table(_deciles(spark, d)))


def q_ks_stat(spark, d):
    return rounded(V.ks_stat(ks_score(spark, d)))


def q_ks_cutoff(spark, d):
    return rounded(V.ks_cutoff(ks_score(spark, d)))


def q_ks_curve(spark, d):
    return rounded(V.ks_curve(ks_score(spark, d)))


def q_optimal_cutoff(spark, d):
    return rounded(V.optimal_cutoff(score_grain(spark, d), "score"))


def q_score_percentiles(spark, d):
    return rounded(V.score_percentiles(score_grain(spark, d), "score"))


def q_optimal_cutoff_raw(spark, d):
    """On raw predictions, highest risk first."""
    return rounded(V.optimal_cutoff(_logit_grain(spark, d), "z", ascending=False, partitions=None, digits=4))


def q_percentiles_raw(spark, d):
    return rounded(V.score_percentiles(_logit_grain(spark, d), "z", partitions=None))


def q_score_histogram(spark, d):
    return V.score_histogram(score_grain(spark, d), "score")


def q_roc_curve(spark, d):
    return rounded(V.roc_curve(score_grain(spark, d), "score"))


def q_auc_gini(spark, d):
    return rounded(V.auc(score_grain(spark, d), "score"))


def q_model_metrics(spark, d):
    return rounded(V.model_metrics(score_grain(spark, d), "score"))


def q_backfill_score(spark, d):
    return rounded(V.backfill(V.with_origin(ks_score(spark, d)), "score", "group"))


def _ppt(spark, d, origin):
    """The cutoff table with each row's place in it (highest cutoff first)."""
    offset, factor = V.scaling()
    return _positions(rounded(V.ppt_table(score_grain(spark, d), "score", offset, factor, origin)))


def _positions(df):
    """A row's place in the order that the operator returns, to hold against the oracle."""
    return global_row_number(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "position").drop("_at")


def q_ppt_table(spark, d):
    return _ppt(spark, d, origin=False)


def q_ppt_table_origin(spark, d):
    return _ppt(spark, d, origin=True)


def q_string_scalars(spark, d):
    p = read_table(spark, d, "part")
    mixed = F.when(F.col("p_size") % 3 == 0, F.lit(".")).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", F.lower("p_name").alias("name_lower"),
                    F.endswith(F.lower("p_name"), F.lit("widget")).alias("ends_widget"),
                    F.expr("substring(p_brand, 7)").try_cast("int").alias("brand_no"),
                    mixed.try_cast("int").alias("size_num"))


def q_stream_score(spark, d):
    return stream_scores(spark, d, scorecard())


def q_stream_binned(spark, d):
    return stream_binned(spark, d, FX.SCORECARD_BINS)


QUERIES = {
    "scan_csv": q_scan_csv,
    "scan_csv_lines": q_scan_csv_lines,
    "scan_parquet": q_scan_parquet,
    "report_tables": q_report_tables,
    "report_run_name": q_report_run_name,
    "table_shape": q_table_shape,
    "column_widths": q_column_widths,
    "null_sentinels": q_null_sentinels,
    "clean_columns": q_clean_columns,
    "sparse_columns": q_sparse_columns,
    "exclude_columns": q_exclude_columns,
    "column_roles": q_column_roles,
    "dict_roles": q_dict_roles,
    "new_predictors": q_new_predictors,
    "join_target": q_join_target,
    "missing_rate": q_missing_rate,
    "iv_value_table": q_iv_value_table,
    "iv_by_feature": q_iv_by_feature,
    "iv_select": q_iv_select,
    "feature_cardinality": q_feature_cardinality,
    "prebin_counts": q_prebin_counts,
    "prebin_tree": q_prebin_tree,
    "bin_fit_asc": q_bin_fit_asc,
    "bin_fit_desc": q_bin_fit_desc,
    "bin_fit_categorical": q_bin_fit_categorical,
    "bin_fit_missing": q_bin_fit_missing,
    "bin_fit_all": q_bin_fit_all,
    "bin_table": q_bin_table,
    "bin_totals_rollup": q_bin_totals_rollup,
    "bin_members_array": q_bin_members_array,
    "bin_apply_numeric": q_bin_apply_numeric,
    "bin_range_join": q_bin_range_join,
    "bin_apply_categorical": q_bin_apply_categorical,
    "presence_flag": q_presence_flag,
    "presence_features": q_presence_features,
    "binned_table": q_binned_table,
    "one_hot": q_one_hot,
    "corr_pairs": q_corr_pairs,
    "corr_prune": q_corr_prune,
    "corr_after_prune": q_corr_after_prune,
    "train_test_split": q_train_test_split,
    "predict_proba": q_predict_proba,
    "fit_logistic": q_fit_logistic,
    "grid_search": q_grid_search,
    "grid_search_flag": q_grid_search_flag,
    "grid_best": q_grid_best,
    "grid_quality": q_grid_quality,
    "ks_by_split": q_ks_by_split,
    "score_scaling": q_score_scaling,
    "scorecard_points": q_scorecard_points,
    "score_rows_wide": q_score_rows_wide,
    "score_rows_long": q_score_rows_long,
    "scored_rows": q_scored_rows,
    "ranked_rows": q_ranked_rows,
    "ks_table": q_ks_table,
    "ks_table_score": q_ks_table_score,
    "ks_table_deciles": q_ks_table_deciles,
    "ks_table_origin": q_ks_table_origin,
    "lift_table": q_lift_table,
    "ks_stat": q_ks_stat,
    "ks_cutoff": q_ks_cutoff,
    "ks_curve": q_ks_curve,
    "optimal_cutoff": q_optimal_cutoff,
    "score_percentiles": q_score_percentiles,
    "optimal_cutoff_raw": q_optimal_cutoff_raw,
    "percentiles_raw": q_percentiles_raw,
    "score_histogram": q_score_histogram,
    "roc_curve": q_roc_curve,
    "auc_gini": q_auc_gini,
    "model_metrics": q_model_metrics,
    "model_eval_proba": q_model_eval_proba,
    "backfill_score": q_backfill_score,
    "ppt_table": q_ppt_table,
    "ppt_table_origin": q_ppt_table_origin,
    "string_scalars": q_string_scalars,
    "stream_score": q_stream_score,
    "stream_binned": q_stream_binned,
}
