"""The whole scorecard build, stage by stage, on Spark.

ingest (target check) -> missing rate -> clean -> raw IV -> roles -> bin fit + screening -> bin
numbers -> correlation prune -> split + compress -> 36-fit grid -> winner on the whole table ->
scorecard points -> evaluation (KS, AUC, cutoff table).

Materialisation points, all Parquet under the shared checkpoint folder: the cleaned input (it
feeds five jobs, and a lost executor then recomputes from that file, not from the source joins),
the bin numbers, the compressed design and the small count tables.  Only the assembled training
vectors are cached.  ``session.release_scratch`` deletes the folders when the results are used up.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskcard.operators import binning as B
from riskcard.operators import encode as E
from riskcard.operators import evaluate as V
from riskcard.operators import model as M
from riskcard.operators import points as P
from riskcard.operators import prep
from riskcard.operators import profile as PR
from riskcard.operators.bins import CategoricalBins, apply_codes, cat_name
from riskcard.plans.prefix import written
from riskcard.sources import fixture as FX


@dataclass
class BuildParams:
    target: str = FX.TARGET
    id_col: str = FX.ID
    made_id: str | None = None          # an id column that is not part of the data
    sparse_threshold: float = 0.95
    min_iv: float = 0.01
    max_iv: float = 1.0
    corr_threshold: float = 0.65
    train_fraction: float = 0.7
    split_seed: int = 42
    target_score: float = 450.0
    target_odds: float = 1.0
    pts_double_odds: float = 80.0
    new_asc: list = field(default_factory=list)
    new_desc: list = field(default_factory=list)
    exclude: list = field(default_factory=list)
    # Features that only get a presence flag.
    presence: list = field(default_factory=lambda: ["ELJCOUNTY1", "ELJCOUNTY2", "MBELJFILINGNAME1",
                                                    "MBELJFILINGNAME2", "City_App", "State_App"])
    n_prebins: int = B.MAX_PREBINS
    prebins: str = "shares"             # or "tree": leaves of a classification tree
    grid_penalties: tuple = tuple(M.PENALTIES)
    grid_c: tuple = tuple(M.C_VALUES)
    max_iter: int = 100


def build_from(spark: SparkSession, df: DataFrame, dictionary: DataFrame, params: BuildParams) -> dict:
    p = params
    tgt, idc = p.target, p.id_col
    out: dict = {}
    timings = out.setdefault("timings", {})
    clock = [time.time()]

    def lap(name):
        now = time.time()
        timings[name] = round(now - clock[0], 3)
        clock[0] = now
    df = prep.checked_target(df, tgt)
    out["missing_rate"] = PR.missing_rate(df, [c for c in df.columns if c != p.made_id])

    # clean: name/type rules (no job) and sentinels, written once; the sparse rule
    # then reads the written table, so the source is scanned a single time
    prep._check_threshold(p.sparse_threshold)
    table = written(prep.rule_filtered(df, tgt, idc), "cleaned")
    cleaned = prep.drop_sparse(table, tgt, idc, p.sparse_threshold)
    lap("clean")

    # raw IV of every column, before the user's exclusions
    out["iv"] = PR.iv_by_feature(PR.value_table(cleaned, [c for c in cleaned.columns if c not in (tgt, idc)], tgt))
    cleaned = prep.exclude_columns(cleaned, [c for c in p.exclude if c not in (tgt, idc)])
    feats = [c for c in cleaned.columns if c not in (tgt, idc)]

    # roles from types + one value test; directions from the dictionary
    roles = {r["feature"]: r["role"] for r in prep.column_roles(cleaned, feats).collect()}  # per column
    droles = prep.dictionary_roles(dictionary, spark, p.new_desc, p.new_asc)
    prep.check_directions(droles)
    trends = {r["feature"]: ("ascending" if r["role"] == "num_asc" else "descending")
              for r in droles.filter(F.col("role").startswith("num")).collect()    # dictionary rows
              if roles.get(r["feature"]) == "numeric"}
    categorical = sorted(f for f, r in roles.items() if r == "categorical")
    presence = sorted(set(categorical) & set(p.presence))

    # fit + screen every feature in one set of jobs
    status, bins, counts = B.screen_features(spark, cleaned, tgt, [c for c in categorical if c not in presence],
                                             trends, p.min_iv, p.max_iv, p.n_prebins, p.prebins)
    out["feature_status"] = status
    if not bins:
        raise ValueError("no feature passed the IV screen")
    # presence-only features become a two-level flag: 'not NaN' / 'NaN'
    flags = [CategoricalBins(f, (("not NaN",),), names=("not NaN",)) for f in presence]
    flagged = cleaned.select("*", *[F.when(F.col(f).isNotNull(), F.lit("not NaN")).alias("_flag_" + f) for f in presence])
    flagged = flagged.drop(*presence).withColumnsRenamed({"_flag_" + f: f for f in presence})
    bins = bins + flags
    coded = written(apply_codes(flagged, bins, keep=[idc, tgt]), "coded")
    if flags:
        flag_counts = coded.select(F.col(tgt).alias("_y"), *[F.col(cat_name(b.feature)).alias(b.feature) for b in flags])
        counts = counts.unionByName(
            flag_counts.unpivot(["_y"], [b.feature for b in flags], "feature", "code").groupBy("feature", "code")
            .agg(*B._events()).select("feature", F.when(F.col("code") >= 0, F.col("code")).alias("bin_id"), "n", "bad"))
    labels = B.label_table(spark, bins)
    out["bin_members"] = B.member_table(spark, bins)
    out["bin_table"] = B.complete_table(counts.withColumn("feature", F.concat("feature", F.lit("_cat"))), labels)
    lap("bin_fit")

    # correlations of one-hot levels + prune, on bin numbers
    cols = [name for name, _, _ in E.level_codes(bins)] + [tgt]
    pairs = written(E.corr_pairs_codes(coded, bins, tgt), "pairs")
    prune = written(E.corr_prune(pairs, cols, tgt, p.corr_threshold, spark), "prune")
    out["correlations"] = E.corr_after_prune(pairs, prune)
    kept = E.kept_columns(prune, tgt)
    features = [c for c in kept if c != tgt]
    lap("corr_prune")

    # split + compress; all fits read the compressed frame together
    comp = written(M.compress_codes(M.train_test_split(coded, idc, p.train_fraction, p.split_seed), bins, features,
                                    tgt, extra=["split"]), "compressed")
    timings["compressed_rows"] = comp.count()
    lap("compress")
    grid, models = M.grid_search(spark, comp, features, tgt, list(p.grid_penalties), list(p.grid_c),
                                 max_iter=p.max_iter)
    lap("grid")
    best = M.grid_best(grid).head()
    b0, w = models[best["grid_order"]]
    out["grid"] = grid
    out["coefficients"] = M.coef_frame(spark, features, b0, w).join(E.level_labels(spark, bins), "feature", "left")

    # the winner on the whole table, by raw prediction (K10); z rises with P(bad)
    by_z = written(V.score_grain(comp.withColumn("z", M.linear_column(features, b0, w)), "z", tgt, weight="w"), "by-z")
    out["model_ks"] = V.ks_table(by_z, "z", ascending=False, partitions=None)
    out["model_roc"] = V.roc_curve(by_z, "z", bad_high=True, partitions=None)
    out["model_metrics"] = V.model_metrics(by_z, "z", bad_high=True, partitions=None)

    # coefficients -> scorecard over the original bins (pruned levels weigh 0)
    coef = dict(zip(features, w))
    offset, factor = V.scaling(p.target_score, p.target_odds, p.pts_double_odds)
    weights = {b.feature: ([coef.get(f"{cat_name(b.feature)}__b{i}", 0.0) for i in range(len(b.labels))],
                           coef.get(f"{cat_name(b.feature)}__bnan", 0.0)) for b in bins}
    sc = P.Scorecard(tuple(bins), weights, b0, offset, factor)
    out["scorecard"] = sc
    out["points"] = P.scorecard_lines(spark, sc, counts, coded.agg(F.count(F.lit(1)).alias("n")))

    # evaluation at score grain over the whole table
    scored = P.with_scaling(coded.select(idc, tgt, P.score_codes(sc).alias("score"),
                                         (-P.predictor_codes(sc)).alias("_logit")), F.col("_logit"), sc).drop("_logit")
    grain = written(V.score_grain(scored, "score", tgt), "grain")
    out["grain"] = grain
    out["ks"] = V.ks_table(grain, "score", ascending=True)
    out["ks_point"] = V.ks_cutoff(out["ks"])
    out["ks_curve"] = V.ks_curve(out["ks"])
    out["optimal_cutoff"] = V.optimal_cutoff(grain, "score")
    out["histogram"] = V.score_histogram(grain, "score")
    out["roc"] = V.roc_curve(grain, "score")
    out["metrics"] = V.model_metrics(grain, "score")
    out["ppt"] = V.ppt_table(grain, "score", offset, factor)
    out["scored"] = scored
    return out


def build_scorecard(spark: SparkSession, sf_dir: str, params: BuildParams | None = None) -> dict:
    """The build on the ``applications`` table of a driver data folder."""
    p = params or BuildParams(new_asc=["avg_disc"])
    return build_from(spark, FX.applications(spark, sf_dir), FX.dictionary(spark), p)
