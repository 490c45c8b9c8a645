"""Command line: build a scorecard from a table and write the report folder.

    python -m riskcard --input apps.parquet --target bad_flag --id app_id \
        --dictionary dictionary.csv --new-asc x1,x2 --project demo --out /shared/reports

The input and the dictionary may be Parquet, CSV, JSON or ORC (picked by
extension).  Dictionary columns are ``Variable Name (ReNamed)``, ``Type`` and
``Sign`` (or already ``variable``, ``type``, ``sign``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from riskcard.plans.build import BuildParams, build_from
from riskcard.plans.prefix import written
from riskcard.session import get_session, release_scratch
from riskcard.sources import report as RP
from riskcard.sources.tables import read_dictionary, scan


def _list(s: str | None) -> list[str]:
    return [x.strip() for x in s.split(",") if x.strip()] if s else []


def main(argv=None) -> str:
    ap = argparse.ArgumentParser(prog="riskcard", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--input", required=True)
    ap.add_argument("--target", required=True)
    ap.add_argument("--id", dest="id_col", default=None,
                    help="row id column; without one, an id is derived from the input order")
    ap.add_argument("--dictionary", default=None)
    ap.add_argument("--new-asc", default="")
    ap.add_argument("--new-desc", default="")
    ap.add_argument("--exclude", default="")
    ap.add_argument("--sparse-threshold", type=float, default=0.95)
    ap.add_argument("--min-iv", type=float, default=0.01)
    ap.add_argument("--prebins", choices=["shares", "tree"], default="shares")
    ap.add_argument("--corr-threshold", type=float, default=0.65)
    ap.add_argument("--train-fraction", type=float, default=0.7)
    ap.add_argument("--target-score", type=float, default=450.0)
    ap.add_argument("--target-odds", type=float, default=1.0)
    ap.add_argument("--pdo", type=float, default=80.0)
    ap.add_argument("--project", default="scorecard")
    ap.add_argument("--out", default=None, help="report folder (default: under spark.checkpoint.dir)")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    spark = get_session(a.master) if a.master else get_session()
    df = scan(spark, a.input)
    id_col = a.id_col
    if id_col is None:
        id_col = "_row_id"
        # written with its rows: an id of a recomputed scan could change
        df = written(df.withColumn(id_col, F.monotonically_increasing_id()), "numbered")
    if a.dictionary:
        d = read_dictionary(spark, a.dictionary)
    else:
        d = spark.createDataFrame([], "variable string, type string, sign string")
    p = BuildParams(target=a.target, id_col=id_col, sparse_threshold=a.sparse_threshold, min_iv=a.min_iv,
                    corr_threshold=a.corr_threshold, train_fraction=a.train_fraction,
                    target_score=a.target_score, target_odds=a.target_odds, pts_double_odds=a.pdo,
                    new_asc=_list(a.new_asc), new_desc=_list(a.new_desc), exclude=_list(a.exclude),
                    prebins=a.prebins, made_id=None if a.id_col else id_col)
    out = build_from(spark, df, d, p)
    names = ["missing_rate", "iv", "feature_status", "bin_members", "correlations", "grid", "coefficients", "model_metrics",
             "model_ks", "model_roc", "ks", "ks_point", "ks_curve", "optimal_cutoff", "histogram", "roc", "metrics", "ppt", "scored"]
    tables = {"scorecard": out["points"], **{n: out[n] for n in names}}
    base = f"{a.out.rstrip('/')}/{RP.run_name(a.project)}" if a.out else None
    root = RP.write_report(spark, tables, out["bin_table"], base=base, project=a.project)
    release_scratch()
    print(root)
    return root


if __name__ == "__main__":
    main()
