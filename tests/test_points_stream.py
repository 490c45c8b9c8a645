"""Points, wide = long scores, stream = batch, end-to-end build."""

from conftest import SMALL

from riskcard.plans import catalog as C
from riskcard.plans.build import build_scorecard

# Points by weight, as listed for the fixed scorecard.
POINTS_BY_W = {1.3: -150, 0.9: -104, 0.8: -92, 0.7: -81, 0.6: -69, 0.5: -58, 0.4: -46, 0.3: -35,
               0.1: -12, -0.1: 12, -0.2: 23, -0.3: 35, -0.5: 58, -0.6: 69, -0.9: 104, -1.1: 127}


def test_points_and_intercept():
    sc = C.scorecard()
    assert sc.intercept_points() == 531
    pts = sc.points()
    for f, (ws, wn) in sc.weights.items():
        for w, p in zip(ws, pts[f][0]):
            if w in POINTS_BY_W:
                assert p == POINTS_BY_W[w]


def test_wide_equals_long(spark):
    w = C.q_score_rows_wide(spark, SMALL)
    lg = C.q_score_rows_long(spark, SMALL)
    assert w.exceptAll(lg).count() == 0 and lg.exceptAll(w).count() == 0


def test_stream_equals_batch(spark):
    s = C.q_stream_score(spark, SMALL)
    b = C.q_score_rows_wide(spark, SMALL)
    assert s.count() == b.count() == 1500
    assert s.exceptAll(b).count() == 0


def test_build_end_to_end(spark):
    out = build_scorecard(spark, SMALL)
    ppt = out["ppt"].collect()
    assert len(ppt) > 0
    assert out["grid"].count() == 36
    m = out["metrics"].collect()[0]
    assert 0.5 < m["auc2"] <= 1.0


def test_build_with_presence_feature(spark):
    from pyspark.sql import functions as F

    from riskcard.plans.build import BuildParams, build_from
    from riskcard.sources import fixture as FX
    app = FX.applications(spark, SMALL).withColumn(
        "ELJCOUNTY1", F.when(F.col("app_id") % 3 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("c"), (F.col("app_id") % 97).cast("string"))))
    out = build_from(spark, app, FX.dictionary(spark),
                     BuildParams(new_asc=["avg_disc"], presence=["ELJCOUNTY1"], grid_penalties=("l2",),
                                 grid_c=(0.5, 1.0)))
    sc = out["scorecard"]
    pres = [b for b in sc.bins if b.feature == "ELJCOUNTY1"]
    assert pres and pres[0].labels == ["not NaN"]
    assert out["grid"].count() == 2
    labels = {r["label"] for r in out["points"].filter("feature = 'ELJCOUNTY1_cat'").collect()}
    assert labels == {"not NaN", "NaN"}
