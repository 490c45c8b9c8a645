"""nnPU toxicity: held-out accuracy, and the awkward inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskcard.llm import toxicity
from riskcard.llm.queries import op3_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op3_toxicity(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    y = np.array([r.toxic for r in rows if r.held_out and r.toxic is not None])
    s = np.array([r.score for r in rows if r.held_out and r.toxic is not None])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()
    assert auc > 0.93, auc
    assert (s[y == 1] >= 0.3).mean() > 0.8 and (s[y == 0] >= 0.3).mean() < 0.01


def small(spark):
    bad = ["you idiot moron trash", "such a stupid moron here", "IDIOT, scum and trash"] * 12
    good = ["a quiet walk in the park", "the train is late again", "we cook rice and beans", "rain all day long"] * 90
    rows = [(i, t) for i, t in enumerate(bad + good)]
    labels = [(i, 1) for i in range(len(bad))] + [(i, 0) for i in range(len(bad), 390)]
    return rows, labels


def test_defined_cases(spark):
    rows, labels = small(spark)
    rows += [(900, None), (901, ""), (902, "idiot " * 20_000), (903, "calm rice " * 20_000), (3, rows[3][1]), (None, "moron idiot")]
    docs = spark.createDataFrame([(d, t, 1, 0.5, "x") for d, t in rows],
                                 "doc_id long, text string, toxic int, score double, features string").repartition(3)
    lab = spark.createDataFrame(labels + [(0, 0), (900, None), (None, 1)], "doc_id long, toxic int")
    got = docs.select("doc_id", toxicity.score(docs, lab).alias("s")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.s)
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    assert by[900] == by[901] and by[3][0] == by[3][1]
    assert by[902][0] > 0.3 > by[903][0] and by[None][0] > 0.3 > by[40][0]
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, ss in by.items() if ss[0] < 0.3}
    assert toxicity.without_toxic(docs.limit(0), lab).count() == 0
    assert docs.select(toxicity.score(docs, lab.limit(0)).alias("s")).agg(F.max("s")).head()[0] == 0.0


def test_held_out_labels_are_never_used(spark):
    rows, labels = small(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    a = docs.select("doc_id", toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).alias("s"))
    b = docs.select("doc_id", toxicity.score(docs, spark.createDataFrame(turned, "doc_id long, toxic int")).alias("s"))
    assert dict(map(tuple, a.collect())) == pytest.approx(dict(map(tuple, b.collect())))


def test_features_of_texts_do_not_cross(spark):
    import pyarrow as pa
    one = [next(toxicity.each_text(pa.array([t])))[1].tolist() for t in ("ab cdefgh", "xyz", "cdefgh")]
    n, numbers, row = next(toxicity.each_text(pa.array(["ab cdefgh", "xyz", "cdefgh"])))
    assert n == 3 and [sorted(numbers[row == k].tolist()) for k in range(3)] == [sorted(x) for x in one]


def test_long_texts_have_the_features_of_their_whole(monkeypatch):
    import pyarrow as pa
    text = "Ab cdefgh ij, " * 300 + "x" * 5000 + " É" + "y" * 10
    whole = sorted(next(toxicity.each_text(pa.array([text])))[1].tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 700)
    (n, numbers, row), = toxicity.each_text(pa.array([text]))
    assert n == 1 and sorted(numbers.tolist()) == whole and not row.any()
