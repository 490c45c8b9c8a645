"""Columns of the user may have any name, those that the stages work with included."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2])]

import corpus_pipeline  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORKED_WITH = ["_text", "_row", "_kept", "_kept_id", "_kept_text", "_row_no", "_copy", "times", "_mix", "_mix_id", "_mix_no",
               "_mix_text", "_bytes", "_h", "_h2", "_no", "_shard", "_depth", "_f_cell", "_f_d", "fp", "root", "row", "key",
               "c1_", "score", "n_words", "hit", "matches", "items", "part", "bucket", "rank", "node"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_values_come_back(spark, name):
    """Every stage returns the values of such columns, next to the row's own text."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(k, f"a plain document of many words number {k} " * (k % 3 + 1), "en", f"s{k % 2}", 40) for k in range(12)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, *[f"{n}/{r[0]}" for n in WORKED_WITH]) for r in rows],
                                 kind + ", " + ", ".join(f"{n} string" for n in WORKED_WITH))
    got = stage(spark, docs, SMALL)
    assert got.columns[: len(docs.columns)] == docs.columns
    out = got.collect()
    assert out and all([r[n] for n in WORKED_WITH] == [f"{n}/{r.doc_id}" for n in WORKED_WITH]
                       and (r.doc_id, r.text) == rows[r.doc_id][:2] for r in out)


def test_shard_columns_are_replaced_in_any_case(spark, tmp_path):
    from riskcard.llm import shard
    docs = spark.createDataFrame([(1, "x", "old", 7), (2, "y", "old", 8)], "doc_id long, text string, Shard string, DOC_BYTES int")
    got = shard.assigned(docs)
    assert got.columns == ["doc_id", "text", *shard.ADDED]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/shards-{tmp_path.name}"
    got.write.parquet(path)
    assert {(r.doc_id, r.shard, r.doc_bytes) for r in spark.read.parquet(path).collect()} == {(1, "s", 1), (2, "s", 1)}
