"""Registered queries against their DuckDB oracles, and the pipeline stage by stage."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1])]

import corpus_pipeline  # noqa: E402
from harness import compare, duck  # noqa: E402
from riskcard.llm import decontam, mix, oracle, queries, shard, simhash, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_one_query_per_operator():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(oracle.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("key", sorted(oracle.ORACLES))
def test_query_matches_oracle(spark, con, key):
    r = compare(queries.QUERIES[key](spark, SMALL), con, oracle.ORACLES[key])
    assert r["ok"], r


def test_small_shards_match_oracle(spark, con):
    out = shard.assigned(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), 20_000)
    r = compare(out.select("doc_id", "doc_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs"), con,
                oracle.SHARDING.format(limit=20_000))
    assert r["ok"], r


def test_pipeline_stages(spark):
    """Each stage's rows follow from its operator's own (separately tested) decisions on its input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "SimHash near-dedup", "benchmark decontamination",
                           "mixing sources to target weights", "sharding"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, SMALL)
        if name != "sharding":
            assert df.columns == columns
        if name == "toxicity":
            s = docs.select("doc_id", toxicity.score(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).alias("s"))
            want = Counter(r.doc_id for r in s.collect() if r.s < 0.3)
        elif name == "SimHash near-dedup":
            want = Counter({r.component_id: 1 for r in simhash.near_duplicates(docs).collect()})
        elif name == "benchmark decontamination":
            found = decontam.longest_matches(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            want = Counter(r.doc_id for r in found.collect() if not r.hit)
        elif name.startswith("mixing"):
            want = Counter()
            for r in mix.mixed(docs).collect():
                want[r.doc_id] += r.times
            want = +want
        else:
            want = ids(docs)
        assert ids(df) == want, name
        df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{id(out)}-{len(out)}")
        docs = spark.read.parquet(path)
        out[name] = docs
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.select("doc_id", "shard").collect())) == sorted(
        map(tuple, docs.select("doc_id", "shard").collect()))


def test_stages_take_awkward_documents(spark):
    rows = [(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"),
            (3, "word " * 30_000, "en", "s", 150_000, "x"), (None, "a b c d", None, None, 7, None),
            (4, "a text like others", "en", "s", 18, "y"), (4, "another text", "en", None, 12, "y")]
    for these in (rows, []):
        docs = spark.createDataFrame(these, COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, docs, SMALL)
            assert set(docs.columns) <= set(df.columns)
            if these:
                assert df.count() > 0, name
            else:
                assert df.count() == 0, name
