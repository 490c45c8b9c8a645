"""The corpus pipeline: documents through the operators of ``riskcard.llm``, stage by stage.

Each stage works on all its predecessor kept and calls one operator.  All but the last return the
columns of the documents; the last adds each document's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskcard.llm import decontam, mix, shard, simhash, toxicity
from riskcard.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, bits=simhash.BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it."""
    return mix.apply_mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard."""
    return shard.assigned(docs)


STAGES = [("toxicity", reject_toxic), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix_sources),
          ("sharding", deal_shards)]

# fitting a classifier and choosing a subset have no SQL form; tests/llm hold brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
