"""One registered query per operator, over its whole table with production parameters.

Each gets its rows from its operator and derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskcard.llm import (align, decontam, minhash, mix, shard, simhash, substring, suffix_dedup, topk, toxicity,
                          urlfilter, variants, warc)
from riskcard.llm.common import interval_words, table

# (host, path, verdict)
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])))
                      .alias("spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int")))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = interval_words(F.col("hit"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"),
                      F.size(decontam.item_list()).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", decontam.item_list()), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder).drop("target_uri")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    return urlfilter.judged(table(spark, sf_dir, "pages"), rules)


def op9_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op10_extendible_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.assigned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "doc_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), every=31)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = align.aligned(table(spark, sf_dir, "documents"))
    return documents


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_simhash_near_dedup, op3_toxicity, op4_exact_top_k, op5_benchmark_decontamination,
    op6_substring_dedup, op7_warc, op8_url_filters, op9_mix_to_target_weights, op10_extendible_hash_sharding,
    op11_document_fingerprints, op12_spelling_variants, op13_cross_tokenizer_alignment)}
