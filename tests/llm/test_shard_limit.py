"""Sharding at its production limit, on enough text that shards split."""

import hashlib

from pyspark.sql import functions as F

from riskcard.llm import shard


def slow(sizes: dict, prefix: str = "") -> dict:
    """doc_id -> (shard, depth, bytes, documents), splitting one bit at a time."""
    total = sum(sizes.values())
    if total <= shard.LIMIT or len(sizes) == 1:
        return {i: ("s" + prefix, len(prefix), total, len(sizes)) for i in sizes}
    bit = lambda i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")[len(prefix)]
    out = {}
    for b in "01":
        out |= slow({i: n for i, n in sizes.items() if bit(i) == b}, prefix + b) if any(bit(i) == b for i in sizes) else {}
    return out


def test_production_limit(spark):
    size = lambda i: 70_000_000 if i == 11 else 100_000 + i * 7_919 % 1_900_000
    sizes = {i: size(i) for i in range(240)}
    docs = spark.createDataFrame(list(sizes.items()), "doc_id long, n int").repartition(48).select(
        "doc_id", F.expr("repeat('x', n)").alias("text"))
    got = {r.doc_id: (r.shard, r.shard_depth, r.shard_bytes, r.shard_docs)
           for r in shard.assigned(docs).drop("text").collect()}
    assert got == slow(sizes)
    assert len({s for s, *_ in got.values()}) >= 4
    assert all(b <= shard.LIMIT or n == 1 for _, _, b, n in got.values()) and got[11][3] == 1
