"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima (pre-aggregated before the shuffle) joined back to the edges,
so a node of any degree is never gathered.  Minima and edges are written to the shared folder: read
back, both sides of a join have shuffles of their own, and adaptive execution can split the rows of
a node that very many others link to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskcard.llm.common import few, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(written(few(least, n), "least"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    joined = edges.join(written(few(edges.groupBy("a").agg(F.min("b").alias("m")), n), "least"), "a")
    return joined.select("a", F.col("m").alias("b")).union(
        joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) pairs of longs.  Returns (node, root) for every node but the roots
    themselves; the root is the smallest node of its component."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    n = edges.count()                # the rows of a round are about as many, or fewer
    while True:
        parents = edges.select(F.col("a").alias("b"))
        if few(edges.join(parents, "b", "left_semi"), n).isEmpty() and \
                few(edges.groupBy("a").count().where("count > 1"), n).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = few(_large_star(edges, n).distinct(), n)
        edges = written(few(_small_star(large, n).distinct(), n), "edges")
