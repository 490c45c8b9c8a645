"""Exact top-k inner-product search in three phases with a uniform threshold.

The dimensions are cut into LISTS lists; a vector's score is the sum of its partial scores in
them.  Every task holds a part of each list.  No partial score exceeds the product of the lengths
(norms) of the two pieces, so that product is the most that an entry not read yet can add.

1. Each task reads the head of each of its lists: the k entries of every batch with the longest
   pieces.  It scores these vectors and sends its k best totals per query.  The k-th best of all is
   a safe cutoff: k vectors reach it.
2. The cutoff is broadcast.  A vector can only reach it if some partial score is at least
   cutoff / LISTS (the uniform threshold).  List by list, tasks read the entries that can reach the
   threshold and belong to vectors that can still reach the cutoff: what was read, plus the most
   that the other lists can add.  This ends when few (query, vector) pairs are left.
3. For those pairs the remaining partial scores are resolved exactly, list by list; a pair whose
   bound falls below the cutoff is out.  The k best of a task raise its own cutoff as it goes.  k per
   task and query at most compete (ties to the smaller id), and a window picks the k best.

Queries are worked through in blocks of bounded size (QUERY_CELLS numbers), each broadcast to a
scan of all vectors; the vectors are never shuffled.  Components become floor(1024 x) in double
precision.  Sums below 2^53 are exact in float64 (BLAS); larger ones use Python integers.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; shorter vectors are padded with zeros; a repeated candidate row is a
candidate each time; a repeated query id is asked once, with its smallest vector, and no row of
that id is its candidate; with fewer than k candidates all are returned; no queries, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskcard.llm.common import ready, written
from riskcard.session import scratch_path

K = 10
LISTS = 8
SCALE = 1024
QUERY_CELLS = 1 << 19       # numbers in a block of queries (4 MB)
PAIRS = 1 << 19             # scores held at a time in a task
FEW = 1 / 4                 # share of pairs from which they are resolved one by one


def matrix(ids: pa.Array, vectors: pa.Array, width: int, scale: int = SCALE):
    """(ids, integer rows floor(scale * x), padded to ``width``) of the rows that take part."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    flat = vectors.values.cast(pa.float64())[offsets[0]: offsets[-1]]
    missing = np.asarray(flat.is_null())
    flat = np.asarray(flat.fill_null(0.0))
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(ids)), size)
    bad = np.bincount(row[missing | ~np.isfinite(flat)], minlength=len(ids)) > 0
    keep = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid()) & ~bad
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
    used = keep[row] & (place < width)
    out = np.zeros((len(ids), width))
    out[row[used], place[used]] = np.floor(scale * flat[used])
    kept = ids.filter(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64)
    return kept, out[keep]


def exactly(q: np.ndarray, c: np.ndarray):
    """Both as numbers whose sums of products are exact: float64 below 2^53, else Python integers."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2**53:
        return q, c
    exact = np.frompyfunc(int, 1, 1)
    return exact(q), exact(c)


def lengths(rows: np.ndarray, parts: list) -> np.ndarray:
    """The length of each row's piece in every list (rows x lists)."""
    return np.stack([np.sqrt((rows[:, p].astype(np.float64) ** 2).sum(axis=1)) for p in parts], axis=1)


def lists_of(width: int, lists: int) -> list:
    return [p for p in np.array_split(np.arange(width), lists) if len(p)]


def heads(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, lists: int):
    """Phase 1 of a batch: (totals of the list heads, -inf for a query's own row; multiplications)."""
    long = lengths(c, lists_of(c.shape[1], lists))
    head = np.unique(np.argpartition(-long, min(k, len(c)) - 1, axis=0)[:k]) if len(c) else np.zeros(0, np.int64)
    a, b = exactly(q, c[head])
    return np.where(own[:, head], -np.inf, a @ b.T), len(q) * len(head) * q.shape[1]


def survivors(q: np.ndarray, c: np.ndarray, own: np.ndarray, cut: np.ndarray, lists: int):
    """Phases 2 and 3 of a batch: (query, row, exact score) of all pairs that reach the cutoff of
    their query (-inf: none), and the multiplications made."""
    parts = lists_of(c.shape[1], lists)
    ql, cl = lengths(q, parts), lengths(c, parts)
    q, c = exactly(q, c)
    # rounding of the bounds, far below one unit for sums of ordinary size
    spare = 1 + 1e-9 * len(parts) * ql.max(initial=0) * cl.max(initial=0)
    least = cut.astype(np.float64)[:, None]
    threshold = least / len(parts) - spare
    known = np.zeros((len(q), len(c)), q.dtype)
    rest = ql @ cl.T
    unread = np.ones((len(parts), len(c)), bool)
    alive, made = ~own & (rest + spare >= least), 0
    for no, p in enumerate(parts):
        if alive.mean() < FEW:
            break
        most = np.outer(ql[:, no], cl[:, no])
        at = np.flatnonzero((alive & (most >= threshold)).any(axis=0))
        known[:, at] += q[:, p] @ c[np.ix_(at, p)].T
        made += len(q) * len(at) * len(p)
        rest[:, at] -= most[:, at]
        unread[no, at] = False
        alive &= known.astype(np.float64) + rest + spare >= least
    qi, ci = np.nonzero(alive)
    score, left = known[qi, ci], rest[qi, ci]
    for no, p in enumerate(parts):
        todo = np.flatnonzero(unread[no, ci])
        step = max(1, PAIRS // len(p))
        for i in range(0, len(todo), step):
            at = todo[i: i + step]
            score[at] += (q[np.ix_(qi[at], p)] * c[np.ix_(ci[at], p)]).sum(axis=1)
        made += len(todo) * len(p)
        left[todo] -= ql[qi[todo], no] * cl[ci[todo], no]
        stay = score.astype(np.float64) + left + spare >= least[qi, 0]
        qi, ci, score, left = qi[stay], ci[stay], score[stay], left[stay]
    ok = score >= cut[qi]
    return qi[ok], ci[ok], score[ok], made


def _pieces(batches, block):
    """(candidate ids, candidate rows, own-row mask) of bounded pieces."""
    q_ids, q = block
    step = max(1, PAIRS // max(len(q_ids), 1))
    for b in batches:
        ids, c = matrix(b.column(0), b.column(1), q.shape[1])
        for s in range(0, len(ids), step):
            yield ids[s: s + step], c[s: s + step], q_ids[:, None] == ids[None, s: s + step]


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row (in any order)."""
    if rows.shape[1] <= k:
        return rows
    if rows.dtype == object:
        return np.sort(rows, axis=1)[:, -k:]
    return np.partition(rows, rows.shape[1] - k, axis=1)[:, -k:]


def gather(vectors: DataFrame, block, k: int, lists: int) -> DataFrame:
    """Phase 1: (query, total), the k best totals of each task among its list heads."""

    def run(batches):
        q = block.value[1]
        best = np.full((len(q), 0), -np.inf)
        for _, c, own in _pieces(batches, block.value):
            best = _best(np.hstack([best, heads(q, c, own, k, lists)[0]]), k)
        query, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array([int(x) for x in best[query, col]], pa.int64())],
            ["query", "total"])

    return vectors.mapInArrow(run, "query int, total long")


def resolve(vectors: DataFrame, block, cutoffs, k: int, lists: int) -> DataFrame:
    """Phases 2 and 3: (query_id, vec_id, score) of every task's entries that reach the cutoff."""

    def run(batches):
        q_ids, q = block.value
        cut = np.array([c if c is not None else -np.inf for c in cutoffs.value], object)
        query, vec, score = (np.zeros(0, np.int64) for _ in range(3))
        for ids, c, own in _pieces(batches, block.value):
            qi, ci, exact, _ = survivors(q, c, own, cut, lists)
            query, vec = np.r_[query, qi], np.r_[vec, ids[ci]]
            score = np.r_[score, np.array([int(x) for x in exact], np.int64)]
            order = np.lexsort((vec, -score, query))
            rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            order, rank = order[rank < k], rank[rank < k]
            query, vec, score = query[order], vec[order], score[order]
            for x, total in zip(query[rank == k - 1], score[rank == k - 1]):     # k vectors of this task reach it
                cut[x] = max(cut[x], int(total))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(vec), pa.array(score)],
                                         ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query, k: int = K, lists: int = LISTS, query_cells: int = QUERY_CELLS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query row."""
    spark = table.sparkSession
    ready(spark)
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = (vectors.where(is_query & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
             .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
                     .alias("q")).groupBy("vec_id").agg(F.min("q").alias("q")))
    asked = written(asked, "queries")             # counted, and read block by block
    n, width = asked.agg(F.count("*"), F.max(F.size("q"))).head()
    widest = vectors.agg(F.max(F.size("embedding"))).head()[0] if n else 0
    width = max(width or 0, widest or 0, 1)
    blocks = max(1, math.ceil(n * width / query_cells)) if n else 0
    path = scratch_path(spark, "top-k")
    schema = "query_id long, vec_id long, score long"
    for no in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == no).toArrow()
        ids, rows = matrix(got.column(0).combine_chunks(), got.column(1), width, scale=1)
        if not len(ids):
            continue
        block = spark.sparkContext.broadcast((ids, rows))
        one = Window.partitionBy("query").orderBy(F.col("total").desc())
        kth = (gather(vectors, block, k, lists).withColumn("r", F.row_number().over(one))
               .where(F.col("r") == k).select("query", "total").collect())     # one number per query of the block
        cut = dict((r.query, r.total) for r in kth)
        cutoffs = spark.sparkContext.broadcast([cut.get(i) for i in range(len(ids))])
        resolve(vectors, block, cutoffs, k, lists).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
