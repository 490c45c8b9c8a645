"""Steps shared by the two operators on verbatim passages (suffix_dedup, substring).

A passage of ``window`` words is found through its *anchor*: the 16-word gram of
smallest hash inside it (its minimiser).  Equal passages have equal anchors, so a
passage can only repeat if its anchor gram occurs in two documents.  About one gram
in eighteen is an anchor, so counting anchors moves a fraction of the words.

Documents whose whole word sequence equals that of a smaller ``doc_id`` ("copies")
are settled at once: every window of theirs starts in that document as well.

Rows are told apart by (doc_id, text_key), text_key = xxhash64(text), so repeated ids
are harmless.  Rows without an id neither lose words nor make others lose any.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskcard.llm import words as W
from riskcard.llm.common import ready, slices, strings, written

KEY = ["doc_id", "text_key"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("text_key"))


def same_row(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.text_key == b.text_key)


def anchors(grams: np.ndarray, low: np.ndarray, guard: int) -> np.ndarray:
    """Positions of grams that are the minimiser of some window (``low``: 0 where none starts)."""
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(guard - 1, np.uint64)
    best = W.sliding(np.r_[pad, low, pad], guard, np.maximum)
    return np.flatnonzero((grams == best) & (best != 0))


def each_chunk(column):
    """For a text column: (i, j, hashes, first, data, starts, ends) of row ranges of bounded size."""
    data, offsets = strings(column)
    for i, j in slices(offsets, W.CHUNK):
        part = data[offsets[i]: offsets[j]]
        starts, ends, first = W.spans(part, offsets[i: j + 1] - offsets[i], W.NOT_SPACE)
        yield i, j, W.word_hashes(part, starts, ends, W.NOT_SPACE), first, part, starts, ends


def profile(docs: DataFrame, window: int) -> DataFrame:
    """Per document: its key, number of words, SHA-256 of its words joined by one space,
    its anchor grams and how often each is an anchor there."""
    schema = "doc_id long, text_key long, n_words long, words_sha string, grams array<long>, times array<int>"
    guard = window - W.GRAM + 1

    def run(batches):
        for b in batches:
            sha, n, grams, times = [], [], [], []
            for i, j, h, first, _, _, _ in each_chunk(b.column(1)):
                g = W.rolling(h, W.GRAM)
                at = anchors(g, W.window_minima(h, first, window), guard)
                cut = np.searchsorted(at, first)
                n += (first[1:] - first[:-1]).tolist()
                for k in range(j - i):
                    u, c = np.unique(g[at[cut[k]: cut[k + 1]]].view(np.int64), return_counts=True)
                    grams.append(u)
                    times.append(c.astype(np.int32))
            for t in b.column(1).to_pylist():
                sha.append(hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(grams, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "n_words", "words_sha", "grams", "times"])

    ready(docs.sparkSession)
    return keyed(docs).mapInArrow(run, schema)


def with_copies(prof: DataFrame) -> DataFrame:
    """Add ``copy_of``: the smallest doc_id with the same word sequence, if it is another one.
    ``prof`` is read twice: give it a written table."""
    groups = (prof.where("doc_id is not null").groupBy("words_sha")
              .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
    return (prof.join(written(groups, "copies"), "words_sha", "left")
            .withColumn("copy_of", F.when(F.col("doc_id") > F.col("lo"), F.col("lo"))).drop("lo"))


def repeated_grams(units: DataFrame, hot: int) -> DataFrame:
    """Per document (copies left out): the anchors that also occur in another document.
    ``hot`` marks those with more than ``hot`` occurrences in all."""
    each = (units.where("copy_of is null and doc_id is not null")
            .select(*KEY, F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("times").alias("times")))))
    counts = (each.groupBy("gram")
              .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("times").alias("n"))
              .where("lo < hi").select("gram", (F.col("n") > hot).alias("hot")))
    return (each.drop("times").join(written(counts, "repeated-grams"), "gram").groupBy(*KEY)
            .agg(F.collect_list(F.when(~F.col("hot"), F.col("gram"))).alias("grams"),
                 F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot_grams")))


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the given documents (repeated rows once), with the other columns of ``rows``."""
    return keyed(docs).join(rows, KEY).dropDuplicates(KEY)


def later_windows(windows: DataFrame) -> DataFrame:
    """Of (hash, doc_id, text_key, pos) rows those whose hash also occurs in a smaller doc_id.

    Minima are pre-aggregated before the shuffle; the join back is one that adaptive
    execution splits where a hash is hot."""
    first = (windows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
             .where("lo < hi").select("hash", "lo"))
    # written, so that it is shuffled by itself: only then can the join split a hot hash
    return windows.join(written(first, "first-windows"), "hash").where("doc_id > lo").select(*KEY, "pos")


__all__ = ["KEY", "anchors", "each_chunk", "keyed", "later_windows", "profile", "ready", "repeated_grams",
           "same_row", "texts_of", "with_copies", "written"]
