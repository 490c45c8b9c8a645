"""Suffix-array dedup with sparse suffix arrays.

Suffixes are retained only at anchors: positions whose 16-word gram has the smallest hash of
some ``window``-word window (minimisers), about one word in eighteen.  Per shard of anchors the
suffixes are sorted, neighbours are compared (longest common prefixes), and the matches are
extended to the left by sorting and comparing the reversed words before the anchors.  Two
anchors whose left and right matches together reach ``window`` words hold the same passage; the
words of a passage go from every document but that with the smallest ``doc_id``.

Right and left contexts are ``window - 16`` words each.  That is enough: a longer match is the
union of its windows, and each window has an anchor of its own.

Sharding: anchors are shuffled by their gram, so equal passages meet.  A task holds one shard of
about SHARD suffixes at a time.  A gram with more than HOT occurrences would not fit one: its
windows are settled by hash instead (pre-aggregated minimum per window hash), so no document is
dropped and no task gathers the group.

Defined cases: null or empty texts have no words and keep their row with no spans; texts shorter
than the window are never touched; repeats inside one document are kept; rows sharing a doc_id
do not remove each other's words; rows without doc_id are returned with no spans; an empty table
gives no rows; only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskcard.llm import passages as P
from riskcard.llm import words as W
from riskcard.llm.common import interval_words, merged_intervals, written

WINDOW = 50
HOT = 50_000      # occurrences of one anchor gram that a shard takes (about 0.6 KB each)
SHARD = 20_000    # suffixes sorted together, besides the last gram's


def suffixes_of(texts: DataFrame, window: int, hot: bool) -> DataFrame:
    """Retained suffixes: (gram, doc_id, text_key, pos, before, after); ``before`` holds the hashes
    of the words left of the anchor, nearest first.  For hot grams the windows they are minimisers of
    instead: (hash, doc_id, text_key, pos)."""
    ctx, guard = window - W.GRAM, window - W.GRAM + 1
    wanted_col = "hot_grams" if hot else "grams"

    def run(batches):
        for b in batches:
            wanted = b.column(wanted_col).to_pylist()
            ids, keys = b.column("doc_id").to_numpy(), b.column("text_key").to_numpy()
            for i, j, h, first, _, _, _ in P.each_chunk(b.column("text")):
                g, low = W.rolling(h, W.GRAM), W.window_minima(h, first, window)
                at = P.anchors(g, low, guard)
                cut = np.searchsorted(at, first)
                full = W.rolling(h, window).view(np.int64) if hot else None
                for k in range(j - i):
                    a, z = int(first[k]), int(first[k + 1])
                    own = at[cut[k]: cut[k + 1]]
                    own = own[np.isin(g[own].view(np.int64), wanted[i + k])]
                    if not len(own):
                        continue
                    if hot:
                        s = a + np.flatnonzero(np.isin(low[a: z - window + 1].view(np.int64), wanted[i + k]))
                        cols = [full[s], np.full(len(s), ids[i + k]), np.full(len(s), keys[i + k]),
                                (s - a).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                                         ["hash", "doc_id", "text_key", "pos"])
                        continue
                    before = [h[max(a, p - ctx): p][::-1].tobytes() for p in own.tolist()]
                    after = [h[p + W.GRAM: min(z, p + window)].tobytes() for p in own.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[own].view(np.int64)), pa.array(np.full(len(own), ids[i + k])),
                         pa.array(np.full(len(own), keys[i + k])), pa.array((own - a).astype(np.int32)),
                         pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                        ["gram", "doc_id", "text_key", "pos", "before", "after"])

    schema = ("hash long, doc_id long, text_key long, pos int" if hot else
              "gram long, doc_id long, text_key long, pos int, before binary, after binary")
    picked = texts.where(F.size(wanted_col) > 0).select(*P.KEY, "text", wanted_col)
    return picked.mapInArrow(run, schema)


def context_classes(gram: np.ndarray, contexts: list[bytes], width: int):
    """Sort the contexts within their grams and compare neighbours.  Returns (length, classes):
    ``classes(n)`` numbers the groups that agree in the gram and the first n words."""
    m = np.zeros((len(contexts), width), np.uint64)
    length = np.array([len(c) // 8 for c in contexts])
    for i, c in enumerate(contexts):
        m[i, : length[i]] = np.frombuffer(c, np.uint64)
    text = np.ascontiguousarray(m.astype(">u8")).view(f"S{8 * width}").ravel()
    order = np.lexsort((text, gram))                       # the suffix array of this shard
    s, g, n = m[order], gram[order], length[order]
    common = np.logical_and.accumulate(s[1:] == s[:-1], axis=1).sum(axis=1)
    common = np.minimum(common, np.minimum(n[1:], n[:-1]))
    common[g[1:] != g[:-1]] = -1

    def classes(words: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.r_[0, np.cumsum(common < words)]
        return out

    return length, classes


def shard_matches(gram, doc, pos, before, after, window: int):
    """(row, start) of every window that contains the row's anchor and also occurs, at an equal
    anchor of this shard, in a smaller doc_id."""
    ctx = window - W.GRAM
    n_left, left = context_classes(gram, before, ctx)
    n_right, right = context_classes(gram, after, ctx)
    rows, starts = [], []
    for a in range(ctx + 1):
        ok = np.flatnonzero((n_left >= a) & (n_right >= ctx - a))
        if len(ok) < 2:
            continue
        both = left(a)[ok] * np.int64(len(gram)) + right(ctx - a)[ok]
        order = np.lexsort((doc[ok], both))
        new = np.r_[True, both[order][1:] != both[order][:-1]]
        least = doc[ok][order][new][np.cumsum(new) - 1]
        hit = ok[order][doc[ok][order] > least]
        rows.append(hit)
        starts.append(pos[hit] - a)
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.zeros(0, int), np.zeros(0, int))


def neighbour_matches(suffixes: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, pos): starts of windows held by a smaller doc_id, found shard by shard."""

    def solve(t: pa.Table):
        gram, doc, key, pos = (t.column(c).to_numpy() for c in ("gram", "doc_id", "text_key", "pos"))
        rows, starts = shard_matches(gram, doc, pos, t.column("before").to_pylist(),
                                     t.column("after").to_pylist(), window)
        found = np.unique(np.c_[doc[rows], key[rows], starts], axis=0) if len(rows) else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1].astype(np.int64)),
             pa.array(found[:, 2].astype(np.int32))], ["doc_id", "text_key", "pos"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n < SHARD:
                continue
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))     # the last gram may go on in the next batch
            if cut:
                yield solve(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
            held, n = rest.to_batches(), len(rest)
        if n:
            yield solve(pa.Table.from_batches(held))

    return (suffixes.repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(run, "doc_id long, text_key long, pos int"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed (words in passages of at least ``window``
    words that an earlier document holds), copy_of and ``spans``, the maximal word intervals."""
    units = written(P.with_copies(written(P.profile(docs, window), "suffix-profile")), "suffix-units")
    texts = written(P.texts_of(docs, P.repeated_grams(units, hot)), "suffix-texts")
    found = neighbour_matches(suffixes_of(texts, window, hot=False), window)
    hot_windows = written(suffixes_of(texts, window, hot=True), "suffix-hot")
    starts = (found.unionByName(P.later_windows(hot_windows)).groupBy(*P.KEY)
              .agg(F.collect_set("pos").alias("starts")))
    windows = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + window).alias("end")))
    done = starts.select(*P.KEY, merged_intervals(windows).alias("found"))
    gone = F.col("copy_of").isNotNull() & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = units.drop("grams", "times").join(done, P.same_row(units, done), "left").select(
        units.doc_id, "n_words", F.when(gone, F.col("copy_of")).alias("copy_of"),
        F.when(gone, whole).otherwise(F.coalesce("found", F.array().cast(
            "array<struct<start:int,end:int>>"))).alias("spans"))
    return out.select("doc_id", "n_words", interval_words(F.col("spans")).alias("n_removed"), "copy_of", "spans")
