"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every word covered by a window of ``window`` words whose word sequence also starts in a
document with a smaller ``doc_id`` is removed; repeated windows merge into maximal
removal intervals.  Windows are judged on the input.

1. A rolling (Rabin-Karp) hash of every 16-word gram gives each window its minimiser gram;
   those are counted.  A window whose minimiser occurs in one document cannot repeat.
2. The rolling hash of every remaining window is counted: smallest doc_id per hash,
   pre-aggregated on the map side, joined back to the windows.
3. The starts of later windows are gathered per document and merged into intervals.

Defined cases: null or empty text has no words and keeps its row; texts shorter than the
window lose nothing; repeats inside one document are kept; rows that share a doc_id do not
remove each other's words; rows without doc_id are returned unchanged; an empty table gives
no rows; only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskcard.llm import passages as P
from riskcard.llm import words as W
from riskcard.llm.common import written

WINDOW = 50
NOTHING = hashlib.sha256(b"").hexdigest()


def windows_of(texts: DataFrame, window: int) -> DataFrame:
    """(hash, doc_id, text_key, pos) of every window whose minimiser is among the row's ``grams``."""

    def run(batches):
        for b in batches:
            wanted = b.column("grams").to_pylist()
            for i, j, h, first, _, _, _ in P.each_chunk(b.column("text")):
                low, full = W.window_minima(h, first, window).view(np.int64), W.rolling(h, window)
                for k in range(j - i):
                    here = slice(first[k], max(first[k], first[k + 1] - window + 1))
                    pos = np.flatnonzero(np.isin(low[here], wanted[i + k]))
                    if len(pos):
                        n = len(pos)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(full[here][pos].view(np.int64)),
                             pa.array(np.full(n, b.column("doc_id")[i + k].as_py())),
                             pa.array(np.full(n, b.column("text_key")[i + k].as_py())),
                             pa.array(pos.astype(np.int32))], ["hash", "doc_id", "text_key", "pos"])

    def packed(batches):
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += len(x)
            if n >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return (texts.select(*P.KEY, "text", "grams")
            .mapInArrow(packed, "hash long, doc_id long, text_key long, pos int"))


def cut(texts: DataFrame, window: int, keep_text: bool = False) -> DataFrame:
    """Remove the windows at ``starts`` from each text: counts, digest, removed word intervals
    and, if wanted, the kept words."""
    schema = ("doc_id long, text_key long, n_removed long, kept_sha256 string, "
              "removed array<struct<start:int,end:int>>" + (", kept string" if keep_text else ""))

    def run(batches):
        for b in batches:
            out = []
            for t, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist()):
                w = t.encode().split()
                parts, at, gone = [], 0, W.cover(np.asarray(starts), window)
                for s, e in gone.tolist():
                    parts += w[at:s]
                    at = e
                kept = b" ".join(parts + w[at:])
                out.append((int((gone[:, 1] - gone[:, 0]).sum()), hashlib.sha256(kept).hexdigest(),
                            [{"start": s, "end": e} for s, e in gone.tolist()], kept.decode()))
            cols = list(zip(*out)) or [()] * 4
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [b.column("doc_id"), b.column("text_key"), pa.array(cols[0], pa.int64()),
                      pa.array(cols[1], pa.string()), pa.array(cols[2], span)]
            names = ["doc_id", "text_key", "n_removed", "kept_sha256", "removed"]
            if keep_text:
                arrays.append(pa.array(cols[3], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return texts.select(*P.KEY, "text", "starts").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, copy_of (the earlier
    document with the same words, all of whose words went) and ``removed``, the removed word
    intervals.  ``keep_text`` adds ``kept``: the kept words joined by one space, null where
    nothing was removed (the text stands as it is)."""
    units = written(P.with_copies(written(P.profile(docs, window), "substring-profile")), "substring-units")
    grams = P.repeated_grams(units, 2**62).drop("hot_grams")
    texts = written(P.texts_of(docs, grams), "substring-texts")
    windows = written(windows_of(texts, window), "substring-windows")
    starts = P.later_windows(windows).groupBy(*P.KEY).agg(F.collect_list("pos").alias("starts"))
    done = cut(texts.join(starts, P.KEY), window, keep_text)
    gone = F.col("copy_of").isNotNull() & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = units.drop("grams", "times").join(done, P.same_row(units, done), "left").select(
        units.doc_id, "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "words_sha")).alias("kept_sha256"),
        F.when(gone, F.col("copy_of")).alias("copy_of"),
        F.when(gone, whole).otherwise(F.coalesce("removed", F.array().cast(
            "array<struct<start:int,end:int>>"))).alias("removed"),
        *([F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))
    return out
