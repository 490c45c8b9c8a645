"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; together they are to hold as
many words as the input.  A source's target stops at ``max_repeat`` times its words, and what it
cannot take is shared again by weight among the others.

Per source: whole copies of everything while they fit the target, then the remaining budget is
filled by a subset of its documents.  Documents are counted by exact length; every length gives
its proportional part, and bounded-knapsack dynamic programming over what is left of each length
hits the rest of the budget (where one huge document leaves a gap, others come once more, never
above ``max_repeat`` times).  Which documents of a length go in follows a seeded hash of doc_id.

Only (source, length) counts enter the fit: one task fits one source, over its distinct lengths
(at most about the square root of twice its words).  Documents are ranked within (source, length,
hash bucket), so a length shared by a third of all rows is split BUCKETS ways.  The text is read
once to count words and is not shuffled.

Defined cases: null text has size 0; documents without words are taken 0 times; a source without
words has target 0; repeated rows are documents of their own; rows without doc_id or source take
part; an empty table gives no rows; only doc_id, text and source are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from riskcard.llm import words as W
from riskcard.llm.common import agree, numbered, ready, row_key, slices, strings, written

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 20240229
BUCKETS = 256
EXACT = 100_000        # words of a budget left to the dynamic programme, at least
MOST = 20_000_000      # and at most; documents longer than that are taken while they fit


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    data, offsets = strings(text)
    out = []
    for i, j in slices(offsets, W.CHUNK):
        _, _, first = W.spans(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], W.NOT_SPACE)
        out.append(np.diff(first))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source (one row each): no, source_size, target and the whole ``copies`` it takes.

    Going up by (limit / weight), a source is held at its limit if its share of what is left is
    above it; the others share the rest by weight.  The windows run over one row per source."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("no", F.row_number().over(by_source) - 1).withColumn("w", w)
         .withColumn("limit", F.col("source_size") * max_repeat))
    up = Window.orderBy(F.col("limit") / F.col("w"), "no")
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("left_words", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("held", F.col("w") * F.col("left_words").cast("double")
                     > F.col("limit").cast("double") * F.col("left_weight"))
         .withColumn("rest_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("limit")))
                                                               .over(everything), F.lit(0)))
         .withColumn("rest_weight", F.sum(F.when(~F.col("held"), F.col("w"))).over(everything)))
    target = F.when(F.col("held"), F.col("limit").cast("double")).otherwise(
        F.col("w") * F.col("rest_words") / F.col("rest_weight"))
    return (s.withColumn("target", target)
            .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(F.lit(0)).cast("int"))
            .withColumn("budget", F.floor("target") - F.col("copies") * F.col("source_size"))
            .select("source", "no", "source_size", "target", "copies", "budget",
                    (F.lit(max_repeat) - F.col("copies")).alias("spare")))


def _fill(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``free`` documents of each length come nearest to the budget from below: long ones
    first while more than EXACT words are left, or without that reserve while more than MOST are, then a
    bounded knapsack over reachable sums."""
    take, rest = np.zeros(len(lengths), np.int64), budget
    down = np.argsort(-lengths)
    for i in down:
        if rest > EXACT:
            take[i] = min(int(free[i]), (rest - EXACT) // int(lengths[i]))
            rest -= int(take[i]) * int(lengths[i])
    for i in down:
        # free documents are now longer than rest - EXACT words, so at most one fits: the longest
        if rest > MOST:
            n = min(int(free[i] - take[i]), rest // int(lengths[i]))
            take[i] += n
            rest -= n * int(lengths[i])
    if not 0 < rest <= MOST:
        return take
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    came, chunks = np.full(rest + 1, -1, np.int32), []
    for i in down:
        left, part = min(int(free[i] - take[i]), rest // int(lengths[i])), 1
        while left > 0 and not reach[rest]:
            n = min(part, left)
            left, part = left - n, part * 2
            step = n * int(lengths[i])
            new = np.flatnonzero(reach[: rest + 1 - step] & ~reach[step:]) + step
            came[new] = len(chunks)
            reach[new] = True
            chunks.append((i, n, step))
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n, step = chunks[came[at]]
        take[i] += n
        at -= step
    return take


def subset(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int = 1) -> np.ndarray:
    """How many documents of each length to take: every length's proportional part, then the best
    fill of the rest.  Documents come a second time (up to ``repeats``) only where no subset meets
    the budget."""
    total = int((lengths * counts).sum())
    budget = min(budget, total * repeats)
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    take = np.array([int(c) * min(budget, total) // total for c in counts], np.int64)
    for r in range(1, repeats + 1):
        rest = budget - int((lengths * take).sum())
        if not rest:
            break
        take = take + _fill(lengths, counts * r - take, rest)
    return take


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    n = rows["n"].to_numpy(np.int64)
    extra = subset(rows["size"].to_numpy(np.int64), n, int(rows["budget"].iloc[0]), int(rows["spare"].iloc[0]))
    return pd.DataFrame({"no": rows["no"].to_numpy(), "size": rows["size"].to_numpy(), "plus": extra // n,
                         "extra": extra % n})


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), size, source_size, target and
    ``times``, how often the mix takes it."""
    ready(docs.sparkSession)
    base = written(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                               F.xxhash64("text").alias("text_key"), word_count("text").alias("size")), "mix-sizes")
    order = F.xxhash64("doc_id", "text_key", F.lit(seed))
    rows = base.withColumn("bucket", F.pmod(order, F.lit(BUCKETS)))
    plan = written(targets(base, weights, max_repeat), "mix-targets")
    here = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *[
        f"p.{c}" for c in ("no", "source_size", "target", "copies", "budget")])
    cells = written(rows.where("size > 0").groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-cells")
    cells = cells.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select(
        "no", "size", "bucket", "n", "budget", "spare")
    lengths = cells.groupBy("no", "size", "budget", "spare").agg(F.sum("n").alias("n")).where("budget > 0")
    extra = lengths.groupBy("no").applyInPandas(_fit, "no int, size long, plus int, extra long")
    # the cells of a length are filled in bucket order; at most BUCKETS rows per window
    earlier = (Window.partitionBy("no", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = (cells.join(extra, ["no", "size"])
             .withColumn("quota", F.col("extra") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))
             .select("no", "size", "bucket", "plus", "quota").where("plus > 0 or quota > 0"))
    rank = F.row_number().over(Window.partitionBy("no", "size", "bucket").orderBy(order, "doc_id", "text_key"))
    return (here.join(quota, ["no", "size", "bucket"], "left").withColumn("rank", rank)
            .withColumn("times", F.when(F.col("size") > 0, F.col("copies") + F.coalesce("plus", F.lit(0)) + F.when(
                F.col("rank") <= F.col("quota"), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0)))
            .select("doc_id", "text_key", "size", "source_size", "target", "times"))


def apply_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, all columns (of any name), each as often as the mix takes it."""
    names, docs = docs.columns, numbered(docs, "doc_id", "text", "source")
    # repeated rows agree in id and text; numbering them on both sides keeps the join one to one
    nth = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    times = mixed(docs, **parameters).select(
        F.col("doc_id").alias("_mix_id"), F.col("text_key").alias("_mix_text"), "times",
        row_key(F.col("doc_id"), F.col("text_key")).alias("_mix"))
    times = times.withColumn("_mix_no", nth("_mix", "_mix_id", "_mix_text"))
    rows = docs.withColumn("_text", F.xxhash64("text")).withColumn("_row", row_key(F.col("doc_id"), F.col("_text")))
    rows = rows.withColumn("_row_no", nth("_row", "doc_id", "_text"))
    same = (agree(rows["doc_id"].cast("long"), times["_mix_id"].cast("long")) & agree(rows["_text"], times["_mix_text"])
            & agree(rows["_row_no"], times["_mix_no"]))
    return (rows.join(times, (rows["_row"] == times["_mix"]) & same).where("times > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).select(*[rows[c] for c in docs.columns]).toDF(*names))
