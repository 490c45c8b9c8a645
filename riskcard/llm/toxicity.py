"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are used: with the class prior p, the risk of
calling unlabelled text clean is corrected by the share that is toxic,

    risk = p * E_pos[loss(+f)] + max(0, E_unl[loss(-f)] - p * E_pos[loss(-f)])

(the max, taken per mini-batch, is what keeps a flexible model from driving the corrected part
below zero).  The classifier is a numpy linear model over hashed text features: whole words and
their 4- and 6-byte grams, the first ones marked as word starts, each weighed by its share of
the document's features.  With the logistic loss, sigmoid(f) estimates P(toxic | text).

Training runs on bounded samples, chosen by a hash of doc_id: at most MAX_POSITIVE confirmed
toxic documents and MAX_UNLABELLED others, whole texts.  The prior is the toxic share among all
labelled training rows.  Scoring is a scan: each text is scored in a task with the weights
(2^20 floats, 4 MB) broadcast.

Defined cases: null and empty texts have no features and get the score of the model's constant;
a document with several labels is toxic if one says so; null labels say nothing; documents
without an id are scored and never train; repeated documents are scored row by row; without a
confirmed toxic label every score is 0, without a text of one it is the prior; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskcard.llm import words as W
from riskcard.llm.common import ready, slices, strings, written

DIMS = 20                  # log2 of the hashed features
GRAMS = (4, 6)             # bytes
CHUNK = 512 << 10          # bytes worked on at a time; temporaries take about 120 times that
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 6_000
THRESHOLD = 0.3
MIN_DOCS, MIN_Z = 3, 5.0    # a feature in the model: documents of a sample, standard errors apart
SCALE = 100.0              # feature shares are small; this brings them near 1
EPOCHS, BATCHES, RATE, DECAY = 80, 8, 0.1, 1e-4

# letters: a-z and every byte beyond ASCII, after lower-casing A-Z and U+00C0 to U+00DE
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def feature_numbers(data: np.ndarray, offsets: np.ndarray):
    """Hashed features of many texts: (numbers, text of each)."""
    c = W.LOWER[data]
    after_c3 = np.r_[False, data[:-1] == 0xC3]
    c[after_c3 & (c >= 0x80) & (c <= 0x9E) & (c != 0x97)] += 0x20
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    letter = _LETTER[c]
    starts, ends, first = W.spans(c, offsets, _LETTER)
    numbers = [(W.word_hashes(c, starts, ends, _LETTER) >> np.uint64(64 - DIMS)).astype(np.int32)]
    owners = [np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))]
    # grams over the letters, each word led by one boundary mark
    gap = np.r_[0, np.cumsum(~letter)]
    value = np.where(letter, W._BYTE[c], np.uint64(0x5851F42D4C957F2D))
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * W._P + value[k: k + m]
        inside = gap[n:] == gap[1: m + 1]            # all but the leading byte are letters
        inside &= owner[n - 1:] == owner[:m]
        numbers.append((W.mix(h[inside]) >> np.uint64(64 - DIMS)).astype(np.int32))
        owners.append(owner[:m][inside])
    return np.concatenate(numbers), np.concatenate(owners)


def pieces(data: np.ndarray):
    """Cut a long text where no letters are, so that no feature is lost: (start, end) ranges."""
    gaps = np.flatnonzero(~_LETTER[W.LOWER[data]])
    i = 0
    while i < len(data):
        at = np.searchsorted(gaps, i + CHUNK, "right") - 1
        j = int(gaps[at]) if at >= 0 and gaps[at] > i else \
            int(gaps[at + 1]) if at + 1 < len(gaps) else len(data)
        j = len(data) if len(data) - i <= CHUNK else j
        yield i, j
        i = j


def each_text(column):
    """Per bounded row range of a text column: (rows, feature numbers, row of each feature)."""
    data, offsets = strings(column)
    for i, j in slices(offsets, CHUNK):
        part = data[offsets[i]: offsets[j]]
        if len(part) <= CHUNK:
            yield j - i, *feature_numbers(part, offsets[i: j + 1] - offsets[i])
        else:                       # one long text
            numbers = np.concatenate([feature_numbers(part[a:b], np.array([0, b - a]))[0] for a, b in pieces(part)])
            yield 1, numbers, np.zeros(len(numbers), np.int32)


def scores_of(column, weights: np.ndarray, constant: float) -> np.ndarray:
    out = []
    for rows, numbers, row in each_text(column):
        total = np.bincount(row, weights=weights[numbers], minlength=rows)
        n = np.bincount(row, minlength=rows)
        out.append(1 / (1 + np.exp(-np.clip(constant + SCALE * total / np.maximum(n, 1), -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: list, positive: np.ndarray, prior: float, seed: int = 7):
    """nnPU by Adam on mini-batches.  ``docs``: per document the numbers of the model's features it
    has and their shares of all its features."""
    if not positive.any():
        return np.zeros(1 << DIMS, np.float32), float(np.log(prior / (1 - prior)))
    ptr = np.cumsum(np.r_[0, [len(x) for x, _ in docs]]).astype(np.int64)
    known, cols = np.unique(np.concatenate([x for x, _ in docs]), return_inverse=True)
    vals = SCALE * np.concatenate([c for _, c in docs])
    w = np.zeros(len(known) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.Generator(np.random.PCG64(seed))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    batches = max(1, min(BATCHES, len(pos)))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for p, u in zip(np.array_split(rng.permutation(pos), batches), np.array_split(rng.permutation(unl), batches)):
            rows = np.r_[p, u]
            size = ptr[rows + 1] - ptr[rows]
            at = np.repeat(ptr[rows] - np.cumsum(np.r_[0, size[:-1]]), size) + np.arange(int(size.sum()))
            local = np.repeat(np.arange(len(rows)), size)
            f = np.bincount(local, weights=w[cols[at]] * vals[at], minlength=len(rows)) + w[-1]
            fp, fu = f[: len(p)], f[len(p):]
            clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() if len(u) else 0.0
            g = np.zeros(len(rows))
            g_pos, g_unl = -prior * sig(fp) / max(len(p), 1), sig(fu) / max(len(u), 1)
            if clean >= 0:
                g[: len(p)] = -prior * sig(-fp) / len(p) + g_pos
                g[len(p):] = g_unl
            else:                                    # step back until the corrected risk is not negative
                g[: len(p)] = -g_pos
                g[len(p):] = -g_unl
            grad = np.bincount(cols[at], weights=g[local] * vals[at], minlength=len(w)).astype(float)
            grad[-1] = g.sum()
            grad[:-1] += DECAY * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << DIMS, np.float32)
    weights[known] = w[:-1]
    return weights, float(w[-1])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """All features of the training sample (toxic, features, counts), and the class prior.  Labels
    of held-out rows are never read."""
    marked = (labels.select("doc_id", "toxic").where(~held_out()).where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, toxic = marked.agg(F.count("*"), F.sum("toxic")).head()
    order = F.xxhash64("doc_id", F.lit("sample"))
    pos = marked.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    unl = (docs.select("doc_id").where(~held_out()).where("doc_id is not null").distinct()
           .orderBy(order, "doc_id").limit(max_unlabelled))
    ids = pos.withColumn("toxic", F.lit(True)).union(unl.withColumn("toxic", F.lit(False)))
    texts = (docs.select("doc_id", "text")
             .join(F.broadcast(ids), "doc_id")       # at most max_positive + max_unlabelled ids
             .dropDuplicates(["doc_id", "toxic"]).select("toxic", "text"))

    def run(batches):
        for b in batches:
            feats = []
            for rows, numbers, row in each_text(b.column(1)):
                by_row = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[by_row], np.arange(rows + 1))
                feats += [np.unique(numbers[by_row[cut[k]: cut[k + 1]]], return_counts=True) for k in range(rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f.astype(np.int32) for f, _ in feats], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, c in feats], pa.list_(pa.int32()))],
                ["toxic", "features", "counts"])

    prior = float(toxic or 0) / n if n else 0.0
    return texts.mapInArrow(run, "toxic boolean, features array<int>, counts array<int>"), prior


def telling(rows: DataFrame) -> np.ndarray:
    """Features whose share of documents differs between the two samples by MIN_Z standard errors;
    documents are counted by feature in Spark."""
    n = dict(rows.groupBy("toxic").count().collect())     # two rows
    n_pos, n_unl = max(n.get(True, 0), 1), max(n.get(False, 0), 1)
    share = (F.col("a") + F.col("b")) / (n_pos + n_unl)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_pos + 1 / n_unl))
    found = (rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
             .agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
             .where((F.greatest("a", "b") >= MIN_DOCS)
                    & (F.abs(F.col("a") / n_pos - F.col("b") / n_unl) >= MIN_Z * error)).select("feature"))
    return np.sort(found.toArrow().column(0).to_numpy())   # at most 2^DIMS numbers


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED):
    """(weights, constant), or None without a confirmed toxic document."""
    ready(docs.sparkSession)
    rows, prior = sample(docs, labels, max_positive, max_unlabelled)
    if prior == 0.0:
        return None
    rows = written(rows, "toxicity-sample")
    known = docs.sparkSession.sparkContext.broadcast(telling(rows))

    def shares(batches):
        for b in batches:
            out = []
            for f, c in zip(b.column(1), b.column(2)):
                f, c = f.values.to_numpy(), c.values.to_numpy()
                at = np.isin(f, known.value)
                out.append((f[at], c[at] / max(c.sum(), 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in out], pa.list_(pa.int32())),
                                              pa.array([v for _, v in out], pa.list_(pa.float64()))],
                                             ["toxic", "features", "shares"])

    # the model's features of the sampled documents: bounded by the sample
    got = rows.mapInArrow(shares, "toxic boolean, features array<int>, shares array<double>").toArrow()
    positive = np.array(got.column(0).to_pylist(), bool)
    pairs = [(f.values.to_numpy().astype(np.int64), v.values.to_numpy()) for f, v in zip(got.column(1), got.column(2))]
    # rows come in no fixed order; fix it, so that reruns fit the same model
    order = sorted(range(len(pairs)), key=lambda i: (positive[i], pairs[i][0].tobytes(), pairs[i][1].tobytes()))
    return fit([pairs[i] for i in order], positive[order], min(max(prior, 1e-4), 0.9))


def score(docs: DataFrame, labels: DataFrame, **bounds) -> Column:
    """A column of ``docs``: the probability that its text is toxic."""
    model = train(docs, labels, **bounds)
    if model is None:
        return F.lit(0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def toxic(text: pa.Array) -> pa.Array:
        return pa.array(scores_of(text, *held.value))

    return toxic(F.col("text"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    return docs.where(score(docs, labels) < threshold)
