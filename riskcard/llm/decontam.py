"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents, a bounded shard of bytes at a time, into a suffix array over
words and binary-searches every suffix of the benchmark items in it, one word deeper per step.
A match counts when it holds a whole window: ``window`` consecutive item words, or the whole item
where it has fewer.  Suffixes that begin with the same window are searched as one, so each place of
a document is found once per window length, however often a passage repeats in the document, in an
item or in many items.  Covered words come from the places, items from the windows; for every
window the longest verbatim match at its first place in a document is reported, unless it is part
of the match one word before.

Only runs of words that the benchmark knows enter a suffix array: a suffix that starts with an
unknown word matches nothing.  The documents are scanned, never shuffled.  The benchmark side
is broadcast in blocks of about BLOCK_CHARS characters, one scan of the documents per block, so
what is broadcast does not grow with the benchmark (a single longer item is a block of its own).

Defined cases: null, empty or wordless documents have no words and no hits; items without words
match nothing; rows that share an item_id are that one item; items without an id mark words but
are not listed; repeated documents are judged one by one; an empty benchmark hits nothing; only
doc_id and text (item_id and text) are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskcard.llm import words as W
from riskcard.llm.common import merged_intervals, ready, slices, strings, written

WINDOW = 10
BLOCK_CHARS = 32_000_000

INTERVALS = "array<struct<start:int,end:int>>"
ITEMS = "array<long>"
MATCHES = "array<struct<item_id:long,item_pos:int,doc_pos:int,n_words:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_pos", pa.int32()),
                             ("doc_pos", pa.int32()), ("n_words", pa.int32())]))


def words_of(column):
    """Per bounded row range: (i, j, word hashes, first)."""
    data, offsets = strings(column)
    data = W.LOWER[data]
    for i, j in slices(offsets, W.CHUNK):
        part = data[offsets[i]: offsets[j]]
        starts, ends, first = W.spans(part, offsets[i: j + 1] - offsets[i], W.ALNUM)
        yield i, j, W.word_hashes(part, starts, ends, W.ALNUM), first


class Tests:
    """The benchmark suffixes of one block.  Suffixes with the same first window are one class: where
    its representative (smallest item_id, then position) starts, its window length, the class one
    word before it, and the items of all its suffixes."""

    def __init__(self, rows: list[tuple], window: int):
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        parts = [(i, h, first) for i, _, h, first in words_of(pa.array(texts, pa.string()))]
        items = [(ids[i + k], h[first[k]: first[k + 1]]) for i, h, first in parts for k in range(len(first) - 1)]
        items = sorted([(item, h) for item, h in items if len(h)], key=lambda x: (x[0] is None, x[0] or 0))
        self.vocab = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        seq, start, need, item_pos, owner, at = [], [], [], [], [], 0
        for k, (_, h) in enumerate(items):
            seq += [np.searchsorted(self.vocab, h) + 1, [0]]      # 0 ends an item
            w = min(window, len(h))
            pos = np.arange(len(h) - w + 1)
            start.append(at + pos)
            item_pos.append(pos)
            need.append(np.full(len(pos), w))
            owner.append(np.full(len(pos), k))
            at += len(h) + 1
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.seq = np.r_[join(seq), 0]
        start, need, item_pos, owner = join(start), join(need), join(item_pos), join(owner)
        cls, rep = window_classes(self.seq, start, need)
        before = np.where(item_pos > 0, np.r_[-1, cls[:-1]], -1)
        self.start, self.need, self.item_pos, self.before = start[rep], need[rep], item_pos[rep], before[rep]
        self.item = [items[k][0] for k in owner[rep].tolist()]
        # items of each class: item_ids[item_at[c]: item_at[c + 1]]
        known = np.array([item is not None for item, _ in items], bool)
        pairs = np.unique(np.c_[cls, owner][known[owner]], axis=0) if len(cls) else np.zeros((0, 2), np.int64)
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(rep) + 1))
        self.item_ids = np.array([items[k][0] for k in pairs[:, 1].tolist()], np.int64)
        self.shortest = int(self.need.min()) if len(rep) else 0


def window_classes(seq: np.ndarray, start: np.ndarray, need: np.ndarray):
    """(class of every window, first window of every class): windows of equal words have one class."""
    out = np.zeros((len(start), 3), np.int64)
    rank, k = seq, 1
    while k <= (int(need.max()) if len(need) else 0):
        at = (need >= k) & (need < 2 * k)           # two halves of k words, overlapping, cover the window
        out[at] = np.c_[need[at], rank[start[at]], rank[start[at] + need[at] - k]]
        nxt = np.r_[rank[k:], np.zeros(min(k, len(rank)), rank.dtype)]
        rank = np.unique(rank * np.int64(int(rank.max(initial=0)) + 2) + nxt, return_inverse=True)[1] + 1
        k *= 2
    _, rep, cls = np.unique(out, axis=0, return_index=True, return_inverse=True)
    return cls.reshape(-1), rep


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffixes, compared over ``depth`` words (prefix doubling)."""
    rank, k = seq, 1
    while k < depth:
        nxt = np.r_[rank[k:], np.zeros(min(k, len(rank)), rank.dtype)]
        rank = np.unique(rank * np.int64(max(len(seq), int(rank.max()) + 1) + 1) + nxt, return_inverse=True)[1] + 1
        k *= 2
        if int(rank.max()) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def bound(col, lo, hi, value, right: bool):
    """Vectorised binary search of ``value`` in ``col(position)`` over [lo, hi)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        v = col(np.where(open_, mid, 0))
        up = open_ & ((v <= value) if right else (v < value))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def numbers(tests: Tests, h: np.ndarray) -> np.ndarray:
    """The benchmark's numbers of word hashes, 0 for unknown words."""
    if not len(tests.vocab):
        return np.zeros(len(h), np.int64)
    at = np.searchsorted(tests.vocab, h)
    at[at == len(tests.vocab)] = 0
    return np.where(tests.vocab[at] == h, at + 1, 0)


def search(tests: Tests, number: np.ndarray, first: np.ndarray):
    """(class, place): where the windows of the benchmark stand in a shard of word ``numbers``."""
    none = np.zeros(0, np.int64)
    if not len(number) or not len(tests.start):
        return none, none
    known = number > 0
    fresh = np.ones(len(number), bool)                  # a run ends at unknown words and at texts' ends
    fresh[1:] = ~known[:-1]
    fresh[first[:-1][first[:-1] < len(number)]] = True
    run_start = np.flatnonzero(known & fresh)
    if not len(run_start):
        return none, none
    run_id = np.cumsum(known & fresh)
    run_len = np.bincount(run_id[known], minlength=len(run_start) + 1)[1:]
    keep = run_len >= tests.shortest
    run_start, run_len = run_start[keep], run_len[keep]
    if not len(run_start):
        return none, none
    out_start = np.cumsum(np.r_[0, run_len[:-1] + 1])   # runs one after the other, a 0 behind each
    seq = np.zeros(int((run_len + 1).sum()), np.int64)
    place = np.arange(int(run_len.sum())) - np.repeat(np.cumsum(np.r_[0, run_len[:-1]]), run_len)
    source = np.repeat(run_start, run_len) + place
    target = np.repeat(out_start, run_len) + place
    seq[target] = number[source]
    origin = np.zeros(len(seq), np.int64)
    origin[target] = source
    depth = int(tests.need.max())
    order = suffix_array(seq, depth)
    padded = np.r_[seq, np.zeros(depth + 1, np.int64)]
    live = np.arange(len(tests.start))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(order))
    found_t, found_l = [], []
    for d in range(depth):
        col = lambda p, d=d: padded[order[p] + d]
        want = tests.seq[tests.start[live] + d]
        a = bound(col, lo, hi, want, False)
        b = bound(col, a, hi, want, True)
        ok = a < b
        live, lo, hi = live[ok], a[ok], b[ok]
        full = tests.need[live] == d + 1
        if full.any():
            n = (hi - lo)[full]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(np.r_[0, n[:-1]]), n)
            found_t.append(np.repeat(live[full], n))
            found_l.append(order[np.repeat(lo[full], n) + inner])
            live, lo, hi = live[~full], lo[~full], hi[~full]
        if not len(live):
            break
    if not found_t:
        return none, none
    # a class has one window length, and two classes of one length share no place
    return np.concatenate(found_t), origin[np.concatenate(found_l)]


def judged(column, tests: Tests):
    """Per row of a text column: (n_words, hit intervals, items, longest matches)."""
    for i, j, h, first in words_of(column):
        number = numbers(tests, h)
        cls, loc = search(tests, number, first)
        row = np.searchsorted(first, loc, "right") - 1
        # words inside any window
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, loc, 1)
        np.add.at(cover, loc + tests.need[cls], -1)
        on = np.cumsum(cover[:-1]) > 0
        # the first place of each window in each row
        by = np.lexsort((loc, cls, row))
        cls, loc, row = cls[by], loc[by], row[by]
        new = np.r_[True, (row[1:] != row[:-1]) | (cls[1:] != cls[:-1])] if len(by) else np.zeros(0, bool)
        # the items of a row are those of its windows
        c, r = cls[new], row[new]
        size = tests.item_at[c + 1] - tests.item_at[c]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        found = np.unique(np.c_[np.repeat(r, size), tests.item_ids[np.repeat(tests.item_at[c], size) + inside]], axis=0)
        item_cut = np.searchsorted(found[:, 0], np.arange(j - i + 1))
        # a match that begins one word before holds this one
        key = cls * (len(h) + 1) + loc
        left = tests.before[cls] * (len(h) + 1) + loc - 1
        head = np.flatnonzero(new & ~((tests.before[cls] >= 0) & (loc > first[row]) & np.isin(left, key)))
        t, at, n, stop = cls[head], loc[head], tests.need[cls[head]].copy(), first[row[head] + 1]
        grow = np.arange(len(t))
        while len(grow):                                # longest verbatim match from here
            x = tests.seq[tests.start[t[grow]] + n[grow]]
            p = at[grow] + n[grow]
            ok = (x != 0) & (p < stop[grow]) & (x == number[np.minimum(p, len(number) - 1)])
            grow = grow[ok]
            n[grow] += 1
        cut = np.searchsorted(row[head], np.arange(j - i + 1))
        for k in range(j - i):
            base, end = int(first[k]), int(first[k + 1])
            if cut[k] == cut[k + 1] and item_cut[k] == item_cut[k + 1] and not on[base:end].any():
                yield end - base, [], [], []
                continue
            step = np.flatnonzero(np.diff(on[base:end].astype(np.int8), prepend=0, append=0)).tolist()
            yield (end - base, [{"start": a, "end": b} for a, b in zip(step[::2], step[1::2])],
                   found[item_cut[k]: item_cut[k + 1], 1].tolist(),
                   [{"item_id": tests.item[t[x]], "item_pos": int(tests.item_pos[t[x]]), "doc_pos": int(at[x]) - base,
                     "n_words": int(n[x])} for x in range(cut[k], cut[k + 1])])


def blocks(benchmark: DataFrame, window: int, block_chars: int):
    """Broadcasts of the benchmark's suffixes, block by block, each of a bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text") + 1)).head()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = [tuple(r) for r in items.where(F.col("text").isNotNull() & (part == k)).distinct().collect()]
        yield spark.sparkContext.broadcast(Tests(rows, window))


def block_matches(docs: DataFrame, tests, only_hit: bool) -> DataFrame:

    def run(batches):
        for b in batches:
            rows = list(judged(b.column(1), tests.value))
            keep = [i for i, r in enumerate(rows) if r[1] or not only_hit]
            rows = [rows[i] for i in keep]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), b.column(2).take(pa.array(keep, pa.int64())),
                 pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _SPAN),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], _MATCH)],
                ["doc_id", "text_key", "n_words", "hit", "items", "matches"])

    return docs.mapInArrow(run, f"doc_id long, text_key long, n_words long, hit {INTERVALS}, items {ITEMS}, "
                                f"matches {MATCHES}")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, ``hit`` (maximal word intervals inside window
    occurrences), ``items`` (items with a window in it) and ``matches`` (longest verbatim matches:
    item_id, item_pos, doc_pos, n_words)."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    out, more = None, []
    for tests in blocks(benchmark, window, block_chars):
        if out is None:
            out = block_matches(docs, tests, only_hit=False)
        else:
            more.append(written(block_matches(docs, tests, only_hit=True), "benchmark-block"))
    if more:
        rest = more[0]
        for m in more[1:]:
            rest = rest.unionByName(m)
        rest = rest.distinct().groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
            F.flatten(F.collect_list("hit")).alias("h"), F.flatten(F.collect_list("items")).alias("i"),
            F.flatten(F.collect_list("matches")).alias("m"))
        out = out.join(rest, out.doc_id.eqNullSafe(rest.d) & (out.text_key == rest.k), "left").select(
            "doc_id", "n_words",
            merged_intervals(F.concat("hit", F.coalesce("h", F.array().cast(INTERVALS)))).alias("hit"),
            F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast(ITEMS)))).alias("items"),
            F.concat("matches", F.coalesce("m", F.array().cast(MATCHES))).alias("matches"))
    return out.select("doc_id", "n_words", "hit", "items", "matches")


def item_list() -> Column:
    """The items of a document as text, in that order."""
    return F.array_sort(F.transform("items", lambda x: x.cast("string")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window."""
    ready(docs.sparkSession)
    at, first = docs.columns.index("text"), True
    for tests in blocks(benchmark, window, block_chars):
        def run(batches, tests=tests):
            for b in batches:
                clean = [not hit for _, hit, _, _ in judged(b.column(at), tests.value)]
                yield b.filter(pa.array(clean, pa.bool_()))
        docs = (docs if first else written(docs, "benchmark-clean")).mapInArrow(run, docs.schema)
        first = False
    return docs
