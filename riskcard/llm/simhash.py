"""SimHash near-dedup with BK-trees.

A document's fingerprint has bit i set if more than half of its shingle hashes (XXH64, seed 42)
have it.  Documents link where fingerprints differ in at most ``bits`` bits; components of links
are the groups.

Equal fingerprints are one node.  The distinct fingerprints are dealt into shards: the 64 bits
are cut into ``bits + 2`` bands, and fingerprints within ``bits`` bits agree on two bands at
least, so each goes to one shard per pair of bands (15 for 4 bits) and every link lies inside
some shard.  Each shard has a BK-tree (children keyed by their integer Hamming distance to the
parent); searches follow only edges within the radius.  A shard's components are found by
searching from each fingerprint for those not reached yet: reached nodes stay as signposts, and
subtrees without unreached nodes are skipped, so a tight group of n costs about n, and n - 1
links leave the task, never all pairs.

A shard of more than ``tree_nodes`` fingerprints is dealt again on two bands of the bits not yet
used.  After three deals 18 free bits are left, so no tree can exceed 2^18 nodes.

A tree goes only to the rows of its shard (by the shuffle), not to every executor: sending every
tree to all rows would collect all fingerprints on the driver and compare all with all.

Defined cases: null or empty text and texts without words have fingerprint zero and link like
any other; texts shorter than a shingle are one shingle; repeated rows are rows of one group;
rows without doc_id take part, and a group of only such rows has component_id null; an empty
table gives no rows; only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskcard.llm import words as W
from riskcard.llm.common import agree, numbered, ready, row_key, written
from riskcard.llm.graph import components

SHINGLE = 4
BITS = 4
TREE_NODES = 20_000
DEALS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) per row."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def deal(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, mask, shard): one row per pair of bands of the bits not in ``mask``."""

    def run(batches):
        for b in batches:
            fp, mask, shard = (b.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask", "shard"))
            for m in np.unique(mask):
                at = np.flatnonzero(mask == m)
                free = np.array([i for i in range(64) if not int(m) >> i & 1])
                bands = [sum(1 << int(i) for i in x) for x in np.array_split(free, bits + 2)]
                for no, (x, y) in enumerate(combinations(bands, 2)):
                    key = W.mix(fp[at] & np.uint64(x | y)) + W.mix(shard[at] + np.uint64(no + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v.view(np.int64)) for v in
                         (fp[at], np.full(len(at), int(m) | x | y, np.uint64), W.mix(key))],
                        ["fp", "mask", "shard"])

    return rows.mapInArrow(run, "fp long, mask long, shard long")


class Tree:
    """BK-tree over distinct fingerprints; ``unreached[n]`` counts those of n's subtree."""

    def __init__(self, values: list[int]):
        self.values, self.children, self.parent = values, [{} for _ in values], [-1] * len(values)
        self.unreached, self.reached = [1] * len(values), [False] * len(values)
        for new in range(1, len(values)):
            node, v = 0, values[new]
            while True:
                self.unreached[node] += 1
                d = (v ^ values[node]).bit_count()
                child = self.children[node].get(d)
                if child is None:
                    self.children[node][d], self.parent[new] = new, node
                    break
                node = child

    def reach(self, node: int) -> None:
        self.reached[node] = True
        while node >= 0:
            self.unreached[node] -= 1
            node = self.parent[node]

    def near(self, v: int, radius: int) -> list[int]:
        """Unreached nodes within the radius, following only edges within it."""
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            if not self.unreached[node]:
                continue
            d = (v ^ self.values[node]).bit_count()
            if d <= radius and not self.reached[node]:
                found.append(node)
            child = self.children[node]
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in child:
                    stack.append(child[edge])
        return found


def tree_links(values: list[int], radius: int):
    """(member, first member) for the components of the values under the radius."""
    tree = Tree(values)
    for i, v in enumerate(values):
        if tree.reached[i]:
            continue
        tree.reach(i)
        queue = [i]
        while queue:
            for j in tree.near(values[queue.pop()], radius):
                tree.reach(j)
                queue.append(j)
                yield values[j], v


def shard_links(dealt: DataFrame, bits: int, tree_nodes: int) -> DataFrame:
    """Links (a, b) found in the shards; rows of shards too large for a tree come back in
    (fp, mask, shard)."""

    def run(batches):
        links, back = [], []
        cur, held, over = None, [], False     # the shard that may go on in the next batch

        def settle():
            if len(held) > 1 and not over:
                links.extend(tree_links([v for v, _ in held], bits))

        def emit(every):
            if len(links) + len(back) < every:
                return
            out = np.array([(a, b, 0, 0, 0) for a, b in links] + [(0, 0, *x) for x in back],
                           np.uint64).reshape(-1, 5).view(np.int64)
            links.clear()
            back.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(5)],
                                             ["a", "b", "fp", "mask", "shard"])

        for b in batches:
            fp, mask, shard = (b.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask", "shard"))
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            size = np.diff(np.r_[first, len(shard)])
            last = len(first) - 1
            for g in np.flatnonzero((size > 1) | (np.arange(len(first)) == 0) | (np.arange(len(first)) == last)):
                s, e = int(first[g]), int(first[g] + size[g])
                key = int(shard[s])
                if key != cur:
                    settle()
                    cur, held, over = key, [], False
                held += list(zip(fp[s:e].tolist(), mask[s:e].tolist()))
                if over or len(held) > tree_nodes:
                    over = True
                    back.extend((v, m, key) for v, m in held)
                    held = []
                if g != last:
                    settle()
                    cur, held, over = None, [], False
                yield from emit(50_000)
        settle()
        yield from emit(1)

    return (dealt.repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(run, "a long, b long, fp long, mask long, shard long"))


def near_links(nodes: DataFrame, bits: int = BITS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links between distinct fingerprints (column fp) that span the groups within ``bits`` bits."""
    rows, links = nodes.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("shard")), None
    for k in range(DEALS):
        most = tree_nodes if k < DEALS - 1 else 1 << 62
        out = written(shard_links(deal(rows, bits), bits, most), "shard-links")
        new = out.where("a <> b").select("a", "b")
        links = new if links is None else links.unionByName(new)
        rows = out.where("a = b").select("fp", "mask", "shard")
        if rows.isEmpty():
            break
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS,
                    tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), fp, root (smallest
    fingerprint of the group, as a signed number) and component_id (smallest doc_id of the group)."""
    ready(docs.sparkSession)
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("lo"))
    roots = components(near_links(nodes, bits, tree_nodes)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = nodes.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = nodes.join(groups, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The documents, all columns, one of each group: that with the smallest doc_id (of rows that
    share it, the one with the smallest text key)."""
    names, docs = docs.columns, numbered(docs, "doc_id", "text")
    groups = near_duplicates(docs, shingle, bits)
    kept = (groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"))
            .select(F.col("k.doc_id").alias("_kept_id"), F.col("k.text_key").alias("_kept_text"))
            .withColumn("_kept", row_key(F.col("_kept_id"), F.col("_kept_text"))))
    rows = docs.withColumn("_text", F.xxhash64("text")).withColumn("_row", row_key(F.col("doc_id"), F.col("_text")))
    same = agree(rows["doc_id"].cast("long"), kept["_kept_id"]) & agree(rows["_text"], kept["_kept_text"])
    # repeated rows agree in id and text: one of them stays
    return (rows.join(kept, (rows["_row"] == kept["_kept"]) & same).dropDuplicates(["_row", "_kept_id", "_kept_text"])
            .select(*[rows[c] for c in docs.columns]).toDF(*names))
