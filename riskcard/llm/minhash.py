"""Document fingerprints by MinHash.

*Fingerprint.*  Words (runs without white space, A-Z lower-cased) form shingles of SHINGLE words, a
shorter text is one shingle.  PERMUTATIONS universal hash functions a x + b over the shingle hashes
are evaluated in numpy; the smallest value of each is kept, 16 mixed bits of it in the printed
fingerprint.  The likeness of two fingerprints is the share of equal places, an estimate of the
Jaccard similarity of the shingle sets.

*Classes.*  Documents whose shingle sets have a Jaccard similarity of SIMILARITY or more link;
components of links are classes.  Equal sets are one node.  BANDS groups of ROWS minima are joined:
nodes that agree in one share a bucket.  In every bucket all nodes are compared, exactly, with a leader
first: the node that meets most others over all its buckets, for a group of edited copies one of the
least edited, which links with most of them.  A bucket whose nodes are then in one component is done; in
the others the leader goes and the next round takes LEADERS of them by hash, then LEADERS times as many, all
where a bucket has no more than the round takes, until no bucket holds two
components that were not compared.  A tight group of n costs about n comparisons, never all pairs,
and no bucket is ever gathered: one of more than CROWD nodes is dealt over several tasks.  No bucket is
cut.  Two texts of similarity 0.8 share a bucket with a chance of 99.8%.

*Order of comparisons.*  After the first round a pair is made in one bucket only, that of the first band in
which both agree.  Before two texts are compared exactly, their sizes and parities are: every shingle of a set
turns one of PARITY bits, so the bits in which two sets differ are at most the shingles that only one
of them has, and SIMILARITY bounds these.  A pair beyond that bound is no link, for certain; what is left
of texts of up to 1,500 words are mostly links.  Of those, pairs whose sketches (BITS bits of every minimum)
agree in as many places as similarity SIMILARITY explains (less DOUBT standard deviations) are compared
first; the others where their texts are still in different components.

*Edited texts.*  The second half of a text is replaced by the beginning of the next document, in
descending order of doc_id.  Ranges of ids are dealt to tasks by an id computed from the edges (so a
recomputed task gets the same rows); the first document of every range goes to the range before it
too.  Texts cross that shuffle packed, once.

Defined cases: null texts count as empty; texts without words have a fingerprint of their own and
are one class; rows without doc_id follow the smallest id, and a class of only such rows has
class_id null; rows with equal doc_id follow one another by the hash of their texts, repeated rows
have the same class; a single document is its own next one; an empty table gives no rows; only
doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskcard.llm import words as W
from riskcard.llm.common import few, forget, ready, slices, strings, written
from riskcard.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
PERMUTATIONS = 128
BANDS, ROWS = 21, 6
BLOCK = 1 << 15          # shingles hashed at a time
LEADERS = 64             # leaders of a bucket grow by this factor a round
CROWD = 4096             # nodes of a bucket that one task compares with its leaders
PARITY = 1024            # bits of a set that its shingles turn
CELLS = 26               # at most 2**CELLS bits tell which texts cross the shuffle for exact comparison
BITS = 4                 # bits of every minimum in a sketch
DOUBT = 3                # standard deviations by which a sketch may fall short
TEXTS = 2000             # texts, or pairs of texts, of a task at least

_RANDOM = np.random.Generator(np.random.PCG64(20240301))
_A = _RANDOM.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_FACTOR = _RANDOM.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(hashes, first): the shingle hashes of all texts, those of text d at first[d]: first[d + 1]."""
    low = W.LOWER[data]
    starts, ends, first = W.spans(low, offsets, W.NOT_SPACE)
    h = W.word_hashes(low, starts, ends, W.NOT_SPACE)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_first = np.r_[0, np.cumsum(count)]
    out = np.zeros(out_first[-1], np.uint64)
    full = W.rolling(h, size)
    inside = np.arange(len(out)) - np.repeat(out_first[:-1], count)
    at = np.repeat(first[:-1], count) + inside
    long = np.repeat(n >= size, count)
    out[long] = full[at[long]]
    for k in range(1, size):                 # texts of k words
        few = np.flatnonzero(n == k)
        if len(few):
            out[out_first[few]] = W.mix(W.rolling(h, k)[first[few]] + np.uint64(k))
    return out, out_first


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The smallest value of every permutation for each text (texts x PERMUTATIONS)."""
    out = np.full((len(first) - 1, PERMUTATIONS), ~np.uint64(0))
    x = hashes >> np.uint64(32)
    value = np.empty(min(BLOCK, len(x)), np.uint64)
    for i in range(0, len(x), BLOCK):
        j = min(i + BLOCK, len(x))
        # the texts that have shingles in this block, and where these begin in it
        docs = np.arange(np.searchsorted(first, i, "right") - 1, np.searchsorted(first, j, "left"))
        docs = docs[first[docs + 1] > np.maximum(first[docs], i)]
        at, part = np.maximum(first[docs], i) - i, value[: j - i]
        for k in range(PERMUTATIONS):
            np.multiply(x[i:j], _A[k], out=part)
            np.add(part, _ADD[k], out=part)
            out[docs, k] = np.minimum(out[docs, k], np.minimum.reduceat(part, at))
    return out


def sketches(column) -> np.ndarray:
    """Minima of the texts of an Arrow column, a bounded number of bytes at a time."""
    data, offsets = strings(column)
    parts = [minima(*shingles(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]))
             for i, j in slices(offsets, W.CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint64)


def places(mins: np.ndarray) -> np.ndarray:
    """The 16 bits of every minimum that the fingerprint shows."""
    return (W.mix(mins) >> np.uint64(48)).astype(">u2")


def printed(marks: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in marks]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def bands(mins: np.ndarray) -> np.ndarray:
    """One number per band of each text."""
    use = W.mix(mins[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)) * _FACTOR
    return W.mix(use.sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :])


def sketch(mins: np.ndarray) -> np.ndarray:
    """The first BITS bits of every place, packed into PERMUTATIONS * BITS / 64 numbers per text."""
    marks = (W.mix(mins) >> np.uint64(64 - BITS)).reshape(len(mins), -1, 64 // BITS)
    return (marks << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def fewest(similarity: float) -> int:
    """The places in which the sketches of two texts of that similarity agree at least."""
    p = similarity + (1 - similarity) / 2**BITS
    return int(PERMUTATIONS * p - DOUBT * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def alike(a: str, b: str, similarity: float):
    """Condition on two sketch columns: they agree in enough places."""
    differ = F.lit(0)
    low = sum(1 << k for k in range(0, 60, BITS))              # the lowest bit of every place but the last
    for k in range(PERMUTATIONS * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for step in (1, 2):                                    # every bit of a place into its lowest one
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ += F.bit_count(x.bitwiseAND(F.lit(low | 1 << 60)))
    return differ <= PERMUTATIONS - fewest(similarity)


def parities(sets: list) -> np.ndarray:
    """PARITY bits of each set of hashes, packed: bit b is set if an odd number of hashes fall on it."""
    out = np.zeros((len(sets), PARITY // 64), np.uint64)
    for row, hashes in zip(out, sets):
        at = W.mix(hashes) % np.uint64(PARITY)
        np.bitwise_xor.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def possible(a: str, b: str, size_a: str, size_b: str, similarity: float):
    """Condition on two columns of parities and two of set sizes: false only where the Jaccard similarity of
    the sets is below ``similarity``."""
    most = (F.col(size_a) + F.col(size_b)) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    bits = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY // 64)]
    return (F.abs(F.col(size_a) - F.col(size_b)) <= most) & (sum(bits[1:], bits[0]) <= most)


def first_shared(a: str, b: str, band):
    """Condition on two columns of band marks: they agree in no band before ``band``."""
    same = [(F.get(a, F.lit(k)) == F.get(b, F.lit(k))) & (band > k) for k in range(BANDS - 1)]
    every = F.lit(False)
    for x in same:
        every = every | x
    return ~every


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (hash of the shingle set), its size, bands, sketch and parities of every document."""

    def run(batches):
        for b in batches:
            data, offsets = strings(b.column(1))
            nodes, sizes, found, small, odd = [], [], [], [], []
            for i, j in slices(offsets, W.CHUNK):
                h, first = shingles(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                sets = [np.unique(h[x:y]) for x, y in zip(first[:-1], first[1:])]
                nodes += [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True)
                          for x in sets]
                sizes += [len(x) for x in sets]
                mins = minima(h, first)
                found.append(bands(mins).view(np.int64))
                small.append(sketch(mins))
                odd.append(parities(sets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 *(_lists(x, len(b)) for x in (found, small, odd))],
                ["doc_id", "text_key", "node", "size", "bands", "sketch", "odd"])

    ready(docs.sparkSession)
    return _docs(docs).mapInArrow(run, "doc_id long, text_key long, node long, size long, bands array<long>, "
                                       "sketch array<long>, odd array<long>")


def _lists(parts: list, rows: int) -> pa.Array:
    flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (len(flat) // max(rows, 1)), pa.int32()), pa.array(flat))


def _packed(docs: DataFrame, wanted: tuple | None = None) -> DataFrame:
    """(doc_id, text_key, packed): texts compressed; with the ``_cells`` of some text_keys few others than theirs."""

    def run(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for b in batches:
            if wanted is not None:
                cell = b.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - wanted[0])
                held = wanted[1][(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))
                b = b.filter(pa.array((held & np.uint64(1)) == 1))
            packed = [pack(t.encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())],
                                             ["doc_id", "text_key", "packed"])

    return _docs(docs).mapInArrow(run, "doc_id long, text_key long, packed binary")


def _cells(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(b, bits): 2**b bits, about eight a row and at most 2**CELLS; those of the first b bits of every text_key
    are set.  An exact join follows, so that beyond 2**CELLS more texts cross, never fewer."""
    b = max(6, min(CELLS, (8 * keys.count()).bit_length()))
    cell = keys.select(F.shiftrightunsigned("text_key", 64 - b).alias("cell"))
    words = (cell.groupBy(F.expr("cell div 64").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits")).toArrow())
    bits = np.zeros(2**b // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return b, bits


def unpacked(column) -> pa.Array:
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x).decode() for x in column.to_pylist()], pa.string())


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b) pairs of nodes those whose shingle sets have at least that Jaccard similarity."""

    def run(batches):
        for b in batches:
            sets = []
            for c in (2, 3):
                h, first = shingles(*strings(unpacked(b.column(c))))
                sets.append([np.unique(h[x:y]) for x, y in zip(first[:-1], first[1:])])
            keep = []
            for x, y in zip(*sets):
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                keep.append(common >= similarity * union)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, marks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): the class of every node of ``marks`` (a written table of ``prints``)."""
    # bands of one row of each node; equal sets have equal bands
    each = (marks.groupBy("node").agg(F.min("bands").alias("bands"))
            .select("node", F.posexplode("bands").alias("band", "bucket")))
    # k: nodes of the bucket; weight: the nodes that a node meets, over its (at most BANDS) buckets
    # at most so many rows has the table that is made next
    rows = marks.count()
    members = written(few(each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("k > 1")
                      .withColumn("weight", F.sum("k").over(Window.partitionBy("node"))), BANDS * rows), "members")
    if members.isEmpty():
        return marks.select("node", F.col("node").alias("label")).distinct()
    # 32 bits of every band, the parities and the sketch of each node that shares a bucket
    known = written(few(marks.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("text_key", "size", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands"),
                       "odd", "sketch")).alias("m")).select("node", "m.*"), rows, 5 * TEXTS), "known")
    nodes, rows = known.count(), members.count()
    # one text of each
    keys = known.select("text_key", "node")
    texts = written(few(_packed(docs, _cells(keys)).select("text_key", "packed").dropDuplicates(["text_key"])
                        .join(keys, "text_key").select("node", "packed"), nodes, TEXTS), "node-texts")
    known = known.drop("text_key")
    lead_known = known.toDF("a", "lead_size", "lead_bands", "lead_odd", "lead_sketch")
    close = possible("odd", "lead_odd", "size", "lead_size", similarity)
    likely = alike("sketch", "lead_sketch", similarity).alias("likely")

    # the first round: every node with the leader of each of its buckets
    first = members.groupBy("bucket").agg(F.max(F.struct("weight", "node", "k")).alias("m"))
    tasks = F.ceil(F.col("m.k") / CROWD).cast("int")
    lead = first.select("bucket", F.col("m.node").alias("a"), F.explode(F.sequence(F.lit(1), tasks)).alias("task"))
    dealt = members.withColumn("task", _task(F.ceil(F.col("k") / CROWD)))
    met = dealt.join(lead, ["bucket", "task"]).where("a <> node").select(F.least("a", "node").alias("a"),
                                                                      F.greatest("a", "node").alias("node")).distinct()
    pairs = written(few(met.join(lead_known, "a").join(known, "node").where(close)
                        .select("a", F.col("node").alias("b"), likely), rows), "pairs")
    labels, parts = _linked(pairs, texts, None, similarity), LEADERS
    forget(pairs)
    while True:
        live = _labelled(members, labels, "node", "label").select("bucket", "band", "weight", "node", "label")
        mixed = live.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                           F.count(F.lit(1)).alias("k"), F.max(F.struct("weight", "node")).alias("m"))
        mixed = written(few(mixed.where("lo < hi").select("bucket", "k", F.col("m.node").alias("led")), rows), "mixed-buckets")
        live = live.join(mixed, "bucket")
        if parts == LEADERS:                     # the leaders of the first round have met all
            live = live.where("node <> led")
        # every node leads where the round has leaders enough, else a share of them by hash
        leads = (F.col("k") <= parts) | (F.pmod(F.xxhash64("node", F.lit(parts)), "k") < parts)
        live = written(few(live.select("bucket", "band", "weight", "node", "label",
                                   F.ceil(F.col("k") / CROWD).cast("int").alias("tasks"), leads.alias("leads")), rows), "live")
        done = [members, mixed, live]
        if live.isEmpty():
            break
        new = (F.col("label") != F.col("la")) & (~F.col("leads") | (F.col("a") < F.col("node"))) & close  # two leaders meet once
        new &= first_shared("bands", "lead_bands", F.col("band"))
        lead = (live.where("leads").select("bucket", F.col("node").alias("a"), F.col("label").alias("la"),
                                           F.explode(F.sequence(F.lit(1), "tasks")).alias("task")).join(lead_known, "a"))
        dealt = live.withColumn("task", _task(F.col("tasks"))).drop("tasks")
        pairs = written(few(dealt.join(known, "node").join(lead, ["bucket", "task"]).where(new)
                            .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), likely).distinct(),
                            rows), "pairs")
        labels = _linked(pairs, texts, labels, similarity)
        members = written(live.where("not leads").select("bucket", "band", "weight", "node"), "members")
        forget(*done, pairs)
        parts *= LEADERS
    return _labelled(marks.select("node").distinct(), labels, "node", "label")


def _task(tasks):
    """The one of a bucket's tasks that a node is compared in."""
    return 1 + F.pmod(F.xxhash64("node", F.lit(1)), tasks).cast("int")


def _linked(pairs: DataFrame, texts: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame | None:
    """``labels`` with the components that the links among ``pairs`` join, likely ones first."""
    for likely in (True, False):
        some = pairs.where(F.col("likely") == likely).select("a", "b")
        if not likely and labels is not None:
            some = _labelled(_labelled(some, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b")
        if some.isEmpty():
            continue
        new = written(few(similar(some, texts, similarity), some.count(), TEXTS), "links")
        if not new.isEmpty():
            # what is known of the components stands for the links before
            links = new if labels is None else new.unionByName(labels.toDF("a", "b"))
            labels = components(links)
    return labels


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, label: str) -> DataFrame:
    """``rows`` with the class of their ``node`` as far as it is known: itself where no link is."""
    if labels is None:
        return rows.withColumn(label, F.col(node))
    return (rows.join(labels.toDF(node, "root_"), node, "left").withColumn(label, F.coalesce("root_", node))
            .drop("root_"))


def class_ids(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key and class_id (smallest doc_id of the class) of every distinct (doc_id, text)."""
    marks = written(prints(docs), "prints")
    n = marks.count()
    labelled = written(few(classes(docs, marks, similarity), n), "classes")
    rows = marks.join(labelled, "node").select("doc_id", "text_key", "label")
    least = written(few(rows.groupBy("label").agg(F.min("doc_id").alias("class_id")), n), "least-ids")
    return few(rows.join(least, "label").select("doc_id", "text_key", "class_id").distinct(), n)


def _ranges(rows: DataFrame, spark: SparkSession) -> np.ndarray:
    """Edges of ranges of ids, one less than there are shuffle partitions."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n == 1:
        return np.zeros(0, np.int64)
    edges = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0]
    return np.unique(np.array(edges or [], np.int64))


def _number(ids, edges: np.ndarray) -> np.ndarray:
    """Range of each id, 0 the range of the largest ids; rows without id are in the last one."""
    null = np.asarray(ids.is_null())
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(null, len(edges), len(edges) - np.searchsorted(edges, values, "left"))


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, class_id long")


def fingerprints(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint, class_id, and for its edited text
    edited_sha256, edited_fingerprint, near_edited; near_next is the likeness to the next document."""
    spark = docs.sparkSession
    known = written(class_ids(docs, similarity), "class-ids")
    edges = _ranges(known, spark)

    def numbered(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_number(b.column(0), edges).astype(np.int32))],
                                             [*b.schema.names, "range"])

    known = known.mapInArrow(numbered, "doc_id long, text_key long, class_id long, range int")
    order = F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "text_key")
    first = {r.range: (r.m.doc_id, r.m.text_key) for r in
             known.groupBy("range").agg(F.min(F.struct(order.alias("o"), "doc_id", "text_key")).alias("m")).collect()}
    filled = sorted(first)
    # (doc_id, text_key) -> the range that it follows
    after = {first[r]: filled[k - 1] for k, r in enumerate(filled)}

    def dealt(batches):
        for b in batches:
            number, keys = _number(b.column(0), edges), list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            tails = [k for k, key in enumerate(keys) if key in after]
            take = pa.array([*range(len(b)), *tails], pa.int64())
            rows = b.take(take)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([*number.tolist(), *(after[keys[k]] for k in tails)], pa.int32()),
                 pa.array([False] * len(b) + [True] * len(tails))], [*b.schema.names, "range", "tail"])

    texts = _packed(docs).mapInArrow(dealt, "doc_id long, text_key long, packed binary, range int, tail boolean")
    rows = texts.withColumn("class_id", F.lit(None).cast("long")).unionByName(
        known.select("doc_id", "text_key", F.lit(None).cast("binary").alias("packed"), "range",
                     F.lit(False).alias("tail"), "class_id"))

    def run(batches):
        last, last_mins = [], np.zeros((0, PERMUTATIONS), np.uint64)   # the row that waits for the next one
        ended, named = None, (None, None, None)
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            ranges, tail, cls = (b.column(k).to_pylist() for k in (3, 4, 5))
            at = []
            for k, is_text in enumerate(b.column(2).is_valid().to_pylist()):
                if not is_text:
                    named = ids[k], keys[k], cls[k]
                elif not (tail[k] and ended == ranges[k]):      # one tail closes a range
                    at.append((k, named[2] if named[:2] == (ids[k], keys[k]) else None))
                    ended = ranges[k] if tail[k] else None
            texts = unpacked(b.column(2).take(pa.array([k for k, _ in at], pa.int64())))
            held = last + [(ids[k], t, c, tail[k]) for (k, c), t in zip(at, texts.to_pylist())]
            mins = np.concatenate([last_mins, sketches(texts)])
            own = np.array([k for k, x in enumerate(held[:-1]) if not x[3]], np.int64)
            made = [edited(held[k][1], held[k + 1][1]) for k in own]
            a, c, e = places(mins[own]), places(mins[own + 1]), places(sketches(pa.array(made, pa.string())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k in own], pa.int64()), pa.array([len(held[k][1]) for k in own], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in made], pa.string()),
                 pa.array(printed(a), pa.string()), pa.array(printed(e), pa.string()),
                 pa.array(likeness(a, e)), pa.array(likeness(a, c)),
                 pa.array([held[k][2] for k in own], pa.int64())], [c.split()[0] for c in OUT.split(", ")])
            last, last_mins = held[-1:], mins[-1:]

    return (rows.repartitionById(len(edges) + 1, F.col("range"))
            .sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "text_key",
                                  F.col("packed").isNotNull())
            .mapInArrow(run, OUT))
