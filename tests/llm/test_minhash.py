"""MinHash fingerprints and classes against exact shingle sets."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskcard.llm import minhash as M

SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    words = (text or "").translate(LOWER).encode().split()
    return {b" ".join(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def class_of(rows, similarity=0.8):
    """Smallest id of the component of each row, over all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def near_copies(n, words=120, seed=1):
    """A tight group: copies of one text with a few words changed."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        copy[rnd.randrange(words)] = f"v{rnd.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def check(rows, got):
    """``rows``: (doc_id, text) with distinct ids."""
    order = sorted([(d, t or "") for d, t in rows], key=lambda r: -r[0])
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingle_set(t), shingle_set(edited))) < 0.25
        assert abs(r.near_next - jaccard(shingle_set(t), shingle_set(following))) < 0.25
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)


@pytest.mark.parametrize("partitions", ["8", "1"])
def test_matches_shingle_sets(spark, partitions):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in M.fingerprints(docs.repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, got)
    assert [got[d].class_id for d, _ in rows] == class_of(rows)
    sets = {}
    for d, t in rows:
        sets.setdefault(got[d].fingerprint, set()).add(frozenset(shingle_set(t)))
    assert all(len(x) == 1 for x in sets.values())


def test_classes_of_tight_and_mixed_groups(spark):
    """Groups of near copies, texts that share half their words, and copies: classes equal all pairs."""
    half = near_copies(1, 60, 3)[0]
    texts = near_copies(60) + near_copies(25, 90, 2) + [half + " " + t for t in near_copies(8, 60, 4)]
    texts += [half + " " + near_copies(1, 70, 10 + k)[0] for k in range(12)] + [texts[0]] * 5
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in M.class_ids(docs).collect()}
    assert [got[d] for d, _ in rows] == class_of(rows)


def test_awkward_rows(spark):
    """Nulls, empty and long texts, repeated ids and rows, rows without id, and names used inside."""
    rows = [(1, None, "x"), (2, "", "y"), (3, "one", None), (3, "one", None), (3, "two words", "x"),
            (None, "no id", "x"), (None, "no id either", "x"), (5, "wor d " * 30_000, "x"), (6, "日本語 \U0001f642", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string").withColumnRenamed("range", "packed")
    got = M.fingerprints(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((d or 0, len(t or "")) for d, t, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].class_id == by_id[2].class_id == 1 and by_id[1].fingerprint == by_id[2].fingerprint
    assert {r.class_id for r in got if r.doc_id is None} == {None}
    assert by_id[6].near_next < 1 and by_id[2].near_next == 1.0 and by_id[1].near_next == 0.0


def test_single_and_empty(spark):
    one = M.fingerprints(spark.createDataFrame([(7, "abcdef gh")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next, r.class_id) for r in one] == [(7, 9, 1.0, 7)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdeabcd").hexdigest()
    assert M.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minima_do_not_depend_on_blocks(monkeypatch):
    texts = pa.array([" ".join(near_copies(1, n, n)) for n in (1, 3, 4, 5, 6, 300, 2)] + ["", None])
    whole = M.sketches(texts)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert (M.sketches(texts) == whole).all()
    assert (whole[-1] == ~np.uint64(0)).all()


def test_crowded_buckets_are_dealt_again(spark, monkeypatch):
    """Many texts that are alike but below the similarity, with a few pairs above it among them."""
    monkeypatch.setattr(M, "CROWD", 4)
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(100)]
    texts = []
    for k in range(40):
        copy = list(base)
        for at in rnd.sample(range(100), 5):
            copy[at] = f"v{k}-{at}"
        texts.append(" ".join(copy))
    texts += [t + " end" for t in texts[:6]]
    rows = [(500 - k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in M.class_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == class_of(rows)


def test_sketches_agree_like_the_places(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    mins = rng.integers(0, 2**64, (40, M.PERMUTATIONS), dtype=np.uint64)
    for k in range(1, 40):                                  # row k shares k * 3 minima with row 0
        mins[k, : 3 * k] = mins[0, : 3 * k]
    marks = (M.W.mix(mins) >> np.uint64(64 - M.BITS))
    rows = [(k, x, y) for k, (x, y) in enumerate(zip([M.sketch(mins)[0].tolist()] * 40,
                                                     M.sketch(mins).tolist()))]
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>")
    for similarity in (0.3, 0.8, 1.0):
        want = [k for k in range(40) if (marks[k] == marks[0]).sum() >= M.fewest(similarity)]
        got = df.where(M.alike("x", "y", similarity)).select("k").collect()
        assert sorted(r.k for r in got) == want and 0 in want


def test_no_link_of_a_crowded_bucket_is_left_out(spark, monkeypatch):
    """One band only, so no second one agrees: every pair of a crowded bucket of loose texts is judged."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(100)]
    texts = []
    for k in range(60):
        copy = list(base)
        for at in rnd.sample(range(100), 2):
            copy[at] = f"v{k}-{at}"
        texts.append(" ".join(copy))
    texts += [t + " end" for t in texts[:30]]
    band = M.bands(M.sketches(pa.array(texts)))[:, 0].tolist()
    docs = spark.createDataFrame([(500 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(M, "CROWD", 4)
    monkeypatch.setattr(M, "BANDS", 1)
    marks = M.written(M.prints(docs).withColumn("bands", F.slice("bands", 1, 1)), "prints")
    label = {r.doc_id: r.label for r in marks.join(M.classes(docs, marks), "node").select("doc_id", "label").collect()}
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if band[i] == band[j] and jaccard(sets[i], sets[j]) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    assert max(band.count(x) for x in band) > 10
    for i in range(len(texts)):
        for j in range(i):
            assert (label[500 - i] == label[500 - j]) == (root[i] == root[j])


def test_parities_never_exclude_a_link(spark):
    """Sets of 1 to 6,000 hashes: the bound holds for every pair at the similarity, and excludes most far below it."""
    rng = np.random.Generator(np.random.PCG64(9))
    rows, sets = [], []
    for n in (1, 2, 5, 9, 40, 300, 900, 6_000):
        pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        for common in (1.0, 0.95, 0.9, 0.889, 0.8, 0.6, 0.3):
            take = int(n * common)
            sets.append((pool[:n], np.r_[pool[:take], pool[n: 2 * n - take]]))
    x, y = (M.parities([np.unique(s[k]) for s in sets]).tolist() for k in (0, 1))
    for k, (a, b) in enumerate(sets):
        both = len(np.intersect1d(a, b))
        rows.append((k, x[k], y[k], len(a), len(b), both / (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>, m long, n long, j double")
    got = df.select("m", "j", M.possible("x", "y", "m", "n", 0.8).alias("p")).collect()
    assert all(r.p for r in got if r.j >= 0.8) and sum(r.j >= 0.8 for r in got) > 15
    assert not any(r.p for r in got if r.j < 0.5 and 40 <= r.m <= 900)


def loose(n, changed, seed):
    """Copies of one text of 100 words with some words changed."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(100)]
    out = []
    for k in range(n):
        copy = list(base)
        for at in rnd.sample(range(100), changed):
            copy[at] = f"v{k}-{at}"
        out.append(" ".join(copy))
    return out


def test_two_rounds_and_few_files_for_small_tables(spark, monkeypatch):
    """Buckets of up to LEADERS nodes are settled by the second round, and tables of few rows are not written as
    one file for each of many shuffle partitions."""
    texts = loose(45, 4, 11) + near_copies(30)
    rows = [(500 - k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tables, write = [], M.written

    def noted(df, name):
        out = write(df, name)
        tables.append((name, len(out.inputFiles())))
        return out
    monkeypatch.setattr(M, "written", noted)
    monkeypatch.setitem(M.components.__globals__, "written", noted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.class_id for r in M.class_ids(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [got[d] for d, _ in rows] == class_of(rows)
    assert sum(name == "pairs" for name, _ in tables) <= 2
    assert all(files <= 16 for name, files in tables if name not in ("prints", "edges")), tables


@pytest.mark.parametrize("leaders", [2, 5])
def test_many_rounds_leave_no_link_out(spark, monkeypatch, leaders):
    """Buckets of more nodes than a round has leaders: those by hash, round after round, meet every other node."""
    monkeypatch.setattr(M, "LEADERS", leaders)
    monkeypatch.setattr(M, "CROWD", 7)
    texts = loose(30, 4, 12)
    texts += [t + " end" for t in texts[:8]] + near_copies(12)
    rows = [(500 - k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in M.class_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == class_of(rows)
