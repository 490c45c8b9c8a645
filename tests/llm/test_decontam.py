"""Benchmark decontamination against brute force."""

import random
import re

import pytest

from riskcard.llm import decontam

DOCS = "doc_id long, text string, n_words int, hit string, matches string, item_id long"


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            k = min(window, len(b))
            for s in range(len(b) - k + 1) if b else ():
                for p in range(len(w) - k + 1):
                    if w[p: p + k] == b[s: s + k]:
                        hit.update(range(p, p + k))
                        found.add(item)
        out.append((d if d is not None else -1, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out)


def data(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "Cc", "é", "x1", "the"]
    say = lambda k: [rnd.choice(vocab) for _ in range(k)]
    items = [(i, rnd.choice([" ", "--", "\n"]).join(say(rnd.choice([0, 2, 3, 4, 7, 9])))) for i in range(12)]
    items += [(3, "the the the x1 x1"), (None, "q r s t"), (50, None), (51, "..."), (52, "a b a b a b a b"),
              (52, "a b a b a b a b")]
    docs = [(i, " ".join(say(rnd.choice([0, 1, 3, 30, 60])))) for i in range(25)]
    docs += [(90, None), (91, ""), (92, "a " * 300), (None, "q r s t"), (3, docs[3][1]), (3, "Q,R.S;T u"),
             (93, " ".join(say(3000)))]
    return docs, items


@pytest.mark.parametrize("seed,chars", [(1, 10**6), (2, 60)])
def test_matches_brute_force(spark, seed, chars):
    docs, items = data(seed)
    d = spark.createDataFrame([(a, b, 1, "h", "m", 7) for a, b in docs], DOCS).repartition(4)
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = decontam.longest_matches(d, b, window=4, block_chars=chars).withColumn("items", decontam.item_list()).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, sum(x.end - x.start for x in r.hit),
                   sorted(r["items"])) for r in got) == brute(docs, items, 4)
    texts = {}
    for i, t in items:
        texts.setdefault(i, []).append(words(t))
    own = {}
    for i, t in docs:
        own.setdefault(i, []).append(words(t))
    for r in got:
        for m in r.matches:     # matches are verbatim and as long as can be
            assert any(w[m.doc_pos: m.doc_pos + m.n_words] == x[m.item_pos: m.item_pos + m.n_words]
                       and len(x) >= m.item_pos + m.n_words
                       and w[m.doc_pos: m.doc_pos + m.n_words + 1] != x[m.item_pos: m.item_pos + m.n_words + 1]
                       or m.item_pos + m.n_words in (len(x), ) or m.doc_pos + m.n_words == len(w)
                       for w in own[r.doc_id] for x in texts[m.item_id])
    clean = decontam.without_benchmark(d, b, window=4, block_chars=chars)
    assert clean.columns == d.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in clean.collect()) == sorted(
        x[0] for x, n in ((x, x[2]) for x in brute(docs, items, 4)) if n == 0)


def test_empty_tables(spark):
    docs, items = data(4)
    d = spark.createDataFrame([(a, b, 1, "h", "m", 7) for a, b in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.longest_matches(d.limit(0), b).count() == 0
    assert all(not r.hit for r in decontam.longest_matches(d, b.limit(0)).collect())
    assert decontam.without_benchmark(d, b.limit(0)).count() == len(docs)


@pytest.mark.parametrize("item", [15, 500, 5_000])
def test_repetitive_text_is_bounded(item):
    """A 40 KB document of one word against an item of that word: one match, in little time and memory."""
    import resource
    import time

    import pyarrow as pa
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    tests = decontam.Tests([(1, "word " * item)], 10)
    got = list(decontam.judged(pa.array(["word " * 8_000, "word " * 9, None]), tests))
    assert got[0] == (8_000, [{"start": 0, "end": 8_000}], [1],
                      [{"item_id": 1, "item_pos": 0, "doc_pos": 0, "n_words": min(item, 8_000)}])
    assert got[1:] == [(9, [], [], []), (0, [], [], [])]
    assert time.time() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_many_items_with_one_window():
    import pyarrow as pa
    common = "a b c d e f g h i j"
    tests = decontam.Tests([(k, f"{common} tail{k}") for k in range(10_000)] + [(None, common)], 10)
    got = list(decontam.judged(pa.array([f"{common} " * 300, "other words", f"x {common} tail77 y"]), tests))
    assert got[0][2] == list(range(10_000)) and len(got[0][3]) == 1 and got[0][1] == [{"start": 0, "end": 3_000}]
    assert got[1] == (2, [], [], [])
    assert got[2][1] == [{"start": 1, "end": 12}] and len(got[2][2]) == 10_000
    # the window "b .. j tail77" has only item 77; its match is part of the one before
    assert {m["item_id"] for m in got[2][3]} <= {0, 77}


def test_window_classes_are_exact():
    import numpy as np
    rnd = random.Random(5)
    seq = np.array([rnd.randrange(3) for _ in range(400)] + [0] * 12)
    start = np.arange(380)
    need = np.array([rnd.randrange(1, 12) for _ in start])
    cls, rep = decontam.window_classes(seq, start, need)
    text = [(int(n), tuple(seq[s: s + n])) for s, n in zip(start, need)]
    assert len(set(zip(cls.tolist(), text))) == len(set(cls.tolist())) == len(set(text))
    assert [cls[r] for r in rep] == list(range(len(rep)))
