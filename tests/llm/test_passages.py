"""Suffix-array dedup and substring dedup against brute force, with the awkward inputs."""

import hashlib
import random
import re

import pytest

from riskcard.llm import substring, suffix_dedup
from riskcard.llm import words as W

SCHEMA = "doc_id long, text string, spans string, n_words int, gram string, source string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def covered(rows, window=50):
    """Per row the positions of words in a window that also starts in a smaller doc_id."""
    low = {}
    for doc, text in rows:
        w = tokens(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p: p + window])
            if doc is not None:
                low[key] = min(low.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = tokens(text), set()
        for p in range(len(w) - window + 1):
            if doc is not None and low[tuple(w[p: p + window])] < doc:
                gone.update(range(p, p + window))
        out.append(gone)
    return out


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ß,", "A"]
    say = lambda k: [rnd.choice(vocab) for _ in range(k)]
    shared = [say(k) for k in (50, 51, 60, 75, 130)]
    rows = []
    for i in range(n):
        words = say(rnd.choice([0, 3, 20, 49, 50, 80]))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            s = rnd.choice(shared)
            words += s[: rnd.choice([49, 50, len(s)])] + say(rnd.choice([0, 1, 30]))
        rows.append((i, rnd.choice([" ", "  ", "\t"]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "x " * 400), (n + 4, "x " * 300)]
    rows += [(n + 5, rows[2][1]), (n + 6, rows[2][1] + " tail"), (7, rows[7][1]), (7, "other text of the same id")]
    rows += [(None, rows[9][1]), (None, None), (n + 9, " ".join(say(30) * 700))]
    return rows


def frame(spark, rows):
    # extra columns whose names clash with those used inside
    return spark.createDataFrame([(d, t, "s", 1, "g", None) for d, t in rows], SCHEMA).repartition(5)


def by_row(rows, want):
    return sorted((d if d is not None else -1, *x) for (d, _), x in zip(rows, want))


@pytest.mark.parametrize("seed", [3, 11])
def test_substring_dedup_matches_brute_force(spark, seed):
    rows = corpus(seed)
    gone = covered(rows)
    want = []
    for (d, t), g in zip(rows, gone):
        w = tokens(t)
        kept = " ".join(x for i, x in enumerate(w) if i not in g)
        want.append((len(w), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) \
        == by_row(rows, want)
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup_matches_brute_force(spark, hot):
    rows = corpus(5)
    want = []
    for (d, t), g in zip(rows, covered(rows)):
        spans, run = [], sorted(g)
        for p in run:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        want.append((len(tokens(t)), len(g), tuple(map(tuple, spans))))
    got = suffix_dedup.repeated_passages(frame(spark, rows), hot=hot).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed,
                   tuple((s.start, s.end) for s in r.spans)) for r in got) == by_row(rows, want)


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, "a b " + passage), (2, "c " + passage + " d e"), (3, "nothing shared"), (4, "c " + passage + " d e")]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows), keep_text=True).collect()}
    assert got[2].kept == "c d e" and got[2].copy_of is None
    assert got[4].kept == "" and got[4].copy_of == 2
    assert got[1].kept is None and got[3].n_removed == 0


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    assert substring.remove_repeats(none).count() == 0
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_shards_are_cut_between_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 7)
    rows = corpus(8)
    got = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
    want = [(len(g),) for g in covered(rows)]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got) == by_row(rows, want)


def test_word_hashes_see_bytes_not_places():
    import numpy as np
    import pyarrow as pa

    from riskcard.llm.common import strings
    data, offsets = strings(pa.array(["ab cd", None, "cd  ab", "abc d"]))
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    h = W.word_hashes(data, starts, ends, W.NOT_SPACE)
    assert first.tolist() == [0, 2, 2, 4, 6]
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 4
    assert W.rolling(np.array([1, 2, 3, 1, 2], np.uint64), 2)[0] == W.rolling(np.array([1, 2], np.uint64), 2)[0]


def test_long_words_and_texts_hash_alike(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from riskcard.llm.common import strings
    data, offsets = strings(pa.array(["q" * 3000 + " ab " + "z " * 900 + "q" * 3000, "ab"]))
    starts, ends, _ = W.spans(data, offsets, W.NOT_SPACE)
    whole = W.word_hashes(data, starts, ends, W.NOT_SPACE)
    monkeypatch.setattr(W, "PIECE", 100)
    assert np.array_equal(whole, W.word_hashes(data, starts, ends, W.NOT_SPACE))
    assert whole[0] == whole[-2] and whole[1] == whole[-1]
