"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskcard.llm import variants as V

SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows, every=31):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    words = sorted(counts)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    links = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)] for w in words}
    form = {}
    for w, xs in links.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (counts[w], len(links[w]), form.get(w), counts.get(form.get(w)), root(w)) for w in words}


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("limit", [V.LIMIT, 3])
def test_matches_all_pairs(spark, limit):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(V.variants(docs, 31, limit=limit)) == brute(counted(rows))


def test_awkward_rows(spark):
    """Nulls, empty texts, repeated rows, ties of n, chains of forms, words around and beyond LONG characters,
    letters of Latin-1, and a column whose name is used inside."""
    long = "ab" * 40
    rows = [(1, None, "x"), (2, "", None), (None, "wordless wordless 7 Wordless", "x"),
            (3, "chainage " * 1000, "x"), (4, "chainagg " * 60, "x"), (5, "chainggg " * 3, "x"),
            (6, "tie-words tiedaaa tiedaaa tiedaab tiedaab tiedaac tiedaac", "x"),
            (7, f"{long} {long} {long}x {long}x x{long} x{long} {long[:39]}q{long[39:]} {long[:39]}q{long[39:]}", "x"),
            (8, f"{long[:64]} {long[:64]} {long[:65]} {long[:65]} {long[:63]} {long[:63]} {long[:66]} {long[:66]}", "x"),
            (9, "été÷×ÿab été÷×ÿab Été÷×ÿab "
                "Été÷×ÿab", "x"), (10, "wordless", "x"), (10, "wordless", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = brute(counted([r[:2] for r in rows]))
    assert result(V.variants(docs, 31)) == want
    assert any(root != form and form for _, _, form, _, root in want.values())      # a chain of two forms


def test_no_words(spark):
    assert V.variants(spark.createDataFrame([(1, "short words")], "doc_id long, text string")).count() == 0
    assert V.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=7, max_size=80), st.integers(0, 80), st.sampled_from("abcd"),
       st.integers(0, 2), st.sets(st.text("abc\x01\x02", min_size=2, max_size=6), max_size=60))
def test_words_at_distance_one_share_a_key(word, at, char, kind, grams):
    """For any dictionary that holds the shorter forms of its grams."""
    dictionary = {g[:k] for g in grams for k in range(3, len(g) + 1)}
    at %= len(word)
    other = word[:at] + (char if kind != 1 else "") + word[at + (kind != 2):]
    if other == word:
        return
    keys = [set(V.merge_keys(w, dictionary)) for w in (word, other)]
    assert any(a == b and s * 3 + t in (0, 5, 7) for a, s in keys[0] for b, t in keys[1])
