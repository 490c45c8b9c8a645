"""Cross-tokenizer alignment against whole texts tokenized by both libraries, one by one."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from riskcard.llm import align

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
AWKWARD = [(1, None, "x"), (2, "", "x"), (3, " ", None), (4, "   two  spaces  ", "x"), (5, "tab\t and\n \nline ", "x"),
           (6, "a piece mark ▁ here", "x"), (7, "<|endoftext|> <s> </s> <unk>", "x"), (8, "日本語 のテキスト 🙂 é", "x"),
           (9, "the same words the same words", "x"), (9, "the same words the same words", "x"),
           (None, "no id the same words", "x"), (11, "\x00 \x1f nul", "x"), (12, "w" * 3000, "x"),
           (13, "  nbsp    em ﬁ ½", "x"), (14, "word " * 400, "x")]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*(align._file(f"{align.FOLDER}/{f}") for f in (align.A_FILE, align.B_FILE)))


def brute(pair, rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        spelt = (" " + (text or "")).encode()
        if any(b"".join(table[i] for i in ids) != spelt for table, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
            a, b = [], []
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [(ends[0].index(c) + 1, ends[1].index(c) + 1) for c in cuts]
        links = [(a[i - 1], b[j - 1]) for i, j in at]
        counts.update(links)
        groups = ";".join(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}"
                          for (i0, j0), (i, j) in zip([(0, 0), *at], at))
        found.append((doc_id, len(a), len(b), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    key = lambda r: tuple(str(x) for x in r)
    return sorted([(d, n_a, n_b, len(k), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), sha)
                   for d, n_a, n_b, k, sha in found], key=key), counts


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=lambda r: tuple(str(x) for x in r))


def test_matches_whole_texts(spark, pair):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got, pairs = align.aligned(docs)
    want, counts = brute(pair, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(got) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts


@pytest.mark.parametrize("piece", [align.PIECE, 40])
def test_awkward_texts(spark, pair, monkeypatch, piece):
    """Nulls, empty texts, repeated rows, special strings, marks of the piece model, other white space, and a
    column whose name is used inside; also read in pieces."""
    monkeypatch.setattr(align, "PIECE", piece)
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, row string")
    got, _ = align.aligned(docs.coalesce(1))
    assert rows_of(got) == brute(pair, [r[:2] for r in AWKWARD])[0]


def test_pieces_and_memo(pair, monkeypatch):
    """Pieces of a long text and a memo that begins anew change nothing."""
    texts = ["some words and more words " * 30 + "end", "x" * 200 + " y", None]
    whole = align.Texts(align.Memo(pair), texts)
    monkeypatch.setattr(align, "PIECE", 50)
    monkeypatch.setattr(align, "KEPT", 3)
    cut = align.Texts(align.Memo(pair), texts)
    assert whole.sha == cut.sha and (whole.n == cut.n).all()
    assert [x.tolist() for x in (whole.doc, whole.link, whole.times)] == [
        x.tolist() for x in (cut.doc, cut.link, cut.times)]


def test_empty_table(spark):
    got, pairs = align.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and pairs.count() == 0


def test_ranked_tokens_equal_the_library(pair):
    for text in [r[1] for r in AWKWARD if r[1]]:
        assert pair.ranks.encode_ordinary(" " + text) == pair.a.encode(" " + text, add_special_tokens=False).ids
