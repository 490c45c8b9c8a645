"""Alignment of two tokenizers over a corpus: which ids of A stand where which ids of B stand.

Both tokenize space + text: A is a byte-level BPE (``tokenizers`` file), B a piece model
(``sentencepiece`` file, which adds the space itself).  Tokens become byte ranges; where an A token
and a B token both end, the text is cut, so each group between cuts ends in exactly one link, its
last A and last B token.

*Identity map.*  Before the run an array A-id -> B-id of the same bytes is made (the smallest B id
where several have them).  A group of one A and one B token in that map is a fast one: such links
are counted in a vector of A's vocabulary, one per task, added up at the end.  Only links of the
other groups are shuffled, as (pair, times) per document, summed map-side.  What leaves the workers
for the driver is bounded by the vocabularies: the count of each identity pair and the highest
count of each B id.

*Segments.*  Neither tokenizer joins a space to what precedes it (no token has a space after
a character other than white space; checked when the files are read), so a text is cut before every
such space, and each segment is tokenized on its own.  Segments repeat: a task remembers those it
met, tokenizes the new ones of about a million characters in one string, and puts the documents'
sums, links and hashes together from theirs.  A longer text is read piece by piece.

Defined cases: null and empty texts, and texts whose tokens do not spell space + text on both sides
(U+2581 becomes a space, for one), have no tokens: zeros and an empty ``groups_sha256``; repeated
rows are rows of their own and each counts; rows without doc_id count too; an empty table gives no
rows; only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskcard.llm.common import ready, written

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 1 << 20          # characters of text taken at a time
KEPT = 250_000           # segments that a task remembers
CUT = re.compile(r"(?<=\S)(?= )")
# fixed value: how a byte-level BPE file with the built-in pattern cuts a text into words
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for
    U+0100 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


class Pair:
    """Both tokenizers with the bytes of their tokens, from the contents of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        alphabet = byte_of()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = (bytes(alphabet[c] for c in token) if all(c in alphabet for c in token)
                               else token.encode())
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else
                                b"" if self.b.is_control(i) or self.b.is_unknown(i) else
                                piece.replace("\u2581", " ").encode())
        if any(CUT.search(x.decode(errors="replace")) for x in chain(self.a_bytes, self.b_bytes)):
            raise ValueError("a token has a space after another character: texts cannot be cut there")
        first: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if x:
                first.setdefault(x, i)
        # A-id -> B-id of the same bytes, -1 where there is none
        self.same = np.array([first.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.ranks = self._ranks(json.loads(a_file), vocab)
        # decimal ids with what follows them in groups: A "," or "|", B "," or ";"
        self.digits = [f"{i}{c}".encode() for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";"))
                       for i in range(n) for c in (",", end)]
        self.digit_len = np.array([len(x) for x in self.digits], np.int64)

    def _ranks(self, spec: dict, vocab: dict):
        """The merges of A as ranked tokens for ``tiktoken`` (several times faster), where its file is a
        plain byte-level BPE whose merges are in the order of their ids; else None."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        ids = [vocab.get("".join(m), -1) for m in merges]
        plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not spec.get("normalizer")
                 and not model.get("ignore_merges") and ids == sorted(ids) and -1 not in ids)
        added = {x["id"] for x in spec.get("added_tokens", [])}
        if not plain:
            return None
        import tiktoken
        ranks = {self.a_bytes[i]: i for t, i in vocab.items() if i not in added}
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, text: str):
        """A and B ids of a text that begins with a space; None where they do not spell it."""
        a = (self.ranks.encode_ordinary(text) if self.ranks else
             self.a.encode(text, add_special_tokens=False).ids)
        b, spelt = self.b.encode(text[1:]), text.encode()
        if text == " ":                      # the end of a text; alone it would get no tokens
            b = self.b.encode("x ")[len(self.b.encode("x")):]
        if (b"".join(map(self.a_bytes.__getitem__, a)) != spelt
                or b"".join(map(self.b_bytes.__getitem__, b)) != spelt):
            return None
        return a, b


def pieces(text: str):
    """Parts of about PIECE characters, cut only before a space after something else."""
    i = 0
    while len(text) - i > PIECE:
        cut = CUT.search(text, i + PIECE)
        if cut is None:
            break
        yield text[i: cut.start()]
        i = cut.start()
    yield text[i:]


class Segments:
    """The groups of distinct segments, tokenized together.  Per segment: ``n_a`` and ``n_b``, ``text``
    (its groups, each with a closing semicolon; None if the tokens spell something else), and its links
    ``link[at[k]: at[k + 1]]``, an A id, a B id and a bit that is set for fast groups in one number."""

    def __init__(self, pair: Pair, segments: list[str]):
        # those that end in white space could run into the next one, others are tokenized in one go
        loose = [k for k, s in enumerate(segments) if s[-1].isspace()]
        tight = [k for k, s in enumerate(segments) if not s[-1].isspace()]
        together = pair.tokens("".join([segments[k] for k in tight])) if tight else None
        blocks = [(tight, together)] if together else [([k], pair.tokens(segments[k])) for k in tight]
        blocks += [([k], pair.tokens(segments[k])) for k in loose]
        self.text: list[bytes | None] = [None] * len(segments)
        order = [k for ks, got in blocks if got for k in ks]
        a = np.fromiter(chain.from_iterable(got[0] for _, got in blocks if got), np.int64)
        b = np.fromiter(chain.from_iterable(got[1] for _, got in blocks if got), np.int64)
        n_a, n_b, size = (np.zeros(len(segments), np.int64) for _ in range(3))
        links = np.zeros(0, np.int64)
        if order:
            end = np.cumsum([len(segments[k].encode()) for k in order])
            end_a, end_b = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
            common = np.intersect1d(end_a, end_b, assume_unique=True)
            last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
            fast = ((np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
                    & (pair.same[a[last_a]] == b[last_b]))
            links = a[last_a] << 32 | b[last_b] << 1 | fast
            groups = np.searchsorted(common, end) + 1
            size[order] = np.diff(groups, prepend=0)
            upto_a, upto_b = last_a[groups - 1] + 1, last_b[groups - 1] + 1
            n_a[order], n_b[order] = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
            # the ids in the order in which they are written: each group's A ids, then its B ids
            code = np.zeros(len(a) + len(b), np.int64)
            group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
            code[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = 2 * a + (last_a[group_a] == np.arange(len(a)))
            code[np.arange(len(b)) + last_a[group_b] + 1] = (
                2 * (len(pair.a_bytes) + b) + (last_b[group_b] == np.arange(len(b))))
            text = b"".join(map(pair.digits.__getitem__, code.tolist()))
            stop = np.cumsum(pair.digit_len[code])[upto_a + upto_b - 1]
            for k, x, y in zip(order, np.r_[0, stop[:-1]].tolist(), stop.tolist()):
                self.text[k] = text[x:y]
        self.n_a, self.n_b = n_a, n_b
        # links lie in the order of ``order``
        start = np.zeros(len(segments), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        self.link, self.start, self.size = links, start, size


def summed(doc: np.ndarray, value: np.ndarray, times: np.ndarray):
    """(doc, value, times) with equal (doc, value) rows added, in that order."""
    by = np.lexsort((value, doc))
    doc, value, times = doc[by], value[by], times[by]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]) if len(doc) else by
    return doc[new], value[new], np.add.reduceat(times, new) if len(doc) else times


class Memo:
    """Segments met by a task, with the fields of ``Segments``; begins anew beyond KEPT of them."""

    def __init__(self, pair: Pair):
        self.pair, self.number = pair, {}
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.text: list[bytes | None] = []
        self.n_a = self.n_b = self.start = self.size = self.link = np.zeros(0, np.int64)

    def ids(self, parts: list[str]) -> list[list[int]]:
        """Numbers of the segments of each part; the new ones are tokenized together."""
        if len(self.number) > KEPT:
            self.clear()
        had, number = len(self.number), self.number
        lists = [[number.setdefault(s, len(number)) for s in CUT.split(part)] for part in parts]
        if len(number) > had:
            new = Segments(self.pair, list(islice(number, had, None)))
            self.text += new.text
            self.start = np.r_[self.start, new.start + len(self.link)]
            for name in ("n_a", "n_b", "size", "link"):
                setattr(self, name, np.r_[getattr(self, name), getattr(new, name)])
        return lists


class Texts:
    """Sums over the texts of a batch: ``n`` (rows n_a, n_b, n_groups), ``sha`` and the links of each."""

    def __init__(self, memo: Memo, texts: list[str | None]):
        self.n, self.bad = np.zeros((3, len(texts)), np.int64), np.zeros(len(texts), bool)
        self.hash, self.begun = [hashlib.sha256() if t else None for t in texts], set()
        found, held, chars = [], [], 0
        for d, t in enumerate(texts):
            for part in pieces(" " + t) if t else ():
                held.append((d, part))
                chars += len(part)
                if chars >= PIECE:
                    found.append(self._unit(memo, held))
                    held, chars = [], 0
        if held:
            found.append(self._unit(memo, held))
        doc, link, times = summed(*(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64)
                                    for k in range(3)))
        keep = ~self.bad[doc]
        self.doc, self.link, self.times = doc[keep], link[keep], times[keep]
        self.n[:, self.bad] = 0
        self.sha = ["" if h is None or bad else h.hexdigest() for h, bad in zip(self.hash, self.bad)]

    def _unit(self, got: Memo, parts: list[tuple[int, str]]):
        lists = got.ids([part for _, part in parts])
        for (d, _), ids in zip(parts, lists):
            text = [got.text[k] for k in ids]
            if None in text:
                self.bad[d] = True
                continue
            if d in self.begun:
                self.hash[d].update(b";")
            self.hash[d].update(b"".join(text)[:-1])
            self.begun.add(d)
        ids = np.fromiter(chain.from_iterable(lists), np.int64)
        doc = np.repeat([d for d, _ in parts], [len(x) for x in lists])
        doc, ids, times = summed(doc, ids, np.ones(len(ids), np.int64))
        for row, per in zip(self.n, (got.n_a, got.n_b, got.size)):
            np.add.at(row, doc, per[ids] * times)
        size = got.size[ids]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return summed(np.repeat(doc, size), got.link[np.repeat(got.start[ids], size) + inside],
                      np.repeat(times, size))


ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, fast array<int>, "
           "fast_times array<int>, pairs array<long>, pair_times array<int>, counts array<long>")


def _aligned(docs: DataFrame, files) -> DataFrame:
    """One row per document with its own links, and one row per task with ``counts``, the links of
    its fast groups by A id."""

    def run(batches):
        memo = Memo(Pair(*files.value))
        counts = np.zeros(len(memo.pair.same), np.int64)
        for b in batches:
            got = Texts(memo, b.column(2).to_pylist())
            fast = got.link & 1 == 1
            ids = got.link[fast] >> 32
            np.add.at(counts, ids, got.times[fast])

            def lists(at, values, kind):
                ends = np.searchsorted(at, np.arange(len(b) + 1))
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind))

            other = got.link[~fast]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *map(pa.array, got.n), pa.array(got.sha, pa.string()),
                 lists(got.doc[fast], ids, pa.int32()), lists(got.doc[fast], got.times[fast], pa.int32()),
                 lists(got.doc[~fast], (other >> 32 << 32) + (other % (1 << 32) >> 1), pa.int64()),
                 lists(got.doc[~fast], got.times[~fast], pa.int32()),
                 pa.nulls(len(b), pa.list_(pa.int64()))], schema.names)
        yield pa.RecordBatch.from_pylist([{"counts": counts.tolist()}], schema)

    schema = to_arrow_schema(StructType.fromDDL(ALIGNED))
    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        "text").mapInArrow(run, ALIGNED))


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pair_counts(aligned: DataFrame, same: np.ndarray) -> DataFrame:
    """(a, b, n) of every linked id pair.  The vectors of the tasks are added by A id; the pairs of
    the other groups are counted after a map-side sum."""
    spark = aligned.sparkSession
    identity = spark.createDataFrame([(i, int(x)) for i, x in enumerate(same) if x >= 0], "a long, b long")
    fast = (aligned.where("counts is not null").select(F.posexplode("counts").alias("a", "n")).where("n > 0")
            .groupBy("a").agg(F.sum("n").alias("n")).join(F.broadcast(identity), "a").select("a", "b", "n"))
    other = (aligned.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_times").alias("n"))))
             .groupBy("pair").agg(F.sum("n").alias("n"))
             .select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n"))
    return fast.unionByName(other).groupBy("a", "b").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE):
    """(documents, pairs).  Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.  Pairs: a, b, n, best (n is the highest of its b)."""
    spark = docs.sparkSession
    ready(spark)
    contents = _file(f"{folder}/{a_file}"), _file(f"{folder}/{b_file}")
    tokenizers = Pair(*contents)
    files, same = spark.sparkContext.broadcast(contents), tokenizers.same
    rows = written(_aligned(docs, files), "aligned")
    counts = written(pair_counts(rows, same), "pair-counts")
    # one row per B id, and one per A id: bounded by the vocabularies
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    pairs = written(counts.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"),
                    (F.col("a") * (1 << 32) + F.col("b")).alias("pair")), "pairs")
    identity = spark.createDataFrame([(i, int(x)) for i, x in enumerate(same) if x >= 0], "a long, b long")
    known, is_best = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    for r in pairs.join(F.broadcast(identity), ["a", "b"]).select("a", "n", "best").toLocalIterator():
        known[r.a], is_best[r.a] = r.n, r.best
    vectors = spark.sparkContext.broadcast((known, is_best))

    def fast_sums(batches):
        known, is_best = vectors.value
        for b in batches:
            lists = b.column(0), b.column(1)
            size = np.diff(lists[0].offsets.to_numpy())
            ids, times = (x.flatten().to_numpy() for x in lists)
            doc = np.repeat(np.arange(len(size)), size)
            total, best = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, doc, times * known[ids])
            np.add.at(best, doc, times * is_best[ids])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(2, 8)), pa.array(best), pa.array(total)],
                                             ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "best",
                                              "total"])

    own = rows.where("counts is null").select("fast", "fast_times", "row", "doc_id", "n_a", "n_b", "n_groups",
                                              "groups_sha256").mapInArrow(
        fast_sums, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, best long, "
        "total long")
    other = (rows.where("counts is null")
             .select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_times").alias("times"))))
             .join(pairs.select("pair", "n", "best"), "pair").groupBy("row")
             .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("o_best"),
                  F.sum(F.col("times") * F.col("n")).alias("o_total")))
    out = own.join(other, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("best") + F.coalesce("o_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("o_total", F.lit(0))).alias("count_sum"), "groups_sha256")
    return out, pairs.drop("pair")
