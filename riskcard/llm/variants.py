"""Spelling variants: words at an edit distance of one, found through variable-length grams.

*Words.*  Runs of letters are counted over the corpus (partial sums before the shuffle).

*Gram dictionary.*  Every position of a word (with marks around it) starts a gram of GRAMS[0] to
GRAMS[1] characters.  A longer gram is kept only where its shorter form occurs more than ``limit``
times in the vocabulary and it occurs in a twentieth of that itself: frequent grams are made longer,
rare ones stay short.  ``limit`` grows with the vocabulary, so the dictionary has at most
20 x NODES grams a length and can be broadcast.

*Decomposition.*  At each position the longest gram of the dictionary is taken; grams inside another
one are dropped.  Whether a gram is part of the decomposition depends on a short window of
characters only, so an edit at a position affects just the grams whose window holds it.  Those are
the affected-gram bounds of the word, one for each edit position.

*List merging.*  For each edit position the grams before and after it that stay must occur in the
other word too, at the same place from the front and from the back.  The lists of the two nearest
ones are intersected by one equi-join on both grams, both places and the length.  Words that meet
are verified by their edit distance.  In words of more than LONG characters the longer half that
has no edit is compared instead, so a row never holds many copies of a long word.

Defined cases: null and empty texts have no words; rows without doc_id count with an empty id in
the checksum; repeated rows count again; an empty table gives no rows; only doc_id and text are
read, so other columns can have any name; words of any length take part.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskcard.llm.common import ready, written

GRAMS = (2, 6)
LIMIT = 200              # least frequency from which grams are made longer
NODES = 50_000           # grams a length that can be made longer
LONG = 64
LEAST_LENGTH, LEAST_TIMES, RATIO = 7, 2, 10
RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FRONT, BACK = "\x01", "\x02"


def misspelt(run: Column, doc_id: Column, every: int) -> Column:
    """The run, or where ``every`` divides the checksum of ``<doc_id>:<run>``, the run without one character."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def words(docs: DataFrame, every: int | None = None, least_length: int = LEAST_LENGTH,
          least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least that length and number of occurrences.
    With ``every``, the runs it hits lose a character first (``misspelt``)."""
    runs = (docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({RUNS})"), 1)).alias("run"))
            .where(F.length("run") >= least_length).select("doc_id", F.translate("run", UPPER, LOWER).alias("run")))
    word = F.col("run") if every is None else misspelt(F.col("run"), F.col("doc_id"), every)
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times))


def gram_dictionary(vocabulary: DataFrame, limit: int = LIMIT, nodes: int = NODES) -> set[str]:
    """The grams longer than GRAMS[0]; with each its shorter forms are in the set too."""
    low, high = GRAMS
    marked = F.concat(F.lit(FRONT * (high - 1)), F.col("word"), F.lit(BACK * (high - 1)))
    places = F.transform(F.sequence(F.lit(1), F.length("word") + 2 * (high - 1) - low + 1),
                         lambda p: F.substring(marked, p, F.lit(high)))
    grams = written(vocabulary.select(F.explode(places).alias("g")).groupBy("g")
                    .agg(F.count(F.lit(1)).alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    limit = max(limit, -(-total // nodes))

    def counts(q: int) -> DataFrame:
        return (grams.where(F.length("g") >= q).groupBy(F.substring("g", 1, q).alias("g"))
                .agg(F.sum("n").alias("n")))

    out: set[str] = set()
    for q in range(low + 1, high + 1):
        shorter = counts(q - 1).where(F.col("n") > limit).select(F.col("g").alias("s"))
        kept = (counts(q).where(F.col("n") * 20 > limit)
                .join(shorter, F.substring("g", 1, q - 1) == F.col("s")).select("g"))
        # at most 20 x nodes rows: each occurs in more than a twentieth of the limit of all places
        out.update(r.g for r in kept.toLocalIterator())
    return out


def decompose(word: str, dictionary: set[str]):
    """[(place, gram, first, last)] of a marked word: its grams, none inside another, each with the
    window of characters on which it depends.

    Its right end is the character at which no longer gram was found.  Its left end is the first
    place from which another gram could reach over it."""
    low, high = GRAMS
    out, reached = [], 0
    for p in range(len(word) - low + 1):
        size = low
        while size < high and word[p: p + size + 1] in dictionary:
            size += 1
        if p + size > reached:
            out.append((p, word[p: p + size], p + size - high, p + size - (size == high)))
            reached = p + size
    return out


def merge_keys(word: str, dictionary: set[str]):
    """(key, side) of a word: side 0 for a replaced character, 1 for the longer and 2 for the shorter
    word of a deleted one.  Two words at distance one have a key in common on fitting sides."""
    n, pad = len(word), GRAMS[1] - 1
    out = set()
    if n <= LONG + 1:
        marked = FRONT * pad + word + BACK * pad
        grams = decompose(marked, dictionary)
        size, before, after, gap = len(marked), -1, 0, 0

        def stay(a: int, b: int) -> str:
            x = f"{grams[a][0]}{grams[a][1]}" if a >= 0 else ""
            y = f"{size - grams[b][0]}{grams[b][1]}" if b < len(grams) else ""
            return f"{x}/{y}"

        for i in range(pad, pad + n + 1):
            while before + 1 < len(grams) and grams[before + 1][3] < i:
                before += 1
            while after < len(grams) and grams[after][2] <= i:
                after += 1
            while gap < len(grams) and grams[gap][2] < i:
                gap += 1
            if i < pad + n:                  # the character at i is replaced or deleted
                key = stay(before, after)
                if n <= LONG:
                    out.add((f"{n}r{key}", 0))
                out.add((f"{n - 1}d{key}", 1))
            if n <= LONG:                    # a character is inserted before i
                out.add((f"{n}d{stay(before, gap)}", 2))
    for least, side in ((n, 0), (n - 1, 1), (n, 2)):
        if least > LONG:
            half, kind = least // 2, "r" if side == 0 else "d"
            out |= {(f"{least}{kind}<{word[:half]}", side), (f"{least}{kind}>{word[n - half:]}", side)}
    return out


def near_pairs(vocabulary: DataFrame, dictionary: set[str]) -> DataFrame:
    """(a, b), each pair of words at an edit distance of one once."""
    spark = vocabulary.sparkSession
    ready(spark)
    grams = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        for batch in batches:
            keys, sides, of = [], [], []
            for w in batch.column(0).to_pylist():
                for key, side in merge_keys(w, grams.value):
                    keys.append(xxhash.xxh64_intdigest(key.encode()) - (1 << 63))
                    sides.append(side)
                    of.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.int32()),
                                              pa.array(of, pa.string())], ["key", "side", "word"])

    keys = written(vocabulary.select("word").mapInArrow(run, "key long, side int, word string"), "word-keys")
    a, b = keys.alias("a"), keys.alias("b")
    # one condition on both sides, so that both read the same shuffle
    fits = F.expr("a.side * 3 + b.side IN (0, 5) AND (a.side + b.side > 0 OR a.word < b.word)")
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & fits
                   & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
            .select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: forms followed to the last, twice as far every round."""
    cur = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = cur.select(F.col("word").alias("w"), F.col("root").alias("r"))
        new = written(cur.join(further, cur["root"] == further["w"], "left")
                      .select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")),
                      "roots")
        cur = new.select("word", "root")
        if new.where("moved").isEmpty():
            return cur


def variants(docs: DataFrame, every: int | None = None, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """One row per word: word, n, n_near, form (the near word of largest n, the smallest of several, if
    that n is at least ``ratio`` times the word's), form_n, root (forms followed to the last)."""
    vocabulary = written(words(docs, every), "words")
    pairs = written(near_pairs(vocabulary, gram_dictionary(vocabulary, limit)), "near-words")
    both = pairs.union(pairs.select("b", "a"))
    other = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = (both.join(other, "b").groupBy(F.col("a").alias("word"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best")))
    named = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.b").alias("form"),
                                                                (-F.col("best.m")).alias("n"))).alias("of"))
    named = written(named.select("word", "n", "n_near", F.col("of.form").alias("form"),
                                 F.col("of.n").alias("form_n")), "forms")
    last = roots(named.where("form is not null").select("word", "form"))
    return named.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
