"""Sharding by extendible hashing, with DataFrame operations only.

Documents hash to 60 bits (the first 15 hex digits of md5(doc_id)).  A shard is a prefix of those
bits; it splits on the next bit while it holds more than its byte limit and more than one
document.  The directory is indexed by hash-prefix bits: each of its cells names the shard that
holds it, and only cells of oversized shards are cut finer, STEP bits at a time.

Each round aggregates bytes by cell (pre-aggregated before the shuffle, at most 2^STEP rows per
oversized cell), derives the sums of all coarser prefixes from the cells and gives each cell the
shortest prefix that fits.  Documents look their shard up in the directory by an equi-join, which
Spark broadcasts while the directory is under its size limit; they are not shuffled by it.

Rows with one doc_id have one hash.  If together they exceed the limit, they are written once with
row numbers, whose hash gives further bits.

Defined cases: null and empty texts have 0 bytes; a single document larger than the limit is a
shard of its own; null doc_ids hash like an empty text; repeated rows are rows of their own; an
empty table gives no rows; an input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskcard.llm.common import numbered, written

LIMIT = 64 << 20     # bytes of text in a shard
STEP = 12            # bits per round
BITS = 60
ADDED = {"shard": "_shard", "shard_depth": "_depth", "doc_bytes": "_bytes", "shard_bytes": "_shard_bytes",
         "shard_docs": "_shard_docs"}


def bits_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _cell(h: str, depth: int) -> Column:
    return F.shiftright(F.col(h), BITS - depth)


def directory_round(rows: DataFrame, h: str, top: str | None, depth: int, limit: int) -> DataFrame:
    """Directory cells of ``depth`` bits of ``h`` (within ``top``, for rows whose first bits are used
    up): cell, prefix and depth of its shard, the shard's bytes and documents; null depth where even
    the whole cell is too large."""
    keys = ["_top", "_cell"]
    cells = (rows.select((F.col(top) if top else F.lit(0).cast("long")).alias("_top"),
                         _cell(h, depth).alias("_cell"), "_bytes")
             .groupBy(*keys).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")))
    first = 0 if depth == STEP and not top else depth - STEP + 1
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(_cell, {depth} - d)"))
    # at most 2^STEP cells share a prefix here
    one = Window.partitionBy("_top", "d", "prefix")
    fits = (levels.withColumn("bytes", F.sum("b").over(one)).withColumn("docs", F.sum("n").over(one))
            .withColumn("ok", (F.col("bytes") <= limit) | (F.col("docs") == 1)))
    best = F.min(F.when(F.col("ok"), F.struct("d", "prefix", "bytes", "docs")))
    return fits.groupBy(*keys).agg(best.alias("s")).select(
        *keys, F.col("s.d").alias("d"), F.col("s.prefix").alias("prefix"),
        F.col("s.bytes").alias("bytes"), F.col("s.docs").alias("docs"))


def _look_up(rows: DataFrame, found: DataFrame, h: str, top: str | None, depth: int) -> DataFrame:
    """Rows with _shard, _depth, _shard_bytes and _shard_docs filled in where this round settled them."""
    f = found.where("d is not null").select(*[F.col(c).alias(f"_f_{c.strip('_')}") for c in found.columns])
    same = _cell(h, depth) == F.col("_f_cell")
    if top:
        same = same & (F.col(top) == F.col("_f_top")) & F.col("_shard").isNull()
    bits = F.when(F.col("_f_d") > 0, F.lpad(F.bin("_f_prefix"), F.col("_f_d"), F.lit("0"))).otherwise(F.lit(""))
    name = F.concat(F.lit("s"), F.lpad(F.bin(F.col(top)), F.lit(BITS), F.lit("0")), bits) if top else \
        F.concat(F.lit("s"), bits)
    more = BITS if top else 0
    return rows.join(f, same, "left").withColumns({
        "_shard": F.coalesce("_shard", F.when(F.col("_f_d").isNotNull(), name)), "_depth": F.coalesce("_depth", F.col("_f_d") + more),
        "_shard_bytes": F.coalesce("_shard_bytes", "_f_bytes"),
        "_shard_docs": F.coalesce("_shard_docs", "_f_docs")}).drop(*f.columns)


def assigned(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents, all columns, with shard (``s`` and its hash-prefix bits), shard_depth,
    doc_bytes, shard_bytes and shard_docs.  A column of one of these names, in any case, is replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    names, docs = docs.columns, numbered(docs, "doc_id", "text")
    return _assigned(docs, limit).toDF(*names, *ADDED)


def _assigned(docs: DataFrame, limit: int) -> DataFrame:
    rows = docs.withColumns({
        "_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "_h": bits_of(F.col("doc_id")),
        "_shard": F.lit(None).cast("string"), "_depth": F.lit(None).cast("int"),
        "_shard_bytes": F.lit(None).cast("long"), "_shard_docs": F.lit(None).cast("long")})
    active, source = written(rows.select("_h", "_bytes"), "shard-bytes"), rows
    h, top = "_h", None
    while True:
        open_cells = None
        for depth in range(STEP, BITS + 1, STEP):
            found = written(directory_round(active, h, top, depth, limit), "shard-directory")
            source = _look_up(source, found, h, top, depth)
            open_cells = found.where("d is null").select(F.col("_top").alias("_o_top"), F.col("_cell").alias("_o"))
            if open_cells.isEmpty():
                return _named(source, docs)
            same = _cell(h, depth) == F.col("_o")
            active = active.join(open_cells, same & (F.col(top) == F.col("_o_top")) if top else same, "left_semi")
        # one hash holds more than the limit: number its rows and go on with bits of the numbers
        source = written(source.withColumn("_no", F.monotonically_increasing_id()), "shard-rows")
        source = source.withColumn("_h2", bits_of(F.concat(F.lit(top or ""), F.col("_no"))))
        active = source.where("_shard is null").select("_h", "_h2", "_bytes")
        if top:
            raise AssertionError("row numbers are unique; their bits cannot run out")
        h, top = "_h2", "_h"


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*docs.columns, *[F.col(v).alias(k) for k, v in ADDED.items()])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the documents as Parquet, one folder per shard."""
    assigned(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)
