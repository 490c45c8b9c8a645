"""Helpers shared by the operators: reading, writing intermediate tables, Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskcard.session import scratch_path, ship_code

FEW = 16
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Make Python workers able to import this package, and keep the Arrow
    batches of text columns small (1,000 rows) unless the cluster chose a size."""
    ship_code(spark)
    if spark.sparkContext.getConf().get(ARROW_ROWS) is None:
        spark.conf.set(ARROW_ROWS, "1000")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The lineage ends here: a lost executor reads the file again, and a table
    that several branches use is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in at most one task for ``each`` of so many rows, but FEW tasks: a table of few rows that comes out of
    many shuffle partitions is not written as as many files.  More rows get more tasks, all of them in the end."""
    return df.coalesce(max(FEW, -(-rows // each)))


def forget(*tables: DataFrame) -> None:
    """Delete ``written`` tables that only tables written since were made from."""
    for t in tables:
        store, path = fs.FileSystem.from_uri(t.scratch_folder)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def numbered(docs: DataFrame, *reads: str) -> DataFrame:
    """The documents with all columns but ``reads`` under names by position (``c0_``, ``c1_``, ..), so that no
    column of the user meets a name that an operator works with.  Columns keep their order."""
    return docs.toDF(*[c if c in reads else f"c{i}_" for i, c in enumerate(docs.columns)])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(arr.type):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    arr = pc.fill_null(arr, "")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges ``(i, j)`` of at most ``limit`` bytes each (one longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def merged_intervals(intervals: Column) -> Column:
    """Union of an array of (start, end) structs as sorted maximal intervals."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["start"].alias("start"),
                                           F.greatest(last["end"], x["end"]).alias("end"))))
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"])
        return F.when(touches, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(intervals.cast(kind)), F.array().cast(kind), step)


def interval_words(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def row_key(doc_id: Column, text_key: Column) -> Column:
    """One number per (doc_id, text): what rows are joined and numbered by, so that one shuffle of
    the texts serves both.  Rows that share it by chance are told apart by ``agree``."""
    return F.xxhash64(doc_id.cast("long"), text_key)


def agree(a: Column, b: Column) -> Column:
    """Equality of whole numbers (null like null) that is tested on joined rows; as ``a == b`` it
    would become a join key and change how the rows are dealt."""
    return ((F.coalesce(a.bitwiseXOR(b), F.lit(0)) == 0)
            & (a.isNull().cast("int").bitwiseXOR(b.isNull().cast("int")) == 0))
