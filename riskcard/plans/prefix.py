"""Running sums, row numbers and carried values over a whole table, without a single-partition window.

``Window.orderBy(..)`` with no ``partitionBy`` moves every row into one task.  Here the rows are
range-partitioned on the full order key (so a hot leading value is split by the next column) and
sorted; each task adds up its own rows, Arrow batch by batch, and the table is written once to the
shared folder with the number of its range.  What the ranges before a range add is a sum over one
row per range.  The rows cross the network once.  The same method serves any size: Spark chooses
the number of ranges, from ``spark.sql.shuffle.partitions`` and the bytes.

NULL keys come last, ascending or descending.

Tables that are small by construction (one row per integer score) may pass ``partitions=1`` and
get a plain window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.session import scratch_path, ship_code


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _order(cols: list[str], ascending: bool) -> list[Column]:
    return [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in cols]


def running_sums(df: DataFrame, order_cols: list[str], sum_cols: dict[str, str], ascending: bool = True,
                 partitions: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """Add ``out = running sum of src`` in the order of ``order_cols``, restarted per ``groups``.

    ``sum_cols`` maps output name -> source column (or ``"1"`` for a row count).  ``order_cols``
    must be unique (within a group) for the result to be deterministic.  A group may span several
    ranges: its offset then comes from the ranges before.
    """
    groups = list(groups or [])
    srcs = {o: (F.lit(1).cast("long") if s == "1" else F.col(s)) for o, s in sum_cols.items()}
    order = _order(order_cols, ascending)
    upto = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if partitions == 1:
        return df.select("*", *[F.sum(e).over(upto).alias(o) for o, e in srcs.items()])
    keys = [*[F.col(g).asc_nulls_last() for g in groups], *order]
    s = df.select("*", *[e.alias("_s_" + o) for o, e in srcs.items()])
    s = _ranges(s, keys, partitions)
    added = written(_local_sums(s, groups, list(srcs)), "ranges")
    # one row per range and group in it: the groups of a range are few, or end in it
    totals = added.groupBy(*groups, "_range").agg(*[F.sum("_s_" + o).alias("_t_" + o) for o in srcs])
    before = (Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(g).alias("_g_" + g) for g in groups], F.col("_range").alias("_r"), *[
        F.coalesce(F.sum("_t_" + o).over(before), F.lit(0)).alias("_o_" + o) for o in srcs])
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col("_g_" + g))
    return added.join(offsets, same).select(*df.columns, *[
        (F.col("_l_" + o) + F.col("_o_" + o)).alias(o) for o in srcs])


def _ranges(df: DataFrame, keys: list[Column], partitions: int | None) -> DataFrame:
    """Rows dealt by ranges of ``keys``, in that order, with the number of their range."""
    s = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return s.sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())


def _local_sums(s: DataFrame, groups: list[str], outs: list[str]) -> DataFrame:
    """Add ``_l_<out>``: the sum of ``_s_<out>`` over the task's rows so far, anew for every group."""
    ship_code(s.sparkSession)
    names = s.columns
    kinds = {o: s.schema["_s_" + o].dataType for o in outs}
    whole = {o: isinstance(k, T.IntegralType) for o, k in kinds.items()}

    def run(batches):
        held, sums = None, {o: 0 for o in outs}          # group of the last row, its sums
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for g in groups:
                col = b.column(names.index(g))
                codes = pc.dictionary_encode(col, null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = [b.column(names.index(g))[0].as_py() for g in groups]
            new[0] = held is not None and first != held
            starts = np.flatnonzero(new)
            cols = []
            for o in outs:
                kind = pa.int64() if whole[o] else pa.float64()
                x = pc.fill_null(b.column(names.index("_s_" + o)).cast(kind), 0).to_numpy(zero_copy_only=False)
                if whole[o]:
                    run_sum = np.cumsum(x)
                    # what the rows before a group's first one add up to
                    off = np.zeros(len(x), np.int64)
                    off[starts] = np.diff(np.r_[-sums[o], run_sum[starts] - x[starts]])
                    out = run_sum + sums[o] - np.cumsum(off)
                else:
                    out = np.concatenate([np.cumsum(np.r_[sums[o] if k == 0 and not new[0] else 0.0, part])[1:]
                                          for k, part in enumerate(np.split(x, starts[starts > 0]))])
                sums[o] = out[-1].item()
                cols.append(pa.array(out))
            held = [b.column(names.index(g))[b.num_rows - 1].as_py() for g in groups]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, *("_l_" + o for o in outs)])

    schema = T.StructType(list(s.schema.fields) + [
        T.StructField("_l_" + o, T.LongType() if whole[o] else T.DoubleType()) for o in outs])
    return s.mapInArrow(run, schema)


def carried(df: DataFrame, col: str, order_cols: list[str], ascending: bool = True,
            partitions: int | None = None) -> DataFrame:
    """Replace NULLs of ``col`` by the last value before them in the order of ``order_cols``.

    A task fills from its own rows; a range that begins with NULLs takes the last value of the
    nearest range before it that has one, found over one row per range."""
    ship_code(df.sparkSession)
    s = _ranges(df, _order(order_cols, ascending), partitions)
    names, at = s.columns, s.columns.index(col)

    def run(batches):
        last, row = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            values = pc.fill_null_forward(b.column(at))
            if last is not None:
                values = pc.fill_null(values, last)
            if values[b.num_rows - 1].is_valid:
                last = values[b.num_rows - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], values, *b.columns[at + 1:],
                                              pa.array(np.arange(row, row + b.num_rows))], [*names, "_row"])
            row += b.num_rows

    filled = written(s.mapInArrow(run, T.StructType([*s.schema.fields, T.StructField("_row", T.LongType())])), "carried")
    # one row per range: its last row holds its last value
    ends = filled.groupBy("_range").agg(F.max_by(col, "_row").alias("_end"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("_range").alias("_r"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return filled.join(F.broadcast(carry), F.col("_range") == F.col("_r")).select(*[
        F.coalesce(F.col(c), F.col("_carry")).alias(c) if c == col else F.col(c) for c in df.columns])


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "rn", ascending: bool = True,
                      partitions: int | None = None) -> DataFrame:
    """1-based row number over the total order ``order_cols`` (E1, F1): one exchange of the rows."""
    return running_sums(df, order_cols, {out: "1"}, ascending, partitions)
