"""Scoring a stream (section 2.13): the batch scoring functions on a streaming DataFrame.

Scoring is stateless, so no watermark or state store is involved: orders
arrive as a Parquet stream, customer and the per-order line aggregate are
static sides of stream-static joins, and the points are the same projection
as in batch.  Output and checkpoint live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskcard.operators import prep
from riskcard.operators.bins import apply_bins
from riskcard.operators.points import Scorecard, score_expr
from riskcard.plans.prefix import written
from riskcard.session import scratch_path
from riskcard.sources import fixture as FX
from riskcard.sources.tables import read_table


def application_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The applications table with ``orders`` read as a stream.

    The line-item aggregate is a static side: it is written once, not recomputed per micro-batch.
    """
    schema = read_table(spark, sf_dir, "orders").schema
    # a file stream watches a folder; the glob keeps it to the orders file(s)
    orders = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .option("pathGlobFilter", "*.parquet").parquet(_orders_folder(sf_dir)))
    return FX.applications_from(orders, read_table(spark, sf_dir, "customer"),
                                written(FX.order_items(spark, sf_dir), "order-items"))


def _orders_folder(sf_dir: str) -> str:
    """Glob of the orders table, a file or a folder of files."""
    return f"{sf_dir.rstrip('/')}/orders.parquet*"


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream to completion (available-now trigger) into a Parquet sink and read it back."""
    spark = df.sparkSession
    out = scratch_path(spark, f"{name}-out")
    q = (df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, f"{name}-ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(df.schema).parquet(out)


def stream_scores(spark: SparkSession, sf_dir: str, sc: Scorecard) -> DataFrame:
    """Sentinels to NULL and row scores on a stream."""
    src = prep.replace_sentinels(application_stream(spark, sf_dir))
    return drain(src.select(FX.ID, score_expr(sc).alias("score")), "stream-score")


def stream_binned(spark: SparkSession, sf_dir: str, bins: list) -> DataFrame:
    """Sentinels to NULL and bin labels on a stream."""
    src = prep.replace_sentinels(application_stream(spark, sf_dir))
    return drain(apply_bins(src, bins, keep=[FX.ID, FX.TARGET]), "stream-binned")
