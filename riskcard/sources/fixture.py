"""The ``applications`` table and the fixed metadata used by the test queries.

``applications`` is a loan-like table derived from the driver tables (orders,
customer, lineitem); its work grows with them.  The dictionary and the fixed
scorecard are small metadata, the same on both sides of every oracle check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.operators.bins import CategoricalBins, NumericBins
from riskcard.sources.tables import read_table

ID = "app_id"
TARGET = "pi"


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read_table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_items"),
                 F.sum("l_quantity").alias("qty"),
                 F.round(F.avg("l_discount"), 6).alias("avg_disc")))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications_from(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"),
                             order_items(spark, sf_dir))


def applications_from(orders: DataFrame, customer: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order: identifiers, a date, a score-like column, numeric and
    categorical predictors with missing values and sentinels, and a 0/1 target."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                           "o_orderpriority")
    customer = customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    j = (orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
         .join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left"))
    k = F.col("o_orderkey")
    prio, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    latent = (F.lit(8.0) * F.coalesce(F.col("n_items"), F.lit(2))
              - F.col("c_acctbal") / F.lit(250.0)
              + F.col("o_totalprice") / F.lit(20000.0)
              + F.when(prio == "1-URGENT", 15.0).when(prio == "5-LOW", -10.0).otherwise(0.0)
              + F.when(seg == "MACHINERY", 10.0).when(seg == "BUILDING", -6.0).otherwise(0.0)
              + (k * 7919 % 101))
    return j.select(
        k.alias(ID),
        F.col("c_custkey").alias("MBID"),
        F.col("o_orderdate").alias("opened"),
        (F.lit(1) + k % 9).alias("ext_score"),
        F.when(k % 20 != 3, F.col("o_totalprice")).alias("total_price"),
        F.when(k % 25 != 4, F.col("c_acctbal")).alias("acct_bal"),
        "n_items", "qty", "avg_disc",
        F.when(k % 100 >= 97, F.col("o_totalprice")).alias("sparse_x"),
        F.when(k % 30 == 7, F.lit(".")).when(k % 45 == 11, F.lit("NULL")).otherwise(seg).alias("segment"),
        prio.alias("priority"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_f"),
        F.when(latent > 95.0, 1).otherwise(0).alias(TARGET),
    )


def informative_gaps(df: DataFrame) -> DataFrame:
    """Two columns whose missing rows follow the target: the values say nothing, the gaps do."""
    k = F.col(ID)
    gap = ((F.col(TARGET) == 1) & (k % 10 < 7)) | ((F.col(TARGET) == 0) & (k % 10 < 2))
    return (df.withColumn("gap_num", F.when(~gap, (k * 31 % 1000).cast("double")))
            .withColumn("gap_cat", F.when(~gap, F.concat(F.lit("g"), (k * 17 % 6).cast("string")))))


def order_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, brand): the smallest brand among an order's parts, a many-level category."""
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias(ID))
            .agg(F.min("p_brand").alias("brand")))


# The variable dictionary fixture (name, type, sign).
DICTIONARY_ROWS = [
    ("acct_bal", "Numeric", ">"),
    ("total_price", "Numeric", "<"),
    ("n_items", "Character (#,###.##)", "<"),
    ("qty", "Numeric", "<"),
    ("priority", "Char", "Y"),
    ("segment", "Char", "N"),
    ("unused", None, ">"),
]

DICTIONARY_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("sign", T.StringType()),
])


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY_ROWS, DICTIONARY_SCHEMA)


# The fixed scorecard used by the oracle queries.  Bins are
# right-closed; weights are bad log-odds coefficients; 'NaN' is the missing bin.
SCORECARD_BINS = [
    NumericBins("acct_bal", (0.0, 2500.0, 5000.0, 7500.0)),
    NumericBins("total_price", (100000.0, 200000.0, 300000.0, 400000.0)),
    NumericBins("n_items", (2.0, 4.0, 6.0)),
    CategoricalBins("priority", (("1-URGENT",), ("5-LOW",), ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))),
    CategoricalBins("segment", (("MACHINERY",), ("BUILDING",), ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD"))),
]
SCORECARD_INTERCEPT = -0.7
# feature -> weights per bin in bin order, then the weight of the 'NaN' bin
SCORECARD_WEIGHTS = {
    "acct_bal": ([0.9, 0.4, 0.0, -0.5, -1.1], 0.1),
    "total_price": ([-0.6, -0.2, 0.1, 0.3, 0.7], 0.0),
    "n_items": ([-0.9, -0.1, 0.6, 1.3], -0.6),
    "priority": ([0.8, -0.6, 0.0], 0.0),
    "segment": ([0.5, -0.3, 0.0], 0.0),
}
# A second, smaller scorecard: only two of the features (for grid_quality).
REDUCED_FEATURES = ("acct_bal", "n_items")

PRESENCE_FEATURES = ["segment"]
EXCLUDED = ["MBID", "opened", "sparse_x"]
