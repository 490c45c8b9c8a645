"""Report sink (A5-A9): each report table written as Parquet under one run folder.

The spreadsheet of the reference becomes a folder of tables: named tables
plus one long bin table partitioned by feature, numbers rounded half-even to
4 places before export.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskcard.session import ensure_checkpoint_dir

# Fixed value: the run name's date format.
RUN_FORMAT = "dd-MM-yyyy_HH-mm-ss"     # Spark pattern of %d-%m-%Y_%H-%M-%S


def run_name(project: str, when: datetime | None = None) -> str:
    """``<project>_dd-mm-YYYY_HH-MM-SS``."""
    when = when or datetime.now()
    return f"{project}_{when.strftime('%d-%m-%Y_%H-%M-%S')}"


def run_name_col(project: str, ts_col: str):
    return F.concat(F.lit(project + "_"), F.date_format(F.col(ts_col), RUN_FORMAT))


def round_for_export(df: DataFrame, digits: int = 4) -> DataFrame:
    """Half-even rounding of floating columns."""
    return df.select([
        (F.bround(F.col(f.name), digits).alias(f.name)
         if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name))
        for f in df.schema.fields])


MANIFEST = "_manifest"


def write_report(spark: SparkSession, tables: dict[str, DataFrame], bin_table: DataFrame | None = None,
                 base: str | None = None, project: str = "scorecard") -> str:
    """Write every table; the bin table is one long table partitioned by feature.

    The manifest (table_name, folder, rows) is written last and readers trust only it: a run that stops
    halfway leaves no report.  Where the folder holds a finished report, the new tables go beside the old
    ones (``<table>-<run>``), and the old report stays until the new manifest replaces its own."""
    root = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{run_name(project)}-{uuid.uuid4().hex[:8]}"
    beside, rows = f"-{uuid.uuid4().hex[:12]}" if _finished(spark, root) else "", []
    for name, df in {**tables, **({} if bin_table is None else {"bins": bin_table})}.items():
        folder = f"{name}{beside}"
        seen = Observation(name)
        out = round_for_export(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        (out.partitionBy("feature") if name == "bins" else out).parquet(f"{root}/{folder}")
        rows.append((name, folder, int(seen.get["rows"])))
    (spark.createDataFrame(rows, "table_name string, folder string, rows long").coalesce(1)
     .write.mode("overwrite").json(f"{root}/{MANIFEST}"))
    return root


def _finished(spark: SparkSession, root: str) -> bool:
    try:
        return not report_manifest(spark, root).isEmpty()
    except (AnalysisException, ValueError):
        return False


def report_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, folder, rows) of a finished report; an error if there is none."""
    found = spark.read.schema("table_name string, folder string, rows long").json(f"{root}/{MANIFEST}")
    if found.isEmpty():
        raise ValueError(f"no finished report in {root}")
    return found


def read_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a finished report."""
    at = report_manifest(spark, root).where(F.col("table_name") == name).first()
    if at is None:
        raise ValueError(f"no table {name!r} in the report {root}")
    return spark.read.parquet(f"{root}/{at.folder}")


def export_text(df: DataFrame, name: str):
    """The text of a cell as exported: floating numbers have 1 to 4 decimals."""
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).cast("string")
    digits = F.rtrim(F.bround(F.col(name).cast("double"), 4).cast("decimal(38,4)").cast("string"), F.lit("0"))
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def column_widths(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, max_len) of the exported text of each column."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.max(F.length(export_text(df, c))).cast("long").alias(c) for c in cols])
    return agg.unpivot([], cols, "feature", "max_len")
