"""Table scans (A1-A3): pick a reader from the file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extension -> Spark data source format.
READERS = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".json": "json",
    ".orc": "orc",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reader_format(path: str) -> str:
    """Case-insensitive extension match; unknown extensions raise."""
    low = path.lower().rstrip("/")
    for ext, fmt in READERS.items():
        if low.endswith(ext):
            return fmt
    raise ValueError(f"unsupported file type: {path!r}; expected one of {sorted(READERS)}")


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None,
         bad_lines: str | None = None) -> DataFrame:
    """Read any supported file or folder.  CSV has a header row; types are
    inferred unless a schema is given (inference costs one extra pass, so pass
    a schema for large inputs).

    ``bad_lines`` names a further column for CSV and JSON with a schema: the text of a line that does
    not fit the schema, NULL for all others.  Fields of such a line that cannot be read are NULL.
    """
    fmt = reader_format(path)
    reader = spark.read.format(fmt)
    if bad_lines is not None:
        if fmt not in ("csv", "json") or schema is None:
            raise ValueError("bad lines are captured from csv or json with a declared schema")
        schema = T.StructType([*schema.fields, T.StructField(bad_lines, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_lines)
    if fmt == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def line_counts(scanned: DataFrame, bad_lines: str) -> DataFrame:
    """(feature, lines, bad, nulls) per column of a scan with ``bad_lines``: all lines, those that do not fit
    the schema, and the column's NULLs among all, in one pass."""
    cols = [c for c in scanned.columns if c != bad_lines]
    counts = scanned.agg(F.count(F.lit(1)).alias("lines"), F.count(bad_lines).alias("bad"),
                         *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot(["lines", "bad"], cols, "feature", "nulls").select("feature", "lines", "bad", "nulls")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN means missing in the input model; make it SQL NULL once at ingest."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not fl:
        return df
    return df.select([
        (F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in fl else F.col(c))
        for c in df.columns
    ])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


# Column names of a variable dictionary file and our names for them.
DICTIONARY_COLUMNS = {"Variable Name (ReNamed)": "variable", "Type": "type", "Sign": "sign"}


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A variable dictionary (variable, type, sign) from a file of any readable kind (A4)."""
    d = scan(spark, path)
    return d.select(*[F.col(f"`{c}`").alias(DICTIONARY_COLUMNS.get(c, c)) for c in d.columns]).select(
        "variable", "type", "sign")
