"""Cleaning and column roles.

Name and type rules need no job: they read the schema.  Null fractions and the
binary-value test are one aggregate each, over all columns at once.  Those two
aggregates return one number per column, so collecting them is bounded by the
schema width, never by the row count.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier columns dropped by name (exact match).
ID_NAMES = [
    "MBID", "Sequence_Number", "Application_Number", "Application_Type",
    "Renewal_Application_Number", "Original_Application_Number", "Merchant_Number",
    "MicroBilt_Inquiry_ID", "Marketing_Description", "Application_Status", "Funded_Status",
    "Applicant_Last_Name", "Applicant_First_Name", "Applicant_Middle_Name", "Applicant_Suffix",
    "Applicant_Address_1", "Applicant_City", "Applicant_State", "Applicant_Postal_Code",
    "Applicant_Postal_Code___4", "Applicant_ID_Country", "Applicant_ID_Type", "Applicant_SSN",
    "Applicant_Home_Phone", "Applicant_Work_Phone", "Applicant_Mobile_Phone",
    "Applicant_Email_Address", "Applicant_ABA_Number", "Applicant_Account_Number",
    "Applicant_Date_of_Birth", "Loan_Number", "Loan_Rollover_Refinance_Number",
    "Loan_Status_Date", "SSN", "LOAN_CODE", "year", "lyear", "Address1_App",
    "Charged_Off_Flag", "LastName_App", "LeadID", "PostalCode_App", "FirstName_App",
    "CustSSN_APP", "HomePhone_App", "City_App", "WorkPhone_App", "State_App",
]

# State / macro-economic columns dropped by name (exact match).
# 'lyear' and 'REALGDPPERCAPITAPCTCHGY' are two separate entries here.
STATE_NAMES = [
    "HH_TOTALALLCREDIT_SEVEREDEROG", "HIGHCRD_NONMTGCREDIT", "INQUIRY_CONSUMERFINANCE",
    "NUM_CONSUMERFINANCE_60DPD", "NUM_OTHERNONMTG_NEW", "PRCNT_INQUIRIES", "LastReportPeriod",
    "DATE", "BUSAPPPCTCHGY_U", "HIGHPROPRBUSAPPPCTCHGY_S", "BUSAPPPLANNEDWAGESPCTCHGY_S",
    "HIRES_RATE_S", "JOB_OPENINGS_RATE_S", "QUITS_RATE_S", "JOB_OPENINGS_PCTCHGY_S",
    "LFPARTRATE_S", "lmonth", "lyear", "REALGDPPERCAPITAPCTCHGY", "GDPPERCAPITAPCTCHGY",
    "PERSINCPERCAPITAPCTCHGY", "XBUSAPPPCTCHGY_U", "XHIGHPROPRBUSAPPPCTCHGY_S",
    "XBUSAPPPLANNEDWAGESPCTCHGY_S", "XHIRES_RATE_S", "XJOB_OPENINGS_RATE_S", "XQUITS_RATE_S",
    "XJOB_OPENINGS_PCTCHGY_S", "XLFPARTRATE_S", "XREALGDPPERCAPITAPCTCHGY",
    "XGDPPERCAPITAPCTCHGY", "XPERSINCPERCAPITAPCTCHGY",
]

# Name fragments and names of the other drop rules (case-sensitive).
SCORE_FRAGMENTS = ["score", "SCORE", "Score"]
SCORE_NAMES = ["p_0", "p_1"]
INTEGRATOR_NAMES = ["NAP", "NAS", "CVI"]
STATE_FRAGMENTS = ["_S", "GDP"]
CL_FRAGMENTS = ["CL"]
DATE_FRAGMENTS = ["ELJFILINGDT", "ELJRLSDT", "MBBKRLSDT", "DATE", "date", "Date", "DT"]

# Whole-cell strings that mean "missing".
SENTINELS = [".", "NULL"]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _has(name: str, fragments) -> bool:
    return any(re.search(re.escape(f), name) for f in fragments)


def drop_reason(field: T.StructField) -> str | None:
    """Why a column is dropped by the name/type rules, or None."""
    n = field.name
    if n in ID_NAMES:
        return "identifier"
    if _has(n, SCORE_FRAGMENTS) or n in SCORE_NAMES:
        return "score"
    if n in INTEGRATOR_NAMES:
        return "integrator"
    if _has(n, STATE_FRAGMENTS) or n in STATE_NAMES:
        return "state"
    if _has(n, CL_FRAGMENTS):
        return "cl"
    if isinstance(field.dataType, DATE_TYPES) or _has(n, DATE_FRAGMENTS):
        return "date"
    return None


def checked_target(df: DataFrame, target: str) -> DataFrame:
    """The table with its target as 0/1 integers; an error for any other value (one aggregate).

    Targets come as integers, decimals, doubles or booleans (CSV and Parquet writers differ)."""
    kind = df.schema[target].dataType
    if not isinstance(kind, (*NUMERIC_TYPES, T.BooleanType)):
        raise ValueError(f"target {target} is {kind.simpleString()}: a number or boolean is needed")
    y = F.col(target).cast("double")
    bad = df.agg(F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("n")).head()[0]
    if bad:
        raise ValueError(f"target {target}: {bad} rows are neither 0 nor 1")
    return df.withColumn(target, F.col(target).cast("int"))


def replace_sentinels(df: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """Whole-cell sentinel strings become NULL on string columns."""
    strs = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select([
        (F.when(~F.col(c).isin(list(sentinels)), F.col(c)).alias(c) if c in strs else F.col(c))
        for c in df.columns])


def null_fractions(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, null_fraction): one aggregate over all columns, then unpivot."""
    n = F.count(F.lit(1))
    agg = df.agg(*[(F.sum(F.col(c).isNull().cast("long")) / n).alias(c) for c in cols])
    return agg.unpivot([], cols, "feature", "null_fraction")


def sparse_columns(df: DataFrame, cols: list[str], threshold: float = 0.95) -> DataFrame:
    """(feature, null_fraction, dropped): dropped when the fraction is strictly above."""
    _check_threshold(threshold)
    return null_fractions(df, cols).withColumn(
        "dropped", (F.col("null_fraction") > F.lit(float(threshold))).cast("int"))


def _check_threshold(threshold: float):
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("sparse_threshold is a fraction in [0, 1]")


def rule_filtered(df: DataFrame, target: str, id_col: str | None = None,
                  sentinels=SENTINELS) -> DataFrame:
    """Name/type rules (no job) and sentinels -> NULL; id first, target last."""
    keep = [f.name for f in df.schema.fields
            if f.name not in (target, id_col) and drop_reason(f) is None]
    return replace_sentinels(df.select(*([id_col] if id_col else []), *keep, target), sentinels)


def drop_sparse(df: DataFrame, target: str, id_col: str | None = None,
                sparse_threshold: float = 0.95) -> DataFrame:
    """Sparse rule (one aggregate), surviving columns sorted, target last."""
    _check_threshold(sparse_threshold)
    keep = [c for c in df.columns if c not in (target, id_col)]
    if keep:
        fr = null_fractions(df, keep).collect()  # one row per column
        sparse = {r["feature"] for r in fr if r["null_fraction"] is not None
                  and r["null_fraction"] > sparse_threshold}
    else:
        sparse = set()
    survivors = sorted(c for c in keep if c not in sparse)
    return df.select(*([id_col] if id_col else []), *survivors, target)


def clean_columns(df: DataFrame, target: str, id_col: str | None = None,
                  sparse_threshold: float = 0.95, sentinels=SENTINELS) -> DataFrame:
    """Name/type rules, sentinels -> NULL, sparse rule; columns sorted, target last.

    The id column (our replacement for the row index) is kept first.
    """
    _check_threshold(sparse_threshold)
    return drop_sparse(rule_filtered(df, target, id_col, sentinels), target, id_col, sparse_threshold)


def exclude_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """User exclusion list."""
    return df.drop(*names)


def column_roles(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, role): numeric, categorical or dropped.

    Numeric columns holding only {0, 1, NULL} (an all-NULL column included) are
    categorical; strings and booleans are categorical; other types are dropped.
    One aggregate pass decides all numeric columns at once.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for c in cols:
        t = fields[c]
        if isinstance(t, NUMERIC_TYPES):
            binary = F.min(F.when(F.col(c).isNull() | F.col(c).isin(0, 1), 1).otherwise(0))
            e = F.when(F.coalesce(binary, F.lit(1)) == 1, "categorical").otherwise("numeric")
        elif isinstance(t, (T.StringType, T.BooleanType)):
            e = F.lit("categorical")
        else:
            e = F.lit("dropped")
        exprs.append(e.alias(c))
    return df.agg(*exprs).unpivot([], cols, "feature", "role")


# The dictionary type that counts as numeric although it says "Character".
NUMERIC_CHAR_TYPE = "Character (#,###.##)"


def dictionary_roles(dict_df: DataFrame, spark: SparkSession, extra_desc=(), extra_asc=(),
                     name_col="variable", type_col="type", sign_col="sign") -> DataFrame:
    """(feature, role) from a variable dictionary.

    num_desc: numeric type and sign '>'; num_asc: numeric and '<';
    cat_y / cat_n: character type (not the numeric-character one) and 'Y' / 'N'.
    Caller additions are appended as num_desc / num_asc.
    """
    t, s = F.col(type_col), F.col(sign_col)
    is_num = F.coalesce(t.contains("Num"), F.lit(False)) | F.coalesce(t == NUMERIC_CHAR_TYPE, F.lit(False))
    is_cat = F.coalesce(t.contains("Char") & (t != NUMERIC_CHAR_TYPE), F.lit(False))
    role = (F.when(is_num & (s == ">"), "num_desc").when(is_num & (s == "<"), "num_asc")
            .when(is_cat & (s == "Y"), "cat_y").when(is_cat & (s == "N"), "cat_n"))
    roles = dict_df.select(F.col(name_col).alias("feature"), role.alias("role")).filter(F.col("role").isNotNull())
    extra = [(f, "num_desc") for f in extra_desc] + [(f, "num_asc") for f in extra_asc]
    if extra:
        roles = roles.unionByName(spark.createDataFrame(extra, "feature string, role string"))
    return roles


def check_directions(roles: DataFrame) -> None:
    """A feature may not be both ascending and descending."""
    both = (roles.filter(F.col("role").isin("num_asc", "num_desc"))
            .groupBy("feature").agg(F.countDistinct("role").alias("k"))
            .filter("k > 1").collect())          # at most one row per feature
    if both:
        raise ValueError(f"features listed both ascending and descending: {[r[0] for r in both]}")


def roles_in_data(dict_roles: DataFrame, data_roles: DataFrame) -> DataFrame:
    """Dictionary roles restricted to features the data supports (left semi-join, C10)."""
    kind = F.when(F.col("role").startswith("num"), "numeric").otherwise("categorical")
    d = dict_roles.withColumn("_kind", kind)
    r = data_roles.select(F.col("feature").alias("_f"), F.col("role").alias("_kind"))
    return d.join(r, (F.col("feature") == F.col("_f")) & (d["_kind"] == r["_kind"]), "left_semi") \
            .drop("_kind")


def new_predictors(data_roles: DataFrame, dict_df: DataFrame, name_col="variable") -> DataFrame:
    """Numeric columns not described by the dictionary (B16, C9 anti-join)."""
    num = data_roles.filter(F.col("role") == "numeric").select("feature")
    return num.join(dict_df.select(F.col(name_col).alias("feature")), "feature", "left_anti")


def presence_features(categorical: DataFrame, names: list[str], spark: SparkSession) -> DataFrame:
    """Which categorical features get a presence flag (C10/G3 semi-join with a name list)."""
    lst = spark.createDataFrame([(n,) for n in names], "feature string")
    return categorical.select("feature").join(lst, "feature", "left_semi")
