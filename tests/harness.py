"""Compare a Spark query with its DuckDB oracle: row count, schema, value hash.

Values are normalised the same way on both sides (doubles to 6 places, -0.0
to 0.0, timestamps to text), rows sorted, then hashed.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"   # compare doubles exactly, no re-rounding


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        r = v if STRICT else round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = [tuple(_norm(r[i]) for i in order) for r in rows]
    keyed.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return hashlib.sha256(repr(keyed).encode()).hexdigest()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
                 "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_types = {f.name.lower(): SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c.lower(): str(t) for c, t in zip(d_cols, rel.types)}
    d_rows = rel.fetchall()
    out = {"rows_spark": len(s_rows), "rows_oracle": len(d_rows)}
    out["cols_match"] = sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols)
    out["types_match"] = s_types == d_types
    if not out["types_match"]:
        out["types"] = {k: (s_types.get(k), d_types.get(k)) for k in set(s_types) | set(d_types)
                        if s_types.get(k) != d_types.get(k)}
    lc_s = [c.lower() for c in s_cols]
    lc_d = [c.lower() for c in d_cols]
    out["hash_match"] = out["cols_match"] and digest(lc_s, s_rows) == digest(lc_d, d_rows)
    out["ok"] = out["hash_match"] and out["rows_spark"] == out["rows_oracle"]
    if not out["ok"]:
        out["sample_spark"] = sorted(map(repr, s_rows))[:3]
        out["sample_oracle"] = sorted(map(repr, d_rows))[:3]
    return out
