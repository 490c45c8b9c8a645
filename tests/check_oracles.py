"""Run every registered query against its oracle: ``python tests/check_oracles.py [sf_dir] [key...]``."""

from __future__ import annotations

import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from riskcard.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if k in sql:
                r = compare(df, con, sql[k])
            else:
                r = {"rows_spark": df.count(), "ok": True, "rows_only": True}
        except Exception as e:  # report and go on
            r = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:800]}"}
            traceback.print_exc(limit=3)
        r["sec"] = round(time.time() - t, 2)
        bad += 0 if r["ok"] else 1
        print(k, json.dumps(r, default=str), flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
