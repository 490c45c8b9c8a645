"""Physical-plan checks: no raw-row single-partition exchanges, pruned scans."""

import re

import pytest
from conftest import SMALL

from riskcard.plans import catalog as C


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_inputs(text: str) -> list[str]:
    """Operator directly under every ``Exchange SinglePartition``."""
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            for nxt in lines[i + 1:]:
                op = re.sub(r"^[\s:+\-*()\d]*", "", nxt)
                if op:
                    out.append(op.split("(")[0].split(" ")[0])
                    break
    return out


@pytest.mark.parametrize("key", ["ks_table_score", "ppt_table", "auc_gini", "roc_curve", "ranked_rows",
                                 "ks_table_deciles", "iv_by_feature", "score_histogram"])
def test_single_partition_only_above_aggregates(spark, key):
    df = C.QUERIES[key](spark, SMALL)
    ops = single_partition_inputs(plan(df))
    assert all(op in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") for op in ops), ops


def test_scoring_is_one_pass_without_shuffle_of_rows(spark):
    text = plan(C.q_score_rows_wide(spark, SMALL))
    # only the line-item aggregate of the fixture shuffles; scoring itself adds none
    assert text.count("Exchange hashpartitioning") <= 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderpriority:string>" in \
        C.q_score_rows_wide(spark, SMALL)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
