"""Column expressions shared by the operators.  All JVM-side built-ins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_LABEL = "NaN"          # label of the missing bin in binned data
NULL_VALUE = "NULL"            # value label of missing cells in IV tables


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL where b is 0 (pandas gives inf/NaN there)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def woe(dist_good, dist_bad) -> Column:
    """ln(dist_good / dist_bad); 0 where either share is 0 (pure values add no IV)."""
    g, b = col(dist_good), col(dist_bad)
    return F.when((g > 0) & (b > 0), F.log(g / b)).otherwise(F.lit(0.0))


def odds(rate) -> Column:
    """rate / (1 - rate); NULL where rate = 1."""
    r = col(rate)
    return F.try_divide(r, F.lit(1.0) - r)


def fmt_num(x: float) -> str:
    """Python float text, as in an interval label: 0.0, 2500.0, inf, -inf."""
    x = float(x)
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return repr(x)


def interval_label(lo: float, hi: float) -> str:
    """Right-closed interval label ``(lo, hi]``."""
    return f"({fmt_num(lo)}, {fmt_num(hi)}]"


def members_label(members) -> str:
    """Label of a categorical bin: its members in order, ``['a' 'b']``."""
    return "[" + " ".join(f"'{m}'" for m in members) + "]"


def norm_zero(c) -> Column:
    """-0.0 -> 0.0 so that equal numbers render to the same text."""
    return col(c) + F.lit(0.0)
