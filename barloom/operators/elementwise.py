"""Functions of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import INF, col, ieee_log


def mean(x1, x2) -> Column:
    return (col(x1) + col(x2)) / F.lit(2.0)


def sign(x) -> Column:
    return F.signum(col(x))


def abs_(x) -> Column:
    return F.abs(col(x))


def sign_power(x, p: float) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(float(p)))


def log(x) -> Column:
    return ieee_log(x)


def tanh(x) -> Column:
    return F.tanh(col(x))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def bigger(x1, x2) -> Column:
    """The greater of two; a null is passed over."""
    return F.greatest(col(x1), col(x2))


def smaller(x1, x2) -> Column:
    return F.least(col(x1), col(x2))


def inf_mask(x) -> Column:
    """Null for an infinity; NaN stays."""
    x = col(x)
    return F.when(F.abs(x) == F.lit(INF), F.lit(None).cast("double")).otherwise(x)


def pos_part(x) -> Column:
    """max(x, 0); 0 for null."""
    return F.greatest(col(x), F.lit(0.0))


def neg_part(x) -> Column:
    """|min(x, 0)|; 0 for null."""
    return F.abs(F.least(col(x), F.lit(0.0)))
