"""IEEE arithmetic on columns and other shared pieces.

ANSI division throws on zero and several built-ins give null where floating point gives NaN or an
infinity; these helpers keep null (missing) and NaN (undefined) apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fdiv(a: str | Column, b: str | Column) -> Column:
    """a / b by IEEE rules: 0/0 is NaN, x/0 an infinity, null if either is null.

    Each side is named twice, no more: a window function among them is computed as often as it is named.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.coalesce(F.try_divide(a, b), a * F.when(b == 0, F.lit(INF)))


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body(*values) with each value computed once, however often the body names it.

    Spark computes a window function at every place that names it. The body is the function of a one-element
    transform, which leaves code generation: worth it for values that hold window functions alone.
    """
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda s: body(*[s.getField(f"v{i}") for i in range(len(values))])), 0)


def fdiv_once(a: Column, b: Column) -> Column:
    """fdiv of sides that hold window functions."""
    return let(fdiv, a, b)


def ieee_log(x: str | Column) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    x = col(x).cast("double")
    return F.when(F.isnan(x), x).when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def nan_where_null(value: Column, defined: Column) -> Column:
    """NaN where a built-in gives null although enough values are there."""
    return F.when(defined & value.isNull(), F.lit(NAN)).otherwise(value)


def pair(x: Column, y: Column) -> tuple[Column, Column]:
    """Both columns where neither is null."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(x: Column, y: Column, over=lambda c: c) -> Column:
    """Pearson correlation of complete pairs: NaN for a constant side, where the built-in throws. `over` puts a window on each aggregate."""
    x, y = pair(x, y)
    return fdiv(over(F.covar_samp(x, y)), over(F.stddev_samp(x)) * over(F.stddev_samp(y)))
