"""Rolling operators: along each instrument, by date. Column names or Columns in, Columns out.

Windows are counts of rows. A rolling value is null until its window holds n values that are not null.
Expressions nest; for many factors, plan them in stages (see barloom.jobs.research).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.numeric import NAN, col, fdiv, fdiv_once, let
from barloom.operators.scans import decayed_means

DATE, INSTRUMENT = "date", "instrument"
#: Makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def along():
    return Window.partitionBy(INSTRUMENT).orderBy(DATE)


def last_rows(n: int):
    return along().rowsBetween(-(n - 1), 0)


def _full(x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(last_rows(n)) == n, value)


def _rolled(x: str | Column, n: int, agg) -> Column:
    x = col(x)
    return _full(x, n, agg(x).over(last_rows(n)))


def ts_delay(x, n: int) -> Column:
    return F.lag(col(x), n).over(along())


def ts_delta(x, n: int) -> Column:
    return col(x) - ts_delay(x, n)


def ts_returns(x, n: int) -> Column:
    x = col(x)
    return let(lambda now, then: fdiv(now - then, then), x, ts_delay(x, n))


def ts_sum(x, n: int) -> Column:
    return _rolled(x, n, F.sum)


def ts_product(x, n: int) -> Column:
    """The true product of the window; a zero does not spoil later windows."""
    return _rolled(x, n, F.product)


def ts_max(x, n: int) -> Column:
    return _rolled(x, n, F.max)


def ts_min(x, n: int) -> Column:
    return _rolled(x, n, F.min)


def ts_mean(x, n: int) -> Column:
    return _rolled(x, n, F.avg)


def ts_median(x, n: int) -> Column:
    return _rolled(x, n, lambda c: F.percentile(c, F.lit(0.5)))


def ts_std(x, n: int) -> Column:
    return _rolled(x, n, F.stddev_samp)


def ts_variance(x, n: int) -> Column:
    return _rolled(x, n, F.var_samp)


def ts_skew(x, n: int) -> Column:
    """Population skewness; NaN for a constant window."""
    x = col(x)
    return _full(x, n, F.coalesce(F.skewness(x).over(last_rows(n)), F.lit(NAN)))


def ts_kurt(x, n: int) -> Column:
    """Population excess kurtosis; NaN for a constant window."""
    x = col(x)
    return _full(x, n, F.coalesce(F.kurtosis(x).over(last_rows(n)), F.lit(NAN)))


def _sorted(x: Column, n: int) -> Column:
    return F.sort_array(F.collect_list(x).over(last_rows(n)))


def ts_quantile(x, n: int, q: float) -> Column:
    """The value nearest to a quantile of the window."""
    x = col(x)
    return _full(x, n, F.get(_sorted(x, n), round((n - 1) * q)))


def ts_quantile_up(x, n: int) -> Column:
    return ts_quantile(x, n, 0.75)


def ts_quantile_down(x, n: int) -> Column:
    return ts_quantile(x, n, 0.25)


def ts_rank(x, n: int) -> Column:
    """Share of the window that is at most the present value; NaN for a present NaN."""
    x = col(x)
    window = F.collect_list(x).over(last_rows(n))
    below = F.size(F.filter(window, lambda e: (e <= x) & ~F.isnan(e)))
    return _full(x, n, F.when(F.isnan(x), F.lit(NAN)).otherwise(below / F.lit(float(n))))


def ts_argmax(x, n: int) -> Column:
    """Place of the first greatest value, 0 for the oldest."""
    x = col(x)
    window = F.collect_list(x).over(last_rows(n))
    return _full(x, n, (F.array_position(window, F.array_max(window)) - 1).cast("double"))


def ts_argmin(x, n: int) -> Column:
    """Place of the first least value, or of the first NaN."""
    x = col(x)
    window = F.collect_list(x).over(last_rows(n))
    first_nan = F.array_position(F.transform(window, lambda e: F.isnan(e)), True)
    return _full(x, n, (F.when(first_nan > 0, first_nan).otherwise(F.array_position(window, F.array_min(window))) - 1).cast("double"))


def _counted(x: Column, n: int, hit: Column) -> Column:
    return _full(x, n, F.sum((hit & ~F.isnan(x)).cast("double")).over(last_rows(n)))


def ts_pos_count(x, n: int) -> Column:
    x = col(x)
    return _counted(x, n, x > 0)


def ts_neg_count(x, n: int) -> Column:
    x = col(x)
    return _counted(x, n, x < 0)


def ts_decay(x, n: int) -> Column:
    """Mean with weights 1 ... n, the newest heaviest; null if any value is."""
    x = col(x)
    total = n * (n + 1) / 2
    out = x * F.lit(n / total)
    for i in range(1, n):
        out = out + F.lag(x, i).over(along()) * F.lit((n - i) / total)
    return out


def ts_dstd(x, n: int) -> Column:
    """Population deviation of the positive values; 0 for one or none; needs two values of any sign."""
    x = col(x)
    pos = F.when((x > 0) & ~F.isnan(x), x)
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= 2, F.when(F.count(pos).over(w) <= 1, F.lit(0.0)).otherwise(F.stddev_pop(pos).over(w)))


def ts_zscore(x, n: int) -> Column:
    return fdiv_once(col(x) - ts_mean(x, n), ts_std(x, n))


def ts_robust_zscore(x, n: int) -> Column:
    """Distance from the rolling median in rolling median deviations; each deviation is from its own row's median."""
    off = col(x) - ts_median(x, n)
    return fdiv_once(off, F.lit(MAD_SCALE) * ts_median(F.abs(off), n))


def ts_scale(x, n: int) -> Column:
    return let(lambda v, low, high: fdiv(v - low, high - low), col(x), ts_min(x, n), ts_max(x, n))


def ts_sharpe(x, n: int) -> Column:
    return fdiv_once(ts_mean(x, n), ts_std(x, n))


def ts_av_diff(x, n: int) -> Column:
    return col(x) - ts_mean(x, n)


def ts_max_diff(x, n: int) -> Column:
    return col(x) - ts_max(x, n)


def ts_min_diff(x, n: int) -> Column:
    return col(x) - ts_min(x, n)


def _pairs(x1, x2, n: int) -> tuple[Column, Column, Column]:
    """Both columns, and whether the window is full of complete pairs: aggregates of one side then see no others."""
    x, y = col(x1), col(x2)
    return x, y, F.call_function("count", x, y).over(last_rows(n)) == n


def ts_corr(x1, x2, n: int) -> Column:
    x, y, full = _pairs(x1, x2, n)
    w = last_rows(n)
    return F.when(full, fdiv_once(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


def ts_cov(x1, x2, n: int) -> Column:
    x, y, full = _pairs(x1, x2, n)
    return F.when(full, F.covar_samp(x, y).over(last_rows(n)))


def ts_beta(x1, x2, n: int) -> Column:
    """Slope of x2 on x1."""
    return fdiv_once(ts_cov(x1, x2, n), ts_variance(x1, n))


def ts_regression(x1, x2, n: int, rettype: int = 0) -> Column:
    """Rolling regression of x2 on x1: 0 residual, 1 slope, 2 intercept, 3 fitted value, 4 squared correlation of the fitted series with x2."""
    beta = ts_beta(x1, x2, n)
    if rettype == 1:
        return beta
    if rettype == 2:
        return ts_mean(x2, n) - beta * ts_mean(x1, n)
    fitted = let(lambda b, m1, m2, x: (m2 - b * m1) + b * x, beta, ts_mean(x1, n), ts_mean(x2, n), col(x1))
    if rettype == 3:
        return fitted
    if rettype == 0:
        return col(x2) - fitted
    if rettype == 4:
        return let(lambda r: r * r, ts_corr(fitted, x2, n))
    raise ValueError(f"no such rettype: {rettype}")


def ts_ffill(x) -> Column:
    return F.last(col(x), ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))


def ts_backfill(x) -> Column:
    # from the latest row on: a frame that ends at the last row would be read again for every row
    return F.last(col(x), ignorenulls=True).over(Window.partitionBy(INSTRUMENT).orderBy(F.desc(DATE)).rowsBetween(Window.unboundedPreceding, 0))


def ts_ewma(df: DataFrame, specs: Iterable[tuple[str, str, float]], then: Iterable[tuple[str, str, str, float]] = (), spread: Column | None = None) -> DataFrame:
    """Adds exponentially weighted means (input, output, alpha); `then` adds those of differences (a, b, output, alpha) of outputs.

    The mean of a row weighs the value i rows back by (1 - alpha)**i and divides by the weights of the
    values that are there; a null gives null and keeps its place, and after NaN all is NaN. Decayed sums of blocks
    of rows compose (see barloom.operators.scans); `spread` deals the blocks of one instrument to many tasks.
    """
    out = decayed_means(df, specs, [INSTRUMENT], DATE, spread)
    then = list(then)
    if then:
        out = out.withColumns({f"_gap_{i}": F.col(a) - F.col(b) for i, (a, b, _, _) in enumerate(then)})
        out = decayed_means(out, [(f"_gap_{i}", name, alpha) for i, (_, _, name, alpha) in enumerate(then)], [INSTRUMENT], DATE, spread)
        out = out.drop(*[f"_gap_{i}" for i in range(len(then))])
    return out
