"""Cross-sectional operators: over all instruments of a date. Column names or Columns in, Columns out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.numeric import col, fdiv, pair
from barloom.operators.timeseries import DATE, INSTRUMENT, MAD_SCALE


def across():
    return Window.partitionBy(DATE)


def mean_rank(x: Column, descending: bool = False) -> Column:
    """Mean rank among the date's values that are not null, ties sharing; null for null. One sort."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    w = across().orderBy(order)
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / F.lit(2.0))


def cs_rank(x) -> Column:
    """Mean rank over the number of the date's rows, nulls counted there."""
    return mean_rank(col(x)) / F.count(F.lit(1)).over(across())


def cs_mean(x) -> Column:
    return F.avg(col(x)).over(across())


def cs_std(x) -> Column:
    return F.stddev_samp(col(x)).over(across())


def cs_variance(x) -> Column:
    return F.var_samp(col(x)).over(across())


def cs_median(x) -> Column:
    return F.median(col(x)).over(across())


def cs_zscore(x) -> Column:
    return fdiv(col(x) - cs_mean(x), cs_std(x))


def cs_robust_zscore(x) -> Column:
    off = col(x) - cs_median(x)
    return fdiv(off, F.lit(MAD_SCALE) * cs_median(F.abs(off)))


def cs_scale(x) -> Column:
    low = F.min(col(x)).over(across())
    return fdiv(col(x) - low, F.max(col(x)).over(across()) - low)


def cs_cov(x1, x2) -> Column:
    x, y = pair(col(x1), col(x2))
    return F.covar_samp(x, y).over(across())


def cs_corr(x1, x2) -> Column:
    x, y = pair(col(x1), col(x2))
    return fdiv(F.covar_samp(x, y).over(across()), F.stddev_samp(x).over(across()) * F.stddev_samp(y).over(across()))


def cs_beta(x1, x2) -> Column:
    """Covariance of complete pairs over the variance of all of x1."""
    return fdiv(cs_cov(x1, x2), cs_variance(x1))


def cs_alpha(x1, x2) -> Column:
    return cs_mean(x2) - cs_mean(x1) * cs_beta(x1, x2)


def cs_resid(x1, x2) -> Column:
    """What x1 does not explain of x2."""
    return col(x2) - col(x1) * cs_beta(x1, x2) - cs_alpha(x1, x2)


def cs_shrink(x, limit: float = 3.0) -> Column:
    """Clips to [-limit, limit]; NaN stays."""
    x = col(x)
    return F.when(F.isnan(x), x).when(x > limit, F.lit(limit)).when(x < -limit, F.lit(-limit)).otherwise(x)


def demean(x) -> Column:
    return col(x) - cs_mean(x)


def mad_winsor(x, n: float = 3.0) -> Column:
    """Clamps to n scaled median deviations around the date's median."""
    x = col(x)
    mid = cs_median(x)
    reach = F.lit(n * MAD_SCALE) * cs_median(F.abs(x - mid))
    return F.when(F.isnan(x), x).when(x > mid + reach, mid + reach).when(x < mid - reach, mid - reach).otherwise(x)


def market_neutralize(x, long_only: bool = False) -> Column:
    """Weights of a date that sum to 0, their sizes to 1; long_only: the positive ones, doubled."""
    off = demean(x)
    w = fdiv(off, F.sum(F.abs(off)).over(across()))
    return F.when(w < 0, F.lit(0.0)).otherwise(w * 2) if long_only else w


def neutralize(df: DataFrame, factors: Iterable[str], targets: Iterable[str]) -> DataFrame:
    """Replaces each factor by its residual on each target, one target after another."""
    factors = list(factors)
    for target in targets:
        df = df.withColumns({f: cs_resid(target, f) for f in factors})
    return df


METHODS = {"zscore": cs_zscore, "robust_zscore": cs_robust_zscore, "rank": cs_rank, "scale": cs_scale}


def standardize(df: DataFrame, columns: Iterable[str], method: str = "zscore", keep: Iterable[str] = ()) -> DataFrame:
    """date, instrument, `keep` columns and the columns by one cross-sectional method; one shuffle by date for all.

    Means and deviations are columns of their own before the division, which keeps the plan small.
    """
    columns, keep = list(columns), list(keep)
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "zscore":
        df = df.select(DATE, INSTRUMENT, *keep, *columns, *[cs_mean(c).alias(f"_m_{c}") for c in columns], *[cs_std(c).alias(f"_s_{c}") for c in columns])
        return df.select(DATE, INSTRUMENT, *keep, *[fdiv(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}").alias(c) for c in columns])
    return df.select(DATE, INSTRUMENT, *keep, *[METHODS[method](c).alias(c) for c in columns])


def fixed(df: DataFrame) -> DataFrame:
    """The rows of a small table as they come out now, for results that another run may give differently: in the checkpoint folder, or without one on the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


#: Ranges that the values of a large group are cut into.
RANGES = 64


def large_rank(df: DataFrame, column: str, by: Iterable[str] = (DATE,), ranges: int = RANGES) -> DataFrame:
    """Adds rank_<column>: what cs_rank gives, for groups too large to be sorted in one task.

    Approximate quantiles of a group cut it into ranges of values, which are tasks of their own; a rank is the number of
    values in the ranges before plus the rank within the range. Equal values share a range, so ties are
    exact, and the quantiles decide on balance alone. They depend on the order in which partial results arrive, so they are
    computed once, at the call: rows and counts are then cut alike. Groups are joined with their bounds, counts of `ranges` rows at most.
    """
    by = list(by)
    x = F.when(~F.isnan(column), F.col(column)).cast("double")
    cuts = F.percentile_approx(x, [i / ranges for i in range(1, ranges)], 20 * ranges)
    cuts = F.array_distinct(F.coalesce(cuts, F.array().cast("array<double>"))).alias("_cuts")
    groups = df.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)]).agg(F.count(F.lit(1)).alias("_size"), cuts)
    groups = fixed(groups)
    rows = df.join(groups, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)])
    # NaN is greater than any number; nulls have no rank and no range
    at = F.when(F.isnan(column), F.lit(ranges)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(column).cast("double"))))
    rows = rows.select(*df.columns, "_size", F.when(F.col(column).isNotNull(), at).otherwise(-1 - F.pmod(F.xxhash64(*df.columns), F.lit(ranges))).alias("_range"))
    counts = rows.where("_range >= 0").groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_range").alias("_of"), before.alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)] + [F.col("_range") == F.col("_of")]
    rows = rows.join(counts, on, "left")
    w = Window.partitionBy(*by, "_range").orderBy(column)
    inside = (F.rank().over(w) + F.count(column).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / F.lit(2.0)
    rank = F.when(F.col(column).isNotNull(), (F.col("_before") + inside) / F.col("_size"))
    return rows.withColumn(f"rank_{column}", rank).select(*df.columns, f"rank_{column}")
