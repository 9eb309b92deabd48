"""Factor evaluation: labels, information coefficients, layered returns, turnover, factor portfolios."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.numeric import NAN, fdiv, safe_corr
from barloom.operators.crosssection import market_neutralize
from barloom.operators.timeseries import DATE, INSTRUMENT, along


def forward_return(horizon: int = 1, price: str = "close") -> Column:
    """Return from a row to the one `horizon` rows later; null at the end."""
    return fdiv(F.lead(F.col(price), horizon).over(along()), price) - F.lit(1.0)


def _ranked(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Adds _r_<column>: the mean rank over the number of rows of the keys."""
    out = {}
    for c in columns:
        w = Window.partitionBy(*keys).orderBy(F.col(c).asc_nulls_last())
        rank = (F.rank().over(w) + F.count(c).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / F.lit(2.0)
        out[f"_r_{c}"] = F.when(F.col(c).isNotNull(), rank / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df.withColumns(out)


def ic_series(df: DataFrame, factor: str, label: str = "label", by: Iterable[str] = ()) -> DataFrame:
    """Pearson correlation of factor and label on each date."""
    return df.groupBy(*by, DATE).agg(safe_corr(F.col(factor), F.col(label)).alias("ic"))


def rank_ic_series(df: DataFrame, factor: str, label: str = "label", by: Iterable[str] = ()) -> DataFrame:
    """Pearson correlation of both ranks; each is ranked among its own values."""
    return _ranked(df, [*by, DATE], factor, label).groupBy(*by, DATE).agg(safe_corr(F.col(f"_r_{factor}"), F.col(f"_r_{label}")).alias("rank_ic"))


def ic_frame(df: DataFrame, factor: str, label: str = "label", by: Iterable[str] = ()) -> DataFrame:
    """Both series of each date from one shuffle."""
    ranked = _ranked(df, [*by, DATE], factor, label)
    return ranked.groupBy(*by, DATE).agg(safe_corr(F.col(factor), F.col(label)).alias("ic"), safe_corr(F.col(f"_r_{factor}"), F.col(f"_r_{label}")).alias("rank_ic"))


def ic_summary(ics: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Mean, ratio to the deviation and t value of both series; undefined dates are left out."""
    aggs = []
    for c, name in (("ic", "ic"), ("rank_ic", "rank_ic")):
        x = F.when(~F.isnan(c), F.col(c))
        mean, std, n = F.avg(x), F.stddev_samp(x), F.count(x)
        ratio = F.when(std > 0, fdiv(mean, std)).otherwise(F.lit(NAN))
        short = "icir" if name == "ic" else "rank_icir"
        aggs += [F.coalesce(mean, F.lit(NAN)).alias(f"{name}_mean"), ratio.alias(short), (ratio * F.sqrt(n.cast("double"))).alias(f"{name}_t")]
    return ics.groupBy(*by).agg(*aggs)


def group_return(df: DataFrame, factor: str, label: str = "label", groups: int = 10, by: Iterable[str] = ()) -> DataFrame:
    """Mean label of each date's groups by rank, Group1 of the lowest values, and Group1 less the last group as long-short."""
    by = list(by)
    ranked = _ranked(df, [*by, DATE], factor)
    g = F.ceil(F.col(f"_r_{factor}") * F.lit(groups))
    out = ranked.groupBy(*by, DATE).agg(*[F.avg(F.when(g == i, F.col(label))).alias(f"Group{i}") for i in range(1, groups + 1)])
    return out.withColumn("long-short", F.col("Group1") - F.col(f"Group{groups}"))


def group_means(layered: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Mean over dates of each column of group_return, in long form: layer, mean_return."""
    by = list(by)
    layers = [c for c in layered.columns if c not in (*by, DATE)]
    long = layered.unpivot([*by, DATE], layers, "layer", "value")
    return long.groupBy(*by, "layer").agg(F.avg("value").alias("mean_return"))


def _weighted(df: DataFrame, factor: str, long_only: bool) -> DataFrame:
    return df.withColumn("_weight", market_neutralize(factor, long_only))


def factor_turnover(df: DataFrame, factor: str, long_only: bool = False) -> DataFrame:
    """Sum over instruments of the change of neutral weights since the instrument's last row, on each date."""
    w = _weighted(df, factor, long_only)
    w = w.withColumn("_change", F.abs(F.col("_weight") - F.lag("_weight").over(along())))
    return w.groupBy(DATE).agg(F.sum(F.coalesce("_change", F.lit(0.0))).alias("turnover"))


def factor_portfolio(df: DataFrame, factor: str, label: str = "label", long_only: bool = False) -> DataFrame:
    """Daily return of the neutral weights and its running product."""
    w = _weighted(df, factor, long_only)
    daily = w.groupBy(DATE).agg(F.coalesce(F.sum(F.col("_weight") * F.col(label)), F.lit(0.0)).alias("ret"))
    # one row a date is left here
    return daily.select(DATE, "ret", F.product(F.lit(1.0) + F.col("ret")).over(Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))


def long_form(df: DataFrame, factors: Iterable[str], label: str = "label") -> DataFrame:
    """date, instrument, label, factor, value: all factors can then be evaluated at once, by (factor, date)."""
    factors = list(factors)
    return df.select(DATE, INSTRUMENT, label, *factors).unpivot([DATE, INSTRUMENT, label], factors, "factor", "value")


def ic_matrix(df: DataFrame, factors: Iterable[str], label: str = "label") -> DataFrame:
    """factor, date, ic and rank_ic of many factors, from one shuffle of the panel by date.

    The panel stays wide up to and across the shuffle, and the label is ranked once. Behind it a row becomes one for each
    factor, which are ranked and summed up where they are: a date is whole in its task, and so is each of its factors.
    """
    factors = list(factors)
    own = _ranked(df.select(DATE, F.col(label).alias("_y"), *factors), [DATE], "_y")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors]))
    long = own.select(DATE, "_y", "_r__y", rows.alias("s")).select(DATE, "_y", "_r__y", "s.factor", F.col("s.x").alias("_x"))
    ranked = _ranked(long, [DATE, "factor"], "_x")
    return ranked.groupBy(DATE, "factor").agg(safe_corr(F.col("_x"), F.col("_y")).alias("ic"), safe_corr(F.col("_r__x"), F.col("_r__y")).alias("rank_ic"))


def evaluate_factors(df: DataFrame, factors: Iterable[str], label: str = "label") -> DataFrame:
    """ic_summary of every factor."""
    return ic_summary(ic_matrix(df, factors, label), by=["factor"])


def split_dates(df: DataFrame, train: float = 0.6, valid: float = 0.8) -> DataFrame:
    """One row train_end, valid_end: the dates at these shares of all distinct dates."""
    # one row a date is left here
    whole = Window.partitionBy()
    ranked = df.select(DATE).distinct().select(DATE, F.row_number().over(whole.orderBy(DATE)).alias("_n"), F.count(F.lit(1)).over(whole).alias("_of"))
    at = lambda q: F.max(F.when(F.col("_n") == F.floor(F.col("_of") * F.lit(q)) + 1, F.col(DATE)))
    return ranked.agg(at(train).alias("train_end"), at(valid).alias("valid_end"))


def split_column(train_end: Column, valid_end: Column, date: str = DATE) -> Column:
    """train up to train_end, valid up to valid_end, test after it."""
    return F.when(F.col(date) <= train_end, "train").when(F.col(date) <= valid_end, "valid").otherwise("test")


def fill_null(x: str, value: float = 0.0) -> Column:
    """Nulls alone are replaced; NaN stays."""
    return F.coalesce(F.col(x), F.lit(value))


