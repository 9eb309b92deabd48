"""Performance and risk of net asset values, for any keys (portfolio_id by default)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.numeric import NAN, fdiv, pair
from barloom.operators.crosssection import fixed
from barloom.operators.portfolio import PORTFOLIO
from barloom.operators.timeseries import DATE

YEAR = 252
KEYS = (PORTFOLIO,)
#: Name, shock of a day, days.
SCENARIOS = (("single_day_5", -0.05, 1), ("single_day_10", -0.10, 1), ("three_days_5", -0.05, 3), ("five_days_3", -0.03, 5))


def _by(keys: Iterable[str]):
    return Window.partitionBy(*keys).orderBy(DATE)


def daily_returns(nav: DataFrame, keys: Iterable[str] = KEYS, column: str = "nav", name: str = "ret") -> DataFrame:
    """Adds the return since the last row."""
    return nav.withColumn(name, fdiv(column, F.lag(column).over(_by(keys))) - F.lit(1.0))


def _clean(r: str) -> Column:
    return F.when(~F.isnan(r), F.col(r))


def annualized_return() -> Column:
    """From nav and date: the yearly growth between the first and last value."""
    v = F.when(F.col("nav").isNotNull(), F.col("nav"))
    at = F.when(F.col("nav").isNotNull(), F.col(DATE))
    first, last, n = F.min_by(v, at), F.max_by(v, at), F.count(v)
    return F.when((n >= 2) & (first > 0), F.pow(fdiv(last, first), F.lit(float(YEAR)) / (n - 1))).otherwise(F.lit(NAN)) - F.lit(1.0)


def annualized_volatility(r: str = "ret") -> Column:
    x = _clean(r)
    return F.when(F.count(x) >= 2, F.stddev_samp(x) * F.lit(YEAR**0.5)).otherwise(F.lit(NAN))


def sharpe_ratio(r: str = "ret", rf: float = 0.0) -> Column:
    x = _clean(r) - F.lit(rf / YEAR)
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.try_divide(F.avg(x), sd) * F.lit(YEAR**0.5)).otherwise(F.lit(NAN))


def sortino_ratio(r: str = "ret", rf: float = 0.0) -> Column:
    """Mean excess over the root mean square of the negative ones; NaN without any."""
    x = _clean(r) - F.lit(rf / YEAR)
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    return F.when(down > 0, F.try_divide(F.avg(x), down) * F.lit(YEAR**0.5)).otherwise(F.lit(NAN))


def win_rate(r: str = "ret") -> Column:
    return F.coalesce(F.avg((_clean(r) > 0).cast("double")), F.lit(NAN))


def information_ratio(r: str = "ret", b: str = "bench_ret") -> Column:
    x = _clean(r) - _clean(b)
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.try_divide(F.avg(x), sd) * F.lit(YEAR**0.5)).otherwise(F.lit(NAN))


def beta(r: str = "ret", b: str = "bench_ret") -> Column:
    x, y = pair(_clean(r), _clean(b))
    return F.coalesce(F.regr_slope(x, y), F.lit(NAN))


def alpha(r: str = "ret", b: str = "bench_ret") -> Column:
    x, y = pair(_clean(r), _clean(b))
    return F.coalesce(F.pow(F.lit(1.0) + F.regr_intercept(x, y), F.lit(float(YEAR))) - F.lit(1.0), F.lit(NAN))


def drawdown_series(nav: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Adds drawdown: the distance from the running peak as a share of it."""
    peak = F.max("nav").over(_by(keys).rowsBetween(Window.unboundedPreceding, 0))
    return nav.withColumn("drawdown", fdiv(F.col("nav") - peak, peak))


def max_drawdown(column: str = "drawdown") -> Column:
    return -F.min(column)


def calmar_ratio(ann: Column, mdd: Column) -> Column:
    return F.when((mdd > 0) & ~F.isnan(mdd), F.try_divide(ann, mdd)).otherwise(F.lit(NAN))


def summary(nav: DataFrame, keys: Iterable[str] = KEYS, rf: float = 0.0) -> DataFrame:
    """One row for each key: returns, risk and, if there is a benchmark, the figures against it. One shuffle."""
    keys = list(keys)
    df = drawdown_series(daily_returns(nav, keys), keys)
    bench = "benchmark" in nav.columns
    if bench:
        df = daily_returns(df, keys, "benchmark", "bench_ret")
    total = fdiv(F.max_by("nav", DATE), F.min_by("nav", DATE)) - F.lit(1.0)
    aggs = [total.alias("total_return"), annualized_return().alias("annualized_return"), annualized_volatility().alias("annualized_volatility"), sharpe_ratio(rf=rf).alias("sharpe"), sortino_ratio(rf=rf).alias("sortino"), max_drawdown().alias("max_drawdown"), win_rate().alias("win_rate")]
    if bench:
        aggs += [information_ratio().alias("information_ratio"), beta().alias("beta"), alpha().alias("alpha")]
    return df.groupBy(*keys).agg(*aggs).withColumn("calmar", calmar_ratio(F.col("annualized_return"), F.col("max_drawdown")))


def _cut(returns: DataFrame, keys: list[str], conf: float, r: str) -> DataFrame:
    """keys and _cut: the sorted return at place ceil((n - 1) * (1 - conf)), the place computed in doubles."""
    rows = returns.where(F.col(r).isNotNull() & ~F.isnan(r))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.ceil((n - 1).cast("double") * F.lit(1.0 - conf))
    rows = rows.withColumns({"_at": F.row_number().over(Window.partitionBy(*keys).orderBy(r)) - 1, "_place": place})
    return rows.where("_at = _place").select(*keys, F.col(r).alias("_cut"))


def _large_cut(returns: DataFrame, keys: list[str], conf: float, r: str) -> DataFrame:
    """As _cut, for keys with more returns than one task can sort.

    Approximate quantiles close on either side of the wanted place cut the values of a key into three; counts tell in
    which part the place is, and the rows of that part alone are ordered. The counts are exact, so the place is.
    """
    rows = returns.where(F.col(r).isNotNull() & ~F.isnan(r)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(r).cast("double").alias("_x"))
    own = [f"_k{i}" for i in range(len(keys))]
    near = [max(0.0, 1.0 - conf - NEAR), min(1.0, 1.0 - conf + NEAR)]
    groups = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", near, int(4 / NEAR)).alias("_q"))
    groups = groups.select(*[F.col(k).alias(f"_g{k}") for k in own], F.ceil((F.col("_n") - 1).cast("double") * F.lit(1.0 - conf)).alias("_place"), F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    # bounds of another run may differ, and rows and counts have to be cut alike
    groups = fixed(groups)
    same = [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in own]
    part = F.when(F.col("_x") < F.col("_lo"), 0).when(F.col("_x") <= F.col("_hi"), 1).otherwise(2)
    parted = rows.join(groups, same).select(*own, "_x", "_place", part.alias("_part"))
    counts = parted.groupBy(*own, "_part", "_place").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    chosen = counts.withColumn("_end", upto).where((F.col("_place") < F.col("_end")) & (F.col("_place") >= F.col("_end") - F.col("_n")))
    chosen = chosen.select(*[F.col(k).alias(f"_c{k}") for k in own], F.col("_part").alias("_of"), (F.col("_place") - F.col("_end") + F.col("_n")).alias("_inside"))
    left = parted.join(chosen, [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in own] + [F.col("_part") == F.col("_of")])
    at = F.row_number().over(Window.partitionBy(*own).orderBy("_x")) - 1
    return left.withColumn("_at", at).where("_at = _inside").select(*[F.col(k).alias(n) for k, n in zip(own, keys)], F.col("_x").alias("_cut"))


#: How far, in shares of the rows, the bounds of _large_cut lie from the wanted place.
NEAR = 0.002


def value_at_risk(returns: DataFrame, conf: float = 0.95, keys: Iterable[str] = KEYS, r: str = "ret", large: bool = False) -> DataFrame:
    """The loss at the place of the sorted returns; `large` for keys that no single task should sort, with the same result."""
    keys = list(keys)
    return (_large_cut if large else _cut)(returns, keys, conf, r).select(*keys, (-F.col("_cut")).alias("var"))


def expected_shortfall(returns: DataFrame, conf: float = 0.95, keys: Iterable[str] = KEYS, r: str = "ret", large: bool = False) -> DataFrame:
    """Mean loss at or beyond the value at risk."""
    keys = list(keys)
    rows = returns.where(F.col(r).isNotNull() & ~F.isnan(r)).join((_large_cut if large else _cut)(returns, keys, conf, r), keys)
    return rows.where(F.col(r) <= F.col("_cut")).groupBy(*keys).agg((-F.avg(r)).alias("cvar"))


def longest_drawdown_days(nav: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """The longest run of rows strictly below the running peak."""
    keys = list(keys)
    rows = nav.where(F.col("nav").isNotNull())
    prev = F.max("nav").over(_by(keys).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_at_peak", F.coalesce(F.col("nav") >= prev, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_at_peak").over(_by(keys).rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_run").agg(F.sum(1 - F.col("_at_peak")).alias("_days"))
    return runs.groupBy(*keys).agg(F.max("_days").alias("max_drawdown_days"))


def rolling_value_at_risk(returns: DataFrame, window: int = 60, conf: float = 0.95, keys: Iterable[str] = KEYS, r: str = "ret") -> DataFrame:
    """Adds rolling_var over the last `window` returns that are defined; NaN before that."""
    import math

    keys = list(keys)
    rows = returns.where(F.col(r).isNotNull() & ~F.isnan(r))
    if window < 2:
        return rows.withColumn("rolling_var", F.lit(NAN))
    w = _by(keys).rowsBetween(-(window - 1), 0)
    at = math.ceil((window - 1) * (1.0 - conf))
    value = F.when(F.count(r).over(w) == window, -F.get(F.sort_array(F.collect_list(r).over(w)), at))
    return rows.withColumn("rolling_var", F.coalesce(value, F.lit(NAN)))


def risk_metrics(nav: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """var_95, var_99, cvar_95, cvar_99 and max_drawdown_days of each key: one shuffle, then windows and one aggregate."""
    keys = list(keys)
    run = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    df = daily_returns(nav, keys).withColumn("_row", F.count("nav").over(run))
    peak = F.max("nav").over(_by(keys).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_peak_row", F.when(F.col("nav").isNotNull() & F.coalesce(F.col("nav") >= peak, F.lit(True)), F.col("_row")))
    below = F.when(F.col("nav").isNotNull(), F.col("_row") - F.max("_peak_row").over(run))
    usable = F.col("ret").isNotNull() & ~F.isnan("ret")
    df = df.withColumns({"_below": below, "_r": F.when(usable, F.col("ret"))})
    whole = Window.partitionBy(*keys)
    df = df.withColumns({"_n": F.count("_r").over(whole), "_at": F.row_number().over(whole.orderBy(F.col("_r").asc_nulls_last())) - 1})
    cuts = {f"_cut_{name}": F.max(F.when(F.col("_r").isNotNull() & (F.col("_at") == F.ceil((F.col("_n") - 1).cast("double") * F.lit(1.0 - conf))), F.col("_r"))).over(whole) for conf, name in ((0.95, "95"), (0.99, "99"))}
    df = df.withColumns(cuts)
    risk = [x for name in ("95", "99") for x in ((-F.max(f"_cut_{name}")).alias(f"var_{name}"), (-F.avg(F.when(F.col("_r") <= F.col(f"_cut_{name}"), F.col("_r")))).alias(f"cvar_{name}"))]
    out = df.groupBy(*keys).agg(F.max("_below").alias("max_drawdown_days"), *risk)
    return out.where("max_drawdown_days IS NOT NULL")


def scenario_stress(nav: DataFrame, keys: Iterable[str] = KEYS, scenarios=SCENARIOS) -> DataFrame:
    """keys, scenario, loss: the benchmark's shock times beta, over its days; beta is 1 without a usable benchmark."""
    keys = list(keys)
    df = daily_returns(nav, keys)
    slope = F.lit(1.0)
    if "benchmark" in nav.columns:
        df = daily_returns(df, keys, "benchmark", "bench_ret")
        slope = F.coalesce(F.when(~F.isnan(beta()), beta()), F.lit(1.0))
    df = df.groupBy(*keys).agg(slope.alias("_beta"), F.count(_clean("ret")).alias("_n"))
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("shock"), F.lit(float(d)).alias("days")) for n, s, d in scenarios]))
    df = df.select("*", table.alias("s"))
    loss = F.when(F.col("_n") >= 2, F.pow(F.lit(1.0) + F.col("_beta") * F.col("s.shock"), F.col("s.days")) - F.lit(1.0)).otherwise(F.lit(NAN))
    return df.select(*keys, "s.scenario", loss.alias("loss"))


def return_histogram(returns: DataFrame, bins: int = 60, keys: Iterable[str] = KEYS, r: str = "ret") -> DataFrame:
    """keys, bin and n of equal bins between the least and the greatest return."""
    keys = list(keys)
    rows = returns.where(F.col(r).isNotNull() & ~F.isnan(r))
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_lo": F.min(r).over(w), "_hi": F.max(r).over(w)})
    share = F.try_divide(F.col(r) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(bins))).cast("int"))
    return rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
