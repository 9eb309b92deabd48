"""Portfolios: weights, market rules, fees, orders, net asset values, for many portfolios at once.

Everything is keyed by portfolio_id. The notional is fixed, so portfolios and instruments are
independent of each other and of what was earned before.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.numeric import col, fdiv
from barloom.operators.crosssection import mean_rank
from barloom.operators.scans import NO_HIGH, NO_LOW, clamp_scan
from barloom.operators.timeseries import DATE, INSTRUMENT, along

PORTFOLIO = "portfolio_id"


@dataclass(frozen=True)
class Costs:
    """Rates of fees, the least commission, the lot, slippage. Where a whole frame is priced, the rates may be columns of it."""

    commission: float = 0.00025
    min_commission: float = 5.0
    stamp: float = 0.001
    transfer: float = 0.00001
    lot: int = 100
    slippage: float = 0.0005


def top_k_weights(signals: DataFrame, top_k: float | Column, by: Iterable[str] = (), score: str = "predict") -> DataFrame:
    """Equal weights of the best share `top_k` of each date's scores, one name at least; ties go to the lesser code."""
    keys = [*by, DATE]
    rows = signals.where(F.col(score).isNotNull())
    w = Window.partitionBy(*keys)
    k = top_k if isinstance(top_k, Column) else F.lit(float(top_k))
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * k + F.lit(0.5)).cast("int")))
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy(F.col(score).desc(), INSTRUMENT)))
    return rows.where("_n <= _k").select(*keys, INSTRUMENT, (F.lit(1.0) / F.col("_k")).alias("weight"))


def binary_signal(score: str | Column, top_k: float) -> Column:
    """1 for the best share of a date by mean rank, nulls counted in its size; null for null."""
    score = col(score)
    rank = mean_rank(score, descending=True)
    return F.when(score.isNotNull(), (rank <= F.count(F.lit(1)).over(Window.partitionBy(DATE)) * F.lit(float(top_k))).cast("byte"))


def previous_close(price: str = "close") -> Column:
    return F.lag(price).over(along())


def price_band(code: str | Column = INSTRUMENT) -> Column:
    """The daily price limit by a code's prefix."""
    code = col(code)
    wide, widest = code.startswith("300") | code.startswith("688"), code.startswith("8") | code.startswith("4")
    return F.when(wide, F.lit(0.20)).when(widest, F.lit(0.30)).otherwise(F.lit(0.10))


def limit_flag(close: str | Column, prev: str | Column, band: Column) -> Column:
    """1 at the upper limit, -1 at the lower, else 0; 0 without a previous close."""
    close, prev = col(close), col(prev)
    usable = prev.isNotNull() & (prev > 0)
    up = usable & (close >= prev * (F.lit(1.0) + band) - F.lit(1e-6))
    down = usable & (close <= prev * (F.lit(1.0) - band) + F.lit(1e-6))
    return F.when(up, 1).when(down, -1).otherwise(0)


def commission(value: Column, costs: Costs = Costs()) -> Column:  # noqa: B008
    return F.greatest(F.lit(costs.min_commission), value * F.lit(costs.commission))


def buy_fee(value: Column, costs: Costs = Costs()) -> Column:  # noqa: B008
    return commission(value, costs) + value * F.lit(costs.transfer)


def sell_fee(value: Column, costs: Costs = Costs()) -> Column:  # noqa: B008
    return commission(value, costs) + value * F.lit(costs.transfer) + value * F.lit(costs.stamp)


def round_lot(shares: Column, lot: int = 100) -> Column:
    return (F.floor(shares / F.lit(float(lot))) * lot).cast("long")


def target_shares(weight: Column, close: Column, capital: float, lot: int = 100) -> Column:
    """Whole lots that the weight of a fixed notional buys; none without a price."""
    return F.when(close > 0, round_lot(F.try_divide(weight * F.lit(float(capital)), close), lot)).otherwise(F.lit(0).cast("long"))


def market(panel: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """date, instrument, close, last (the close of the bar before), flag and `keep` columns of every bar."""
    bars = panel.select(DATE, INSTRUMENT, "close", previous_close().alias("last"), *keep)
    return bars.withColumn("flag", limit_flag("close", "last", price_band()))


def _held(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Adds shares, and was: those before the bar. At the upper limit nothing can be bought, at the lower nothing sold.

    A bar moves the shares into an interval: down to the target at most, up to it at most, or onto it.
    """
    low = F.when(F.col("flag") > 0, F.lit(NO_LOW)).otherwise(F.col("target"))
    high = F.when(F.col("flag") < 0, F.lit(NO_HIGH)).otherwise(F.col("target"))
    return clamp_scan(rows, keys, low, high).withColumnRenamed("now", "shares")


POSITION = (PORTFOLIO, INSTRUMENT, DATE, "close", "last", "flag", "target", "was", "shares")


def positions(weights: DataFrame, panel: DataFrame, capital: float, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """portfolio_id, instrument, date, close, last, flag, target, was and shares on every bar of every name a portfolio ever wants.

    A name without a bar is carried. Where the weights come from signals of the same panel, sweep_positions does with one scan of it.
    """
    held = weights.select(PORTFOLIO, INSTRUMENT).distinct()
    rows = held.join(market(panel), INSTRUMENT).join(weights, [PORTFOLIO, DATE, INSTRUMENT], "left")
    target = target_shares(F.coalesce("weight", F.lit(0.0)), F.col("close"), capital, costs.lot)
    rows = rows.select(PORTFOLIO, INSTRUMENT, DATE, "close", "last", "flag", target.alias("target"))
    return _held(rows, [PORTFOLIO, INSTRUMENT]).select(*POSITION)


def _moves(held: DataFrame) -> DataFrame:
    """Adds `was` and `last` to positions that lack them."""
    w = Window.partitionBy(PORTFOLIO, INSTRUMENT).orderBy(DATE)
    add = {"was": F.coalesce(F.lag("shares").over(w), F.lit(0)), "last": F.lag("close").over(w)}
    return held.withColumns({k: c for k, c in add.items() if k not in held.columns})


def blotter(held: DataFrame, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """date, portfolio_id, instrument, side, shares, price and fee of every order that the positions imply.

    The fields of `costs` may be columns of `held`.
    """
    rows = _moves(held).withColumn("_diff", F.col("shares") - F.col("was")).where("_diff <> 0")
    buy = F.col("_diff") > 0
    rows = rows.withColumns({"side": F.when(buy, "buy").otherwise("sell"), "shares": F.abs("_diff"), "price": F.col("close") * F.when(buy, F.lit(1.0 + costs.slippage)).otherwise(F.lit(1.0 - costs.slippage))})
    value = F.col("shares") * F.col("price")
    fee = F.when(F.col("side") == "buy", buy_fee(value, costs)).otherwise(sell_fee(value, costs))
    return rows.select(DATE, PORTFOLIO, INSTRUMENT, "side", "shares", "price", fee.alias("fee"))


def daily_book(held: DataFrame, capital: float, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """portfolio_id, date, pnl, cost, traded, turnover and nav; nav begins at 1. The fields of `costs` may be columns of `held`."""
    pnl, value, cost = _booked(costs)
    daily = _moves(held).groupBy(PORTFOLIO, DATE).agg(F.coalesce(F.sum(pnl), F.lit(0.0)).alias("pnl"), F.sum(cost).alias("cost"), F.sum(value).alias("traded"))
    return _with_nav(daily, capital)


def _booked(costs: Costs) -> tuple[Column, Column, Column]:
    """pnl, traded value and cost of a position."""
    pnl, diff = F.col("was") * (F.col("close") - F.col("last")), F.col("shares") - F.col("was")
    value = F.abs(diff) * F.col("close")
    filled = value * F.when(diff > 0, F.lit(1.0 + costs.slippage)).otherwise(F.lit(1.0 - costs.slippage))
    fee = F.when(diff > 0, buy_fee(filled, costs)).when(diff < 0, sell_fee(filled, costs)).otherwise(F.lit(0.0))
    return pnl, value, fee + value * F.lit(costs.slippage)


def _with_nav(daily: DataFrame, capital: float) -> DataFrame:
    run = Window.partitionBy(PORTFOLIO).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("_nav", F.lit(1.0) + F.sum(F.col("pnl") - F.col("cost")).over(run) / F.lit(float(capital)))
    daily = daily.withColumn("turnover", fdiv("traded", F.lit(float(capital)) * (F.col("_nav") + F.col("cost") / F.lit(float(capital)))))
    return daily.select(PORTFOLIO, DATE, "pnl", "cost", "traded", "turnover", fdiv("_nav", F.first("_nav").over(run)).alias("nav"))


def weight_returns(weights: DataFrame, panel: DataFrame, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """portfolio_id, date, gross, buys, sells, net and nav of weights held from one close to the next.

    A name that leaves is sold on its next bar. Fees are the rates alone, without a least commission.
    """
    bars = panel.select(DATE, INSTRUMENT, next_return().alias("next"))
    held = weights.select(PORTFOLIO, INSTRUMENT).distinct()
    rows = held.join(bars, INSTRUMENT).join(weights, [PORTFOLIO, DATE, INSTRUMENT], "left")
    return _net(_weighed(rows, [PORTFOLIO], [PORTFOLIO, INSTRUMENT]), costs)


def next_return(price: str = "close") -> Column:
    return fdiv(F.lead(price).over(along()), price) - F.lit(1.0)


def _weighed(rows: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """keys, date, gross, buys and sells of rows with a weight (null: none) and the return up to the next bar."""
    w = Window.partitionBy(*series).orderBy(DATE)
    rows = rows.withColumn("_w", F.coalesce("weight", F.lit(0.0)))
    rows = rows.withColumn("_d", F.col("_w") - F.coalesce(F.lag("_w").over(w), F.lit(0.0)))
    return rows.groupBy(*keys, DATE).agg(F.sum(F.col("_w") * F.coalesce("next", F.lit(0.0))).alias("gross"), F.sum(F.greatest("_d", F.lit(0.0))).alias("buys"), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).alias("sells"))


def _net(daily: DataFrame, costs: Costs) -> DataFrame:
    rate = costs.commission + costs.transfer + costs.slippage
    net = F.col("gross") - F.col("buys") * F.lit(rate) - F.col("sells") * F.lit(rate + costs.stamp)
    daily = daily.select(PORTFOLIO, DATE, "gross", "buys", "sells", net.alias("net"))
    run = Window.partitionBy(PORTFOLIO).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("nav", F.product(F.lit(1.0) + F.col("net")).over(run))


def equal_weight_benchmark(panel: DataFrame) -> DataFrame:
    """date, benchmark: running product of the mean daily return of all names; one row a date."""
    rows = panel.select(DATE, (fdiv("close", previous_close()) - F.lit(1.0)).alias("_r"))
    daily = rows.groupBy(DATE).agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("_m"))
    return daily.select(DATE, F.product(F.lit(1.0) + F.col("_m")).over(Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)).alias("benchmark"))


def attach_benchmark(nav: DataFrame, benchmark: DataFrame, always: bool = False) -> DataFrame:
    """portfolio_id, date, nav and benchmark, each over its first value if both are above 0.

    With `always` also over others, by IEEE rules: what starts from 0 is undefined, and from a null null.
    """
    rows = nav.select(PORTFOLIO, DATE, "nav").join(benchmark, DATE, "left")
    w = Window.partitionBy(PORTFOLIO).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_n": F.first("nav").over(w), "_b": F.first("benchmark", ignorenulls=True).over(w)})
    ok = (F.col("_n") > 0) & (F.col("_b") > 0)
    scaled = lambda c, first: fdiv(c, first) if always else F.when(ok, fdiv(c, first)).otherwise(F.col(c))
    return rows.select(PORTFOLIO, DATE, scaled("nav", "_n").alias("nav"), scaled("benchmark", "_b").alias("benchmark"))


def sweep_weights(signals: DataFrame, grid: DataFrame) -> DataFrame:
    """top_k_weights of every row (portfolio_id, signal, top_k) of a grid; signals are date, instrument, signal, predict.

    Spark broadcasts the grid while its size is below spark.sql.autoBroadcastJoinThreshold, else both sides are shuffled.
    """
    rows = signals.join(grid, "signal")
    return top_k_weights(rows, F.col("top_k"), by=[PORTFOLIO])


#: A grid is broadcast up to so many rows; beyond that it is joined like any table.
GRID_ROWS = 10_000
#: What decides on shares, and what they cost; with the value of a grid that lacks the column.
PLAN = {"signal": None, "top_k": None, "lot": Costs.lot, "risk_degree": 1.0, "max_position_weight": 1.0}
COST = {"commission": Costs.commission, "min_commission": Costs.min_commission, "stamp": Costs.stamp, "transfer": Costs.transfer, "slippage": Costs.slippage}


def parameter_grid(grid: DataFrame) -> DataFrame:
    """portfolio_id with the columns of PLAN and COST, defaults filled in, and _plan: what portfolios of equal shares have in common.

    ValueError for a missing portfolio_id, signal or top_k, and for a portfolio_id that occurs twice.
    """
    if missing := [c for c in (PORTFOLIO, "signal", "top_k") if c not in grid.columns]:
        raise ValueError(f"missing columns: {missing}")
    own = grid.select(PORTFOLIO, *[F.col(c) if c in grid.columns else F.lit(v).alias(c) for c, v in {**PLAN, **COST}.items()])
    if own.groupBy(PORTFOLIO).count().where("count > 1").limit(1).count():
        raise ValueError("a portfolio_id occurs twice")
    return own.withColumn("_plan", F.concat_ws("|", *[F.col(c).cast("string") for c in PLAN]))


def _beside(rows: DataFrame, grid: DataFrame, on: list[str], distinct: bool = False, how: str = "inner") -> DataFrame:
    """rows joined with a grid, or with its distinct rows; a small one is broadcast and needs no shuffle of its own."""
    if grid.count() > GRID_ROWS:
        return rows.join(grid.distinct() if distinct else grid, on, how)
    return rows.join(F.broadcast(grid.coalesce(1).distinct() if distinct else grid), on, how)


def sweep_plans(panel: DataFrame, grid: DataFrame) -> DataFrame:
    """signal, _plan, lot, date, instrument, close, last, flag, next and weight (null: none) of all bars of names that a plan of the grid ever wants.

    The signals are columns of the panel. One scan and three exchanges serve all plans: by instrument, by signal
    and date for ranks, and by signal and instrument, behind which the rows multiply by the plans.
    """
    grid = parameter_grid(grid)
    names = sorted(r["signal"] for r in grid.select("signal").distinct().collect())
    if missing := [n for n in names if n not in panel.columns]:
        raise ValueError(f"the panel has no column for the signals {missing}")
    bars = market(panel.withColumn("next", next_return()), ["next", *names])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("predict")) for n in names]))
    long = bars.select(DATE, INSTRUMENT, "close", "last", "flag", "next", stacked.alias("s")).select("*", "s.signal", "s.predict").drop("s")
    w = Window.partitionBy("signal", DATE)
    ranked = long.withColumns({"_n": F.row_number().over(w.orderBy(F.col("predict").desc_nulls_last(), INSTRUMENT)), "_count": F.count("predict").over(w)})
    ranked = ranked.repartition("signal", INSTRUMENT)
    rows = _beside(ranked, grid.select("_plan", *PLAN), ["signal"], distinct=True)
    k = F.greatest(F.lit(1), F.floor(F.col("_count") * F.col("top_k") + F.lit(0.5)).cast("int"))
    share = F.least(F.lit(1.0) / k, F.col("max_position_weight")) * F.col("risk_degree")
    rows = rows.withColumn("weight", F.when(F.col("predict").isNotNull() & (F.col("_n") <= k), share))
    ever = Window.partitionBy("signal", INSTRUMENT, "_plan").orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_ever", F.max("weight").over(ever)).where("_ever IS NOT NULL")
    return rows.select("signal", "_plan", "lot", DATE, INSTRUMENT, "close", "last", "flag", "next", "weight")


def _plans_held(panel: DataFrame, grid: DataFrame, capital: float) -> DataFrame:
    """Positions of every plan: the fold runs once for portfolios that differ in costs alone."""
    rows = sweep_plans(panel, grid)
    lots = (F.floor(F.try_divide(F.coalesce("weight", F.lit(0.0)) * F.lit(float(capital)), F.col("close")) / F.col("lot")) * F.col("lot")).cast("long")
    rows = rows.withColumn("target", F.when(F.col("close") > 0, lots).otherwise(F.lit(0).cast("long"))).drop("weight", "next", "lot")
    return _held(rows, ["signal", INSTRUMENT, "_plan"])


def _grid_rates(grid: DataFrame) -> DataFrame:
    return parameter_grid(grid).select(PORTFOLIO, "signal", "_plan", *COST)


def _swept(panel: DataFrame, grid: DataFrame, capital: float) -> DataFrame:
    """Positions of every portfolio with its cost columns."""
    return _beside(_plans_held(panel, grid, capital), _grid_rates(grid), ["signal", "_plan"])


def _grid_costs() -> Costs:
    return Costs(**{c: F.col(c) for c in COST})


def sweep_positions(panel: DataFrame, grid: DataFrame, capital: float) -> DataFrame:
    """positions of every row of a grid over the signals of a panel."""
    return _swept(panel, grid, capital).select(*POSITION)


def sweep_blotter(panel: DataFrame, grid: DataFrame, capital: float) -> DataFrame:
    """blotter of every row of a grid, each with its own costs."""
    return blotter(_swept(panel, grid, capital), _grid_costs())


def sweep_book(panel: DataFrame, grid: DataFrame, capital: float) -> DataFrame:
    """daily_book of every row of a grid, each with its own costs, from one scan of the panel.

    A row counts once for its plan, with pnl and traded value, and only the trades once more for each set of costs;
    the sums of a plan meet its portfolios by date.
    """
    rates, on = _grid_rates(grid), ["signal", "_plan", "_trade"]
    pnl, value, cost = _booked(_grid_costs())
    trades = F.col("shares") != F.col("was")
    rows = _plans_held(panel, grid, capital).withColumn("_trade", F.explode(F.when(trades, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = _beside(rows, rates.withColumn("_trade", F.lit(True)), on, how="left")
    of_plan = lambda c: F.sum(F.when(~F.col("_trade"), c))
    sums = rows.groupBy(*on, PORTFOLIO, DATE).agg(of_plan(pnl).alias("pnl"), of_plan(value).alias("traded"), F.sum(F.when(F.col("_trade"), cost).when(~trades, value)).alias("cost"))
    sums = _beside(sums.withColumnRenamed(PORTFOLIO, "_own"), rates.select(PORTFOLIO, "signal", "_plan", F.lit(False).alias("_trade")), on, how="left")
    # dealt once for the sums by date and the run along dates
    sums = sums.withColumn(PORTFOLIO, F.coalesce("_own", PORTFOLIO)).repartition(PORTFOLIO)
    daily = sums.groupBy(PORTFOLIO, DATE).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.sum("cost").alias("cost"), F.sum("traded").alias("traded"))
    return _with_nav(daily, capital)


def sweep_returns(panel: DataFrame, grid: DataFrame) -> DataFrame:
    """weight_returns of every row of a grid; costs are proportional there and meet sums by date."""
    daily = _weighed(sweep_plans(panel, grid), ["signal", "_plan"], ["signal", INSTRUMENT, "_plan"])
    return _net(_beside(daily, parameter_grid(grid).select(PORTFOLIO, "signal", "_plan", *COST), ["signal", "_plan"]), _grid_costs())
