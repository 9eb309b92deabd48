"""Panels and other inputs that the registered queries derive from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import evaluate, portfolio
from barloom.operators import timeseries as ts
from barloom.sources import panel

#: The notional of the registered portfolios.
CAPITAL = 10_000_000.0
#: Moves decimal ties off the half, where engines round in different ways.
OFF_TIES = 1.0000000003


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of line items: the supplier is the instrument, the unit price the price."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, key = F.col("l_suppkey"), F.col("l_suppkey").cast("string")
    code = F.when(k % 4 == 0, F.concat(F.lit("300"), F.lpad(key, 3, "0"))).when(k % 4 == 1, F.concat(F.lit("688"), F.lpad(key, 3, "0"))).when(k % 4 == 2, F.concat(F.lit("8"), F.lpad(key, 5, "0"))).otherwise(F.concat(F.lit("600"), F.lpad(key, 3, "0")))
    price = F.try_divide(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return panel.build_bars(rows, code, F.col("l_shipdate").cast("date"), price, F.col("l_quantity"), order)


BARS_SQL = """trades AS (
  SELECT CASE l_suppkey % 4 WHEN 0 THEN '300' || lpad(l_suppkey::VARCHAR, 3, '0') WHEN 1 THEN '688' || lpad(l_suppkey::VARCHAR, 3, '0')
    WHEN 2 THEN '8' || lpad(l_suppkey::VARCHAR, 5, '0') ELSE '600' || lpad(l_suppkey::VARCHAR, 3, '0') END AS instrument,
    CAST(l_shipdate AS DATE) AS date, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS p, l_quantity::DOUBLE AS q,
    l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_extendedprice AS o4, l_quantity AS o5 FROM lineitem),
bars AS (
  SELECT date, instrument, first(p ORDER BY o1, o2, o3, o4, o5) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY o1, o2, o3, o4, o5) AS close,
    sum(q) AS volume, sum(p * q) AS amount, sum(q) / 1000.0::DOUBLE * 100.0::DOUBLE AS turnover_rate FROM trades GROUP BY date, instrument)"""


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second panel, of events: users by hour, counted into days; some values are 0."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def value(df: DataFrame, expression: Column) -> DataFrame:
    """date, instrument, value (six significant digits; null if undefined) and undefined (NaN or infinite)."""
    # a column first: digits names it several times, and Spark computes a window function at each place
    return df.select("date", "instrument", expression.alias("_value")).select("date", "instrument", *digits("value", F.col("_value")))


def digits(name: str, x: Column) -> list[Column]:
    """A number for comparison: six significant digits, 0 near 0, and a flag for NaN and infinities."""
    x = x.cast("double")
    odd = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rounded = F.when(~odd, F.when(F.abs(x) < 1e-6, F.lit(0.0)).otherwise(F.format_string("%.5e", x * F.lit(OFF_TIES)).cast("double")))
    return [rounded.alias(name), F.coalesce(odd, F.lit(False)).alias(f"{name}_undefined")]


def digits_sql(name: str, x: str) -> str:
    return (
        f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL WHEN abs({x}) < 1e-6 THEN 0.0::DOUBLE ELSE printf('%.5e', ({x})::DOUBLE * {OFF_TIES!r}::DOUBLE)::DOUBLE END AS {name}, "
        f"coalesce(isnan({x}) OR isinf({x}), false) AS {name}_undefined"
    )


def labelled(spark: SparkSession, sf_dir: str, horizon: int = 1) -> DataFrame:
    """date, instrument, close, m20 (a 20-row return), vol (5-row mean volume) and label (the next return)."""
    return bars(spark, sf_dir).select("date", "instrument", "close", ts.ts_returns("close", 20).alias("m20"), ts.ts_mean("volume", 5).alias("vol"), evaluate.forward_return(horizon).alias("label"))


LABELLED_SQL = f"""{BARS_SQL},
labelled AS (SELECT date, instrument, close, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS m20,
  CASE WHEN count(volume) OVER w5 = 5 THEN avg(volume) OVER w5 END AS vol, lead(close, 1) OVER w / close - 1 AS label
  FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date), w5 AS (PARTITION BY instrument ORDER BY date ROWS 4 PRECEDING))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, instrument, predict: the 20-row return, as a signal."""
    return labelled(spark, sf_dir).select("date", "instrument", F.col("m20").alias("predict"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two portfolios of the signal: a tenth and three tenths of the names."""
    grid = spark.createDataFrame([("p10", "m20", 0.1), ("p30", "m20", 0.3)], "portfolio_id string, signal string, top_k double")
    return portfolio.sweep_weights(signals(spark, sf_dir).withColumn("signal", F.lit("m20")), grid)


def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, instrument, close and five signals of every bar."""
    own = {"m20": ts.ts_returns("close", 20), "m60": ts.ts_returns("close", 60), "r5": -ts.ts_returns("close", 5), "vol": ts.ts_mean("volume", 5), "kmid": F.col("close") / F.col("open") - F.lit(1.0)}
    return bars(spark, sf_dir).select("date", "instrument", "close", *[c.alias(n) for n, c in own.items()])


def two_portfolios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p10", "m20", 0.1), ("p30", "m20", 0.3)], "portfolio_id string, signal string, top_k double")


SWEPT = ("m20", "m60", "r5", "vol", "kmid")
#: name, commission, least commission, stamp, transfer, slippage
COST_SETS = (("usual", 0.00025, 5.0, 0.001, 0.00001, 0.0005), ("free", 0.0, 0.0, 0.0, 0.0, 0.0), ("dear", 0.0005, 5.0, 0.001, 0.00001, 0.001), ("flat", 0.0, 20.0, 0.0, 0.0, 0.0), ("taxed", 0.00025, 1.0, 0.003, 0.00002, 0.0))
GRID = [(f"{s}-{int(k * 100)}-{c[0]}", s, k, *c[1:]) for s in SWEPT for k in (0.1, 0.3) for c in COST_SETS]


def fifty_portfolios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRID, "portfolio_id string, signal string, top_k double, commission double, min_commission double, stamp double, transfer double, slippage double")


WEIGHTS_SQL = f"""{LABELLED_SQL},
grid AS (SELECT * FROM (VALUES ('p10', 0.1::DOUBLE), ('p30', 0.3::DOUBLE)) t(portfolio_id, top_k)),
ranked AS (SELECT portfolio_id, date, instrument, greatest(1, CAST(floor(count(*) OVER (PARTITION BY portfolio_id, date) * top_k + 0.5::DOUBLE) AS INT)) AS k,
  row_number() OVER (PARTITION BY portfolio_id, date ORDER BY m20 DESC, instrument) AS n FROM labelled, grid WHERE m20 IS NOT NULL),
weights AS (SELECT portfolio_id, date, instrument, 1.0::DOUBLE / k AS weight FROM ranked WHERE n <= k)"""


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio_id, date, nav, benchmark: each bar's own price path as a portfolio, against all names; bars without a date have no place in it."""
    p = bars(spark, sf_dir).where("date IS NOT NULL")
    own = p.select(F.col("instrument").alias("portfolio_id"), "date", F.col("close").alias("nav"))
    return portfolio.attach_benchmark(own, portfolio.equal_weight_benchmark(p), always=True)


NAV_SQL = f"""{BARS_SQL},
r AS (SELECT date, close / lag(close) OVER (PARTITION BY instrument ORDER BY date) - 1 AS r FROM bars),
bench AS (SELECT date, product(1 + m) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT date, coalesce(avg(r), 0) AS m FROM r GROUP BY date)),
nav AS (SELECT instrument AS portfolio_id, bars.date, close / first_value(close) OVER w AS nav, b / first_value(b) OVER w AS benchmark
  FROM bars JOIN bench ON bars.date = bench.date WINDOW w AS (PARTITION BY instrument ORDER BY bars.date)),
rets AS (SELECT *, nav / lag(nav) OVER w - 1 AS ret, benchmark / lag(benchmark) OVER w - 1 AS bench_ret,
  (nav - max(nav) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(nav) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS drawdown
  FROM nav WINDOW w AS (PARTITION BY portfolio_id ORDER BY date))"""

#: The plans of the grid as portfolios, with their weights; the grid itself has the costs.
SWEEP_WEIGHTS_SQL = f"""{BARS_SQL},
sg0 AS (SELECT date, instrument, close, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS m20, (close - lag(close, 60) OVER w) / lag(close, 60) OVER w AS m60, -((close - lag(close, 5) OVER w) / lag(close, 5) OVER w) AS r5,
  CASE WHEN count(volume) OVER w5 = 5 THEN avg(volume) OVER w5 END AS vol, close / open - 1 AS kmid
  FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date), w5 AS (PARTITION BY instrument ORDER BY date ROWS 4 PRECEDING)),
sg AS ({" UNION ALL ".join(f"SELECT date, instrument, '{s}' AS signal, {s} AS predict FROM sg0" for s in SWEPT)}),
grid AS (SELECT *, signal || '|' || top_k AS plan FROM (VALUES {", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in g) + ")" for g in GRID)}) t(portfolio_id, signal, top_k, commission, min_commission, stamp, transfer, slippage)),
plans AS (SELECT DISTINCT plan, signal, top_k FROM grid),
ranked AS (SELECT plan AS portfolio_id, date, instrument, greatest(1, CAST(floor(n * top_k + 0.5::DOUBLE) AS INT)) AS k, r FROM
  (SELECT *, count(predict) OVER (PARTITION BY signal, date) AS n, row_number() OVER (PARTITION BY signal, date ORDER BY predict DESC NULLS LAST, instrument) AS r FROM sg) x
  JOIN plans ON plans.signal = x.signal WHERE predict IS NOT NULL),
weights AS (SELECT portfolio_id, date, instrument, 1.0::DOUBLE / k AS weight FROM ranked WHERE r <= k)"""
