"""How often the plans compute a thing, and that the results stay what they were."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.jobs import research, tables
from barloom.operators import crosssection as cs
from barloom.operators import evaluate, metrics
from barloom.operators import timeseries as ts
from barloom.sources import panel as panels

DAY = dt.date(2020, 1, 1)


@pytest.fixture
def small(spark):
    rows = [(k, DAY + dt.timedelta(days=i), *x) for k in "ab" for i, x in enumerate([(1.0, 2.0, 3.0), (2.0, 2.0, None), (4.0, None, 1.0), (4.0, 3.0, 1.0), (4.0, 5.0, 7.0), (9.0, 5.0, 2.0), (3.0, 1.0, 2.5), (8.0, 6.0, 2.0)])]
    return spark.createDataFrame(rows, "instrument string, date date, close double, open double, volume double")


def windows(df) -> int:
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition(")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


COUNTS = {
    "regression_4": (lambda: ts.ts_regression("open", "close", 3, 4), 32), "regression_0": (lambda: ts.ts_regression("open", "close", 3, 0), 8), "regression_3": (lambda: ts.ts_regression("open", "close", 3, 3), 8),
    "corr": (lambda: ts.ts_corr("close", "volume", 3), 4), "beta": (lambda: ts.ts_beta("volume", "close", 3), 4), "kurt": (lambda: ts.ts_kurt("close", 3), 2), "skew": (lambda: ts.ts_skew("close", 3), 2),
}


@pytest.mark.parametrize("name", COUNTS)
def test_each_window_function_is_computed_once(small, name):
    expression, most = COUNTS[name]
    assert 0 < windows(tables.value(small, expression())) <= most


def test_pairs_with_nulls_and_constant_sides(small):
    got = small.select("instrument", "date", ts.ts_corr("close", "open", 2).alias("c"), ts.ts_beta("close", "open", 2).alias("b"), ts.ts_regression("open", "close", 2, 4).alias("r")).where("instrument = 'a'").orderBy("date").collect()
    assert [r.c is None for r in got] == [True, False, True, True, False, False, False, False]
    assert got[1].c != got[1].c and got[4].c != got[4].c and got[7].c == pytest.approx(1.0)
    assert got[1].b == 0.0 and got[4].b != got[4].b and got[7].b == pytest.approx(1.0)


def test_backfill_reads_each_row_once(small):
    df = small.select("instrument", "date", ts.ts_backfill("open").alias("v"))
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.v for r in df.where("instrument = 'a'").orderBy("date").collect()] == [2.0, 2.0, 3.0, 3.0, 5.0, 5.0, 1.0, 6.0]


def test_bars_and_windows_share_one_exchange(spark):
    trades = spark.createDataFrame([("a", DAY, 2.0, 1.0, 2), ("a", DAY, 3.0, 1.0, 1), ("a", DAY + dt.timedelta(days=1), 4.0, 2.0, 1)], "k string, d date, p double, q double, o int")
    df = panels.build_bars(trades, F.col("k"), F.col("d"), F.col("p"), F.col("q"), F.struct("o")).select("date", "instrument", "open", "close", ts.ts_delay("close", 1).alias("before"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r.open, r.close, r.before) for r in df.orderBy("date").collect()] == [(3.0, 2.0, None), (4.0, 4.0, 2.0)]


def test_trades_travel_once_and_prices_are_made_behind_the_exchange(spark):
    """Price and order hold the trades' own columns again; made before the exchange, they went through it beside them."""
    trades = spark.range(4).select(F.lit("a").alias("k"), F.lit(DAY).alias("d"), F.col("id").cast("double").alias("amount"), F.lit(2.0).alias("q"), F.col("id").alias("o"))
    df = panels.build_bars(trades, F.col("k"), F.col("d"), F.col("amount") / F.col("q"), F.col("q"), F.struct("o", "amount", "q"))
    below = df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "struct(" not in below and "/" not in below
    assert [tuple(r) for r in df.select("open", "high", "low", "close", "volume", "amount").collect()] == [(0.0, 1.5, 0.0, 1.5, 8.0, 6.0)]


def test_bars_of_a_column_that_has_a_name_of_the_panel(spark):
    trades = spark.createDataFrame([("a", "b", DAY, 2.0, 1.0, 1)], "instrument string, code string, date date, p double, q double, o int")
    df = panels.build_bars(trades, F.col("code"), F.col("date"), F.col("p"), F.col("q"), F.struct("o"))
    assert [(r.date, r.instrument, r.close) for r in df.collect()] == [(DAY, "b", 2.0)]


def test_approximate_bounds_are_computed_once(spark):
    """Another run may give other quantiles, so rows and counts must not each have their own."""
    df = spark.range(3000).select(F.lit(DAY).alias("date"), F.col("id").cast("string").alias("instrument"), F.lit("p").alias("portfolio_id"), F.sin("id").alias("ret"))
    for made in (cs.large_rank(df, "ret"), metrics.value_at_risk(df, large=True)):
        assert "percentile_approx" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_split_dates_reads_the_dates_once(spark):
    df = spark.range(10).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    split = evaluate.split_dates(df)
    assert split._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert tuple(split.first()) == (DAY + dt.timedelta(days=6), DAY + dt.timedelta(days=8))


def test_dates_of_the_split_need_no_factors(spark, monkeypatch):
    seen, split = [], evaluate.split_dates
    monkeypatch.setattr(evaluate, "split_dates", lambda df: seen.append(df) or split(df))
    monkeypatch.setattr(research.models, "fit_predict", lambda df, names, *rest: (df, rest[:2]))
    df, ends = research.trees(spark, "/root/testdata/sf0.001")
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert ends == tuple(map(str, split(df).first()))
