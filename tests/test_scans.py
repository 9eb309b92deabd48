"""Scans by blocks, look-back of factors, sweeps with costs: against loops, pandas and single portfolios."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import factors, portfolio, scans
from barloom.operators import timeseries as ts
from barloom.sources import panel as panels

DAY = dt.date(2020, 1, 1)
SCHEMA = "instrument string, date date, x double, y double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for code, n in (("a", 1), ("b", 127), ("c", 128), ("d", 129), ("e", 700)):
        for i in range(n):
            x = None if rng.random() < 0.2 else float(rng.normal())
            rows.append((code, DAY + dt.timedelta(days=int(i + (i > 300) * 400)), x, float(rng.integers(0, 3))))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("spread", [None, 50])
def test_decayed_means_are_those_of_pandas(series, spread):
    blocks = None if spread is None else F.floor(F.datediff("date", F.lit("1970-01-01")) / spread)
    got = ts.ts_ewma(series, [("x", "m", 0.2), ("y", "k", 1 / 14)], [("m", "k", "d", 0.5)], spread=blocks)
    assert "Python" not in plan_of(got) and got.columns == ["instrument", "date", "x", "y", "m", "k", "d"]
    back = got.toPandas().sort_values(["instrument", "date"])
    for _, own in back.groupby("instrument"):
        ewm = lambda s, alpha: s.ewm(alpha=alpha, adjust=True, ignore_na=False).mean().where(s.notna())
        np.testing.assert_allclose(own.m, ewm(own.x, 0.2), rtol=1e-12)
        np.testing.assert_allclose(own.k, ewm(own.y, 1 / 14), rtol=1e-12)
        np.testing.assert_allclose(own.d, ewm(own.m - own.k, 0.5), rtol=1e-11, atol=1e-14)


def test_nan_spoils_all_later_means(spark):
    rows = [("a", DAY + dt.timedelta(days=i), float("nan") if i == 150 else 1.0, 0.0) for i in range(400)]
    got = [r.m for r in ts.ts_ewma(spark.createDataFrame(rows, SCHEMA), [("x", "m", 0.3)]).orderBy("date").collect()]
    assert got[149] == pytest.approx(1.0) and all(np.isnan(v) for v in got[150:])


def test_one_series_over_many_tasks(spark):
    """200,000 rows of one instrument, dealt to tasks by time; no task has most of them."""
    own = spark.range(200_000).select(F.lit("a").alias("instrument"), F.timestamp_seconds(F.col("id") * 60).alias("date"), F.sin("id").alias("x"))
    got = ts.ts_ewma(own, [("x", "m", 0.01)], spread=F.floor(F.unix_timestamp("date") / 60 / 250))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) < 120_000
    x = pd.Series(np.sin(np.arange(200_000)))
    last = got.orderBy(F.desc("date")).limit(3).collect()
    np.testing.assert_allclose([r.m for r in last], x.ewm(alpha=0.01).mean().to_numpy()[:-4:-1], rtol=1e-9)


def test_hundred_thousand_bars_at_the_limits(spark):
    """One run that no bar away from the limits cuts: linear work, no Python, the result of a loop."""
    n = 100_000
    bars = spark.range(n).select(F.lit("600001").alias("instrument"), F.timestamp_seconds(F.col("id") * 60).alias("date"), F.when(F.col("id") % 2 == 0, 10.0).otherwise(12.5).alias("close"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"))
    weights = bars.select(F.lit("p").alias("portfolio_id"), "date", "instrument", (F.col("k") / 1000.0).alias("weight"))
    began = time.time()
    held = portfolio.positions(weights, bars, 1e7)
    rows = held.orderBy("date").collect()
    assert time.time() - began < 60 and "Python" not in plan_of(held)
    have = 0
    for r in rows:
        assert r.was == have
        have = min(have, r.target) if r.flag > 0 else max(have, r.target) if r.flag < 0 else r.target
        assert r.shares == have
    assert len(rows) == n and sum(r.flag == 0 for r in rows) == 1


def test_clamps_compose(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(3):
        x = 0
        for i in range(500):
            low, high = sorted(int(v) for v in rng.integers(-50, 50, 2))
            low, high = (scans.NO_LOW, high) if rng.random() < 0.3 else (low, scans.NO_HIGH) if rng.random() < 0.4 else (low, high)
            rows.append((k, i, low, high))
            before, x = x, min(max(x, low), high)
            want.append((k, i, before, x))
    df = spark.createDataFrame(rows, "k int, i int, lo long, hi long")
    for spread in (None, F.floor(F.col("i") / 33)):
        got = scans.clamp_scan(df, ["k"], F.col("lo"), F.col("hi"), order="i", spread=spread)
        assert sorted((r.k, r.i, r.was, r.now) for r in got.collect()) == want


@pytest.fixture
def written(spark, tmp_path):
    made = panels.synthetic_panel(spark, "2018-01-01", "2020-12-31", 12)
    # instruments that are listed late, stop early, or have a bar now and then
    gaps = made.where("NOT (instrument = '000003' AND date < '2020-03-01') AND NOT (instrument = '000004' AND date > '2019-06-01') AND NOT (instrument = '000005' AND dayofmonth(date) > 6)")
    panels.write_panel(gaps, str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


def test_factors_of_a_range_are_those_of_the_whole(spark, written):
    names = factors.factor_names()
    part = factors.factors_between(written, "2020-02-03", "2020-06-30", names, keep=["close"])
    whole = panels.date_range(factors.compute_factors(written, names, keep=["close"]), "2020-02-03", "2020-06-30")
    a, b = (df.toPandas().sort_values(["instrument", "date"]).reset_index(drop=True) for df in (part, whole))
    assert len(a) == len(b) > 800
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)
    quick = factors.factors_between(written, "2020-02-03", "2020-06-30", ["momentum_20"])
    plan = plan_of(quick)
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date,2020-06-30)" in plan


def test_lookback():
    assert factors.lookback(["momentum_60"]) == 60 and factors.lookback(["volatility_20"]) == 20
    assert factors.lookback(["kbar_kmid"]) == 0 and factors.lookback(["volume_ratio_20", "rsv_20"]) == 59
    assert factors.lookback(["rsi_14"], 1e-3) == 1 + 94 and factors.lookback(["macd"], 1e-3) == 90 + 31
    factors.register_factor("own", lambda: F.col("close"))
    with pytest.raises(ValueError):
        factors.lookback(["own"])
    factors.register_factor("own", lambda: ts.ts_mean("close", 7), lookback=6)
    assert factors.lookback(["own"]) == 6
    factors._REGISTRY.pop("own")
    with pytest.raises(KeyError):
        factors.lookback(["own"])


GRID = "portfolio_id string, signal string, top_k double, lot int, max_position_weight double, risk_degree double, commission double, slippage double"


def test_sweep_is_its_portfolios_one_by_one(spark, written):
    panel = written.select("date", "instrument", "close", ts.ts_returns("close", 5).alias("m5"), (-ts.ts_mean("volume", 3)).alias("thin"))
    rows = [("a", "m5", 0.3, 100, 1.0, 1.0, 0.00025, 0.0005), ("b", "m5", 0.3, 100, 1.0, 1.0, 0.01, 0.0), ("c", "thin", 0.5, 100, 1.0, 1.0, 0.0, 0.002), ("d", "m5", 0.3, 10, 0.1, 0.5, 0.0, 0.0)]
    grid = spark.createDataFrame(rows, GRID)
    book = {(r.portfolio_id, r.date): r for r in portfolio.sweep_book(panel, grid, 1e6).collect()}
    nets = {(r.portfolio_id, r.date): r for r in portfolio.sweep_returns(panel, grid).collect()}
    orders = portfolio.sweep_blotter(panel, grid, 1e6).groupBy("portfolio_id").agg(F.sum("fee").alias("fee"), F.count(F.lit(1)).alias("n")).collect()
    for key, signal, k, lot, most, degree, commission, slip in rows:
        costs = portfolio.Costs(commission=commission, slippage=slip, lot=lot)
        w = portfolio.top_k_weights(panel.select("date", "instrument", F.col(signal).alias("predict")), k).withColumn("portfolio_id", F.lit(key))
        w = w.withColumn("weight", F.least("weight", F.lit(most)) * degree)
        held = portfolio.positions(w, panel, 1e6, costs)
        own = portfolio.daily_book(held, 1e6, costs).collect()
        assert len(own) == sum(p == key for p, _ in book) > 500
        for r in own:
            b = book[key, r.date]
            assert (b.nav, b.cost, b.traded, b.pnl) == pytest.approx((r.nav, r.cost, r.traded, r.pnl))
        for r in portfolio.weight_returns(w, panel, costs).collect():
            assert nets[key, r.date].nav == pytest.approx(r.nav)
        n, fee = portfolio.blotter(held, costs).agg(F.count(F.lit(1)), F.sum("fee")).first()
        assert [(o.n, pytest.approx(o.fee)) for o in orders if o.portfolio_id == key] == [(n, fee)]
    with pytest.raises(ValueError):
        portfolio.sweep_book(panel, grid.unionByName(grid), 1e6)
    with pytest.raises(ValueError):
        portfolio.sweep_book(panel.drop("m5"), grid, 1e6)
    with pytest.raises(ValueError):
        portfolio.sweep_book(panel, grid.drop("top_k"), 1e6)


def test_sweep_needs_one_scan_and_five_exchanges(spark, written):
    panel = written.select("date", "instrument", "close", ts.ts_returns("close", 5).alias("m5"), ts.ts_mean("volume", 3).alias("thin"))
    grid = spark.createDataFrame([(f"{s}{k}{c}", s, k / 10, c / 1000) for s in ("m5", "thin") for k in range(1, 6) for c in range(5)], "portfolio_id string, signal string, top_k double, commission double")
    for df in (portfolio.sweep_book(panel, grid, 1e6), portfolio.sweep_returns(panel, grid)):
        plan = plan_of(df)
        # the plan shows each shuffle once
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 5, plan
        assert df.select("portfolio_id").distinct().count() == 50


def test_a_large_grid_is_not_broadcast_by_hand(spark, written, monkeypatch):
    monkeypatch.setattr(portfolio, "GRID_ROWS", 1)
    panel = written.select("date", "instrument", "close", ts.ts_returns("close", 5).alias("m5"))
    grid = spark.createDataFrame([("a", "m5", 0.2), ("b", "m5", 0.4)], "portfolio_id string, signal string, top_k double")
    small = {(r.portfolio_id, r.date): r.nav for r in portfolio.sweep_book(panel, grid, 1e6).collect()}
    monkeypatch.setattr(portfolio, "GRID_ROWS", 10_000)
    assert {(r.portfolio_id, r.date): r.nav for r in portfolio.sweep_book(panel, grid, 1e6).collect()} == pytest.approx(small)


def test_only_trades_multiply_by_the_costs(spark, written):
    """Positions meet the costs of their plan where they trade; also with closes that are missing or 0 on whole dates."""
    close = F.when(F.dayofmonth("date") == 7, F.lit(None)).when(F.dayofmonth("date") == 9, F.lit(0.0)).otherwise(F.col("close"))
    panel = written.select("date", "instrument", close.alias("close"), ts.ts_returns("close", 5).alias("m5"))
    grid = spark.createDataFrame([(f"{k}{c}", "m5", k / 10, c / 1000) for k in (2, 4) for c in range(3)] + [("none", "m5", 0.6, 0.0)], "portfolio_id string, signal string, top_k double, commission double")
    made = portfolio.sweep_book(panel, grid, 1e6)
    assert plan_of(made).count("_trade") > 0
    got = {(r.portfolio_id, r.date): tuple(r)[2:] for r in made.collect()}
    want = {(r.portfolio_id, r.date): tuple(r)[2:] for r in portfolio.daily_book(portfolio._swept(panel, grid, 1e6), 1e6, portfolio._grid_costs()).collect()}
    assert set(got) == set(want) and len(got) > 7 * 500
    for key, row in want.items():
        assert [x is None for x in got[key]] == [x is None for x in row]
        assert [x for x in got[key] if x is not None] == pytest.approx([x for x in row if x is not None], nan_ok=True)
