"""Market rules, positions, books, performance and risk against hand values and brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, models, portfolio
from barloom.sources import panel as panels

DAY = dt.date(2020, 1, 1)


def navs(spark, values, bench=None, key="p"):
    rows = [(key, DAY + dt.timedelta(days=i), v, None if bench is None else bench[i]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "portfolio_id string, date date, nav double, benchmark double")
    return df if bench is not None else df.drop("benchmark")


def returns(spark, values):
    return spark.createDataFrame([("p", DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], "portfolio_id string, date date, ret double")


def test_fees_lots_and_limits(spark):
    row = spark.range(1).select(portfolio.buy_fee(F.lit(1000.0)), portfolio.sell_fee(F.lit(1000.0)), portfolio.round_lot(F.lit(150.0)), portfolio.target_shares(F.lit(0.5), F.lit(10.0), 1234.0)).first()
    assert row[0] == pytest.approx(5.01) and row[1] == pytest.approx(6.01) and row[2] == 100 and row[3] == 0
    codes = spark.createDataFrame([("300001",), ("688001",), ("830001",), ("430001",), ("600001",)], "instrument string")
    assert [r[0] for r in codes.select(portfolio.price_band()).collect()] == [0.2, 0.2, 0.3, 0.3, 0.1]
    flags = spark.createDataFrame([(11.0, 10.0), (9.0, 10.0), (10.0, 10.0), (11.0, None), (11.0, 0.0)], "c double, p double")
    assert [r[0] for r in flags.select(portfolio.limit_flag("c", "p", F.lit(0.1))).collect()] == [1, -1, 0, 0, 0]


def test_top_k(spark):
    df = spark.createDataFrame([(DAY, c, s) for c, s in (("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None), ("e", 0.0))], "date date, instrument string, predict double")
    got = {r.instrument: r.weight for r in portfolio.top_k_weights(df, 0.3).collect()}
    assert got == {"b": 1.0}
    assert {r.instrument for r in portfolio.top_k_weights(df, 0.5).collect()} == {"b", "c"}
    assert {r[0]: r[1] for r in df.select("instrument", portfolio.binary_signal("predict", 0.4)).collect()} == {"a": 0, "b": 1, "c": 1, "d": None, "e": 0}


def test_positions_and_book(spark):
    prices = {"600001": [10, 10.5, 11.55, 11.55, 10.0], "600002": [20, 19, 17.1, 18, 18]}
    bars = spark.createDataFrame([(DAY + dt.timedelta(days=i), c, float(p)) for c, own in prices.items() for i, p in enumerate(own)], "date date, instrument string, close double")
    plan = {("600001", 0): 0.5, ("600001", 2): 1.0, ("600002", 0): 0.5, ("600002", 1): 0.5, ("600002", 3): 0.5}
    w = spark.createDataFrame([("p", DAY + dt.timedelta(days=i), c, x) for (c, i), x in plan.items()], "portfolio_id string, date date, instrument string, weight double")
    held = portfolio.positions(w, bars, 100_000.0)
    got = {(r.instrument, (r.date - DAY).days): r.shares for r in held.collect()}
    assert got["600001", 0] == 5000 and got["600001", 1] == 0
    assert got["600001", 2] == 0  # at the upper limit: no buying
    assert got["600002", 2] == got["600002", 1] == 2600  # at the lower limit: no selling
    orders = portfolio.blotter(held)
    assert orders.groupBy("portfolio_id", "date", "instrument").count().where("count > 1").count() == 0
    assert all(r.shares % 100 == 0 for r in orders.collect())
    book = {(r.date - DAY).days: r for r in portfolio.daily_book(held, 100_000.0).collect()}
    assert book[0].nav == 1 and book[1].pnl == pytest.approx(5000 * 0.5 - 2500 * 1.0)
    fees = sum(r.fee for r in orders.collect())
    slipped = sum(r.shares * r.price / (1.0005 if r.side == "buy" else 0.9995) * 0.0005 for r in orders.collect())
    assert sum(r.cost for r in book.values()) == pytest.approx(fees + slipped)


def test_fees_at_the_fixed_rates(spark):
    row = spark.range(1).select(portfolio.commission(F.lit(100_000.0)), portfolio.buy_fee(F.lit(100_000.0)), portfolio.sell_fee(F.lit(100_000.0)), portfolio.commission(F.lit(10_000.0))).first()
    assert list(row) == pytest.approx([25.0, 26.0, 126.0, 5.0])
    bars = spark.createDataFrame([(DAY, "600001", 10.0), (DAY + dt.timedelta(days=1), "600001", 10.0)], "date date, instrument string, close double")
    w = spark.createDataFrame([("p", DAY, "600001", 1.0)], "portfolio_id string, date date, instrument string, weight double")
    got = {r.side: (r.price, r.fee) for r in portfolio.blotter(portfolio.positions(w, bars, 100_000.0)).collect()}
    assert got["buy"] == pytest.approx((10.005, 100_050 * 0.00026)) and got["sell"] == pytest.approx((9.995, 99_950 * 0.00126))


def test_positions_fold_against_a_loop(spark):
    rng = np.random.default_rng(4)
    close = 10 * np.cumprod(1 + rng.choice([0, 0.1, -0.1, 0.02, 0.1001, -0.1001], 300))
    bars = spark.createDataFrame([(DAY + dt.timedelta(days=i), "600001", float(c)) for i, c in enumerate(close)], "date date, instrument string, close double")
    w = spark.createDataFrame([("p", DAY + dt.timedelta(days=i), "600001", float(x)) for i, x in enumerate(rng.random(300)) if i % 3], "portfolio_id string, date date, instrument string, weight double")
    held = portfolio.positions(w, bars, 1e6)
    assert "Python" not in held._jdf.queryExecution().executedPlan().toString()
    have = 0
    for r in held.orderBy("date").collect():
        have = min(have, r.target) if r.flag > 0 else max(have, r.target) if r.flag < 0 else r.target
        assert r.shares == have
    assert held.where("flag <> 0").count() > 60


def test_risk_metrics_is_its_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(k, DAY + dt.timedelta(days=i), None if rng.random() < 0.05 else float(v)) for k, n in (("a", 1), ("b", 60), ("c", 200)) for i, v in enumerate(np.cumprod(1 + rng.normal(0, 0.02, n)))]
    df = spark.createDataFrame(rows, "portfolio_id string, date date, nav double")
    got = {r.portfolio_id: r for r in metrics.risk_metrics(df).collect()}
    r = metrics.daily_returns(df)
    days = {x.portfolio_id: x.max_drawdown_days for x in metrics.longest_drawdown_days(df).collect()}
    assert set(got) == set(days)
    for conf, name in ((0.95, "95"), (0.99, "99")):
        var = {x.portfolio_id: x["var"] for x in metrics.value_at_risk(r, conf).collect()}
        cvar = {x.portfolio_id: x.cvar for x in metrics.expected_shortfall(r, conf).collect()}
        for k, x in got.items():
            assert x[f"var_{name}"] == pytest.approx(var.get(k)) and x[f"cvar_{name}"] == pytest.approx(cvar.get(k)) and x.max_drawdown_days == days[k]
    plan = metrics.risk_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_performance(spark):
    def one(values, name, **k):
        return metrics.summary(navs(spark, values, **k)).first()[name]

    assert one([1.0, 2.0], "annualized_return") == pytest.approx(2.0**252 - 1)
    assert one([1.0, 2.0, 1.0, 0.5], "max_drawdown") == pytest.approx(0.75)
    nav, bench = [1.0, 1.02, 1.05, 1.03, 1.08], [1.0, 1.01, 1.02, 1.015, 1.04]
    row = metrics.summary(navs(spark, nav, bench)).first()
    assert row.total_return == pytest.approx(0.08)
    r, b = np.diff(nav) / nav[:-1], np.diff(bench) / bench[:-1]
    slope, intercept = np.polyfit(b, r, 1)
    assert row.beta == pytest.approx(slope) and row.alpha == pytest.approx((1 + intercept) ** 252 - 1)
    assert row.information_ratio == pytest.approx((r - b).mean() / (r - b).std(ddof=1) * 252**0.5)
    assert math.isnan(one([1.0, 1.1, 1.2], "sortino")) and math.isnan(one([1.0], "annualized_return"))
    sharpe = returns(spark, [0.01, 0.02, 0.03]).agg(metrics.sharpe_ratio(), metrics.sortino_ratio()).first()
    assert sharpe[0] == pytest.approx(0.02 / 0.01 * 252**0.5) and math.isnan(sharpe[1])


def test_risk(spark):
    r = returns(spark, [-0.01, -0.02, -0.03, 0.01, 0.02])
    assert metrics.value_at_risk(r, 0.95).first()["var"] == pytest.approx(0.02)
    assert metrics.value_at_risk(r, 0.99).first()["var"] == pytest.approx(0.02)
    assert metrics.expected_shortfall(r, 0.95).first()["cvar"] == pytest.approx(0.025)
    many = returns(spark, [x / 100 for x in range(-10, 11)])
    assert metrics.value_at_risk(many, 0.95).first()["var"] == pytest.approx(0.08)  # 20 * (1 - 0.95) is a little over 1
    for values, want in (([1, 1.2, 1.1, 0.9, 1, 1.3], 3), ([1, 1.1, 0.9, 1.1, 1], 1), ([1, 2, 3], 0)):
        assert metrics.longest_drawdown_days(navs(spark, [float(v) for v in values])).first()["max_drawdown_days"] == want
    rolled = metrics.rolling_value_at_risk(many, 5, 0.5).orderBy("date").collect()
    assert math.isnan(rolled[3].rolling_var) and rolled[4].rolling_var == pytest.approx(0.08)


def test_stress(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(0, 0.01, 300)
    df = navs(spark, np.cumprod(np.append(1, 1 + 2 * b)).tolist(), np.cumprod(np.append(1, 1 + b)).tolist())
    got = {r.scenario: r.loss for r in metrics.scenario_stress(df).collect()}
    assert got["single_day_10"] == pytest.approx(-0.2) and got["three_days_5"] == pytest.approx(0.9**3 - 1)
    assert metrics.scenario_stress(navs(spark, [1.0, 1.1, 1.2])).where("scenario = 'single_day_5'").first().loss == pytest.approx(-0.05)
    assert set(metrics.risk_metrics(df).columns) == {"portfolio_id", "var_95", "var_99", "cvar_95", "cvar_99", "max_drawdown_days"}
    assert metrics.return_histogram(metrics.daily_returns(df)).agg(F.sum("n")).first()[0] == 300


def test_panels(spark, tmp_path):
    made = panels.synthetic_panel(spark, "2020-01-01", "2020-03-31", 4)
    assert made.where("weekday(date) > 4 OR high < close OR low > open OR turnover_rate NOT BETWEEN 0.05 AND 15").count() == 0
    panels.write_panel(made, str(tmp_path / "p"))
    back = panels.read_panel(spark, str(tmp_path / "p"), ["close"], "2020-02-01", "2020-02-29")
    assert back.columns == ["date", "instrument", "close"] and back.count() == 4 * 20
    assert panels.universe(made, "000001, 000002").select("instrument").distinct().count() == 2
    with pytest.raises(ValueError):
        panels.validate_panel(made.unionByName(made))
    with pytest.raises(ValueError):
        panels.validate_panel(made.drop("date"))


def test_models(spark):
    made = panels.synthetic_panel(spark, "2020-01-01", "2020-04-30", 6)
    df = made.select("date", "instrument", F.col("close").alias("x"), (F.col("close") * 2 + 1).alias("label"))
    got = models.fit_predict(df, ["x"], "2020-02-29", "2020-03-31", models.linear())
    assert got.columns == ["date", "instrument", "predict"] and got.where("date <= '2020-03-31'").count() == 0
    joined = got.join(df, ["date", "instrument"]).agg(F.max(F.abs(F.col("predict") - F.col("label")))).first()[0]
    assert joined < 1e-2
    odd = df.withColumn("x", F.when(F.dayofmonth("date") == 7, F.lit(float("nan"))).otherwise(F.col("x")))
    assert models.fit_predict(odd, ["x"], "2020-02-29", "2020-03-31", models.linear()).count() == got.count()
    with pytest.raises(ValueError):
        models.fit_predict(df, ["x"], "2021-01-01", "2021-02-01", models.linear())
