"""Rolling and cross-sectional operators on a hand-made panel with nulls, NaNs, constants, ties and short series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import crosssection as cs
from barloom.operators import elementwise as el
from barloom.operators import evaluate, factors
from barloom.operators import timeseries as ts

NAN = float("nan")
DAY = dt.date(2020, 1, 1)
SERIES = {
    "000001": [1.0, 2.0, 3.0, 4.0, 5.0],
    "000002": [10.0, 12.0, 14.0, 16.0, 18.0],
    "000003": [100.0, 90.0, 80.0, 70.0, 60.0],
}


def frame(spark, series, **more):
    rows = [(DAY + dt.timedelta(days=i), code, v) for code, own in series.items() for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "date date, instrument string, close double")


@pytest.fixture(scope="module")
def panel(spark):
    return frame(spark, SERIES).select("*", (F.col("close") - 0.5).alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), (F.col("close") * 100).alias("volume"))


def along(df, x, code="000001"):
    return [r[0] for r in df.select("date", "instrument", x.alias("v")).where(F.col("instrument") == code).orderBy("date").select("v").collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (w is None or (math.isnan(w) and math.isnan(g)) or g == pytest.approx(w, rel=1e-9, abs=1e-12)), (got, want)


def test_hand_values(panel):
    same(along(panel, ts.ts_mean("close", 3)), [None, None, 2, 3, 4])
    same(along(panel, ts.ts_returns("close", 1)), [None, 1, 0.5, 1 / 3, 0.25])
    same(along(panel, ts.ts_product("close", 3)), [None, None, 6, 24, 60])
    same(along(panel, ts.ts_corr("close", "close", 3)), [None, None, 1, 1, 1])
    same(along(panel, ts.ts_scale("close", 3)), [None, None, 1, 1, 1])
    same(along(panel, evaluate.forward_return(1)), [1, 0.5, 1 / 3, 0.25, None])


ODD = [3.0, 3.0, None, 1.0, -2.0, -2.0, 0.0, 5.0, 5.0, 4.0, 4.0, 4.0, 4.0, 7.0]


def full(n, fn):
    out = []
    for i in range(len(ODD)):
        w = [x for x in ODD[max(0, i - n + 1) : i + 1] if x is not None]
        out.append(fn(np.array(w)) if len(w) == n else None)
    return out


@pytest.mark.parametrize(
    "op,fn",
    [
        (ts.ts_sum, np.sum), (ts.ts_max, np.max), (ts.ts_min, np.min), (ts.ts_median, np.median), (ts.ts_product, np.prod),
        (ts.ts_std, lambda w: w.std(ddof=1)), (ts.ts_variance, lambda w: w.var(ddof=1)),
        (ts.ts_skew, lambda w: ((w - w.mean()) ** 3).mean() / w.std() ** 3 if w.std() else NAN),
        (ts.ts_kurt, lambda w: ((w - w.mean()) ** 4).mean() / w.std() ** 4 - 3 if w.std() else NAN),
        (ts.ts_quantile_up, lambda w: sorted(w)[round(3 * 0.75)]), (ts.ts_quantile_down, lambda w: sorted(w)[round(3 * 0.25)]),
        (ts.ts_rank, lambda w: (w <= w[-1]).mean()), (ts.ts_argmax, np.argmax), (ts.ts_argmin, np.argmin),
        (ts.ts_pos_count, lambda w: (w > 0).sum()), (ts.ts_neg_count, lambda w: (w < 0).sum()),
        (ts.ts_decay, lambda w: (w * [1, 2, 3, 4]).sum() / 10), (ts.ts_sharpe, lambda w: w.mean() / w.std(ddof=1) if w.std() else math.inf),
        (ts.ts_zscore, lambda w: (w[-1] - w.mean()) / w.std(ddof=1) if w.std() else NAN), (ts.ts_scale, lambda w: (w[-1] - w.min()) / (w.max() - w.min()) if w.std() else NAN),
    ],
)
def test_rolling_against_numpy(spark, op, fn):
    got = along(frame(spark, {"a": ODD}), op("close", 4), "a")
    want = [None if v is None else float(v) for v in full(4, fn)]
    if op is ts.ts_rank or op in (ts.ts_zscore, ts.ts_scale):  # null at a present null
        want = [None if ODD[i] is None else w for i, w in enumerate(want)]
    same(got, want)


def test_pairs_gaps_and_fills(spark):
    df = frame(spark, {"a": ODD, "short": [1.0]}).withColumn("y", F.when(F.col("close") != 5, F.col("close") * 2))
    assert along(df, ts.ts_mean("close", 3), "short") == [None]
    got = along(df, ts.ts_cov("close", "y", 3), "a")
    for i, g in enumerate(got):
        w = [x for x in ODD[max(0, i - 2) : i + 1] if x is not None and x != 5]
        assert (g is None) == (len(w) < 3) and (g is None or g == pytest.approx(2 * np.var(w, ddof=1)))
    assert along(df, ts.ts_ffill("close"), "a")[2] == 3 and along(df, ts.ts_backfill("close"), "a")[2] == 1
    assert along(df, ts.ts_dstd("close", 3), "a")[:2] == [None, 0.0]


def test_ewma(spark):
    x = [v if v is not None else NAN for v in ODD]
    got = along(ts.ts_ewma(frame(spark, {"a": ODD}), [("close", "e", 0.3)]), F.col("e"), "a")
    want = pd.Series(x).ewm(alpha=0.3, adjust=True, ignore_na=False).mean()
    for g, w, v in zip(got, want, ODD):
        assert (g is None or math.isnan(g)) == (v is None) and (v is None or g == pytest.approx(w))


def test_cross_section(spark, panel):
    last = {r["instrument"]: r["v"] for r in panel.select("date", "instrument", cs.cs_rank("close").alias("v")).where("date = '2020-01-05'").collect()}
    assert last == {"000001": pytest.approx(1 / 3), "000002": pytest.approx(2 / 3), "000003": 1.0}
    z = panel.select("date", cs.cs_zscore("close").alias("v")).groupBy("date").avg("v").collect()
    assert all(abs(r[1]) < 1e-9 for r in z)
    ties = frame(spark, {"a": [1.0], "b": [1.0], "c": [None], "d": [2.0]})
    got = {r[0]: r[1] for r in ties.select("instrument", cs.cs_rank("close")).collect()}
    assert got == {"a": 1.5 / 4, "b": 1.5 / 4, "c": None, "d": 3 / 4}
    alone = frame(spark, {"a": [1.0]}).select(cs.cs_zscore("close"), cs.cs_scale("close"), cs.cs_rank("close")).first()
    assert alone[0] is None and math.isnan(alone[1]) and alone[2] == 1
    w = panel.select("date", cs.market_neutralize("close").alias("w")).groupBy("date").agg(F.sum("w").alias("s"), F.sum(F.abs("w")).alias("a")).collect()
    assert all(abs(r["s"]) < 1e-9 and abs(r["a"] - 1) < 1e-9 for r in w)
    res = cs.neutralize(panel, ["volume"], ["close"]).select("volume").collect()
    assert all(abs(r[0]) < 1e-6 for r in res)


def test_elementwise(spark):
    df = frame(spark, {"a": [-1.0, 0.0, 1.0, None, NAN]})
    same(along(df, el.log("close"), "a"), [NAN, -math.inf, 0.0, None, NAN])
    same(along(df, el.inf_mask(el.log("close")), "a"), [NAN, None, 0.0, None, NAN])
    same(along(df, el.pos_part("close"), "a")[:4], [0, 0, 1, 0])
    same(along(df, el.neg_part("close"), "a")[:4], [1, 0, 0, 0])
    same(along(df, el.bigger("close", F.lit(0.5)), "a")[:4], [0.5, 0.5, 1, 0.5])


def test_factors(panel):
    df = panel.withColumn("turnover_rate", F.lit(1.0))
    out = factors.compute_factors(df)
    assert out.columns == ["date", "instrument", *factors.factor_names()] and out.count() == 15
    first = out.where("instrument = '000001'").orderBy("date").first()
    assert math.isnan(first["rsi_14"]) and first["macd"] == 0 and first["momentum_20"] is None
    with pytest.raises(KeyError):
        factors.compute_factors(df, ["none such"])
    factors.register_factor("twice", lambda: F.col("close") * 2)
    assert factors.compute_factors(df, ["twice"]).where("twice <> 0").count() == 15
    factors._REGISTRY.pop("twice")


def test_evaluation(panel):
    df = panel.withColumn("label", F.col("close"))
    s = evaluate.ic_summary(evaluate.ic_frame(df.withColumn("close", F.when(F.col("date") > "2020-01-01", F.col("close"))), "close")).first()
    assert s["ic_mean"] == pytest.approx(1) and s["rank_ic_mean"] == pytest.approx(1)
    g = evaluate.group_return(df, "close")
    assert g.columns == ["date", *[f"Group{i}" for i in range(1, 11)], "long-short"]
    assert evaluate.factor_portfolio(df.withColumn("label", F.lit(0.0)), "close").where("nav <> 1").count() == 0


def test_one_shuffle_by_instrument_and_one_by_date(panel):
    df = cs.standardize(factors.compute_factors(panel, ["momentum_20", "volatility_20", "rsv_20", "cntp_20"]), ["momentum_20", "volatility_20", "rsv_20", "cntp_20"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
