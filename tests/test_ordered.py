"""Rolling order statistics against the column operators, and what a row costs."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ordered
from barloom.operators import timeseries as ts
from barloom.operators.ordered import Order

DAY = dt.date(2020, 1, 1)


@pytest.fixture
def series(spark):
    rng = np.random.default_rng(6)
    rows = []
    for code, n, odd in (("a", 400, 0.0), ("b", 90, 0.03), ("c", 3, 0.0), ("d", 120, 1.0)):
        for i in range(n):
            u = rng.random()
            x = float("nan") if u < odd / 2 and code != "d" else None if code == "b" and u < odd else float(rng.integers(0, 12)) / 4
            rows.append((code, DAY + dt.timedelta(days=i), 1.5 if code == "d" else x))
    return spark.createDataFrame(rows, "instrument string, date date, x double")


@pytest.mark.parametrize("block", [16, 8192])
def test_same_as_the_column_operators(series, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", block)
    n = 15
    specs = [Order("quantile", "x", "up", n, 0.75), Order("quantile", "x", "down", n, 0.25), Order("rank", "x", "rank", n), Order("argmax", "x", "most", n), Order("argmin", "x", "least", n)]
    got = ordered.rolling_order(series, specs).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)
    want = series.select("instrument", "date", "x", ts.ts_quantile_up("x", n).alias("up"), ts.ts_quantile_down("x", n).alias("down"), ts.ts_rank("x", n).alias("rank"), ts.ts_argmax("x", n).alias("most"), ts.ts_argmin("x", n).alias("least"))
    want = want.toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)
    assert len(got) == series.count()
    for c in ("up", "down", "rank", "most", "least"):
        np.testing.assert_allclose(got[c], want[c], err_msg=c)


def test_medians_and_robust_scores(series):
    plain = series.where("NOT isnan(x) OR x IS NULL")
    for n in (4, 7):
        got = ordered.rolling_order(plain, [Order("median", "x", "m", n)])
        both = got.join(plain.select("instrument", "date", ts.ts_median("x", n).alias("w")), ["instrument", "date"])
        assert both.where("NOT (m <=> w)").count() == 0 and both.where("m IS NOT NULL").count() > 300
    z = ordered.robust_zscore(plain, "x", "z", 9)
    assert z.columns == ["instrument", "date", "x", "z"]
    both = z.join(plain.withColumn("o", F.col("x") - ts.ts_median("x", 9)).select("instrument", "date", ts.fdiv("o", F.lit(1.4826) * ts.ts_median(F.abs("o"), 9)).alias("w")), ["instrument", "date"])
    assert both.where("NOT (z <=> w) AND abs(z - w) > 1e-12").count() == 0


def test_one_series_is_many_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 1000)
    df = spark.range(20_000).select(F.lit("a").alias("instrument"), F.timestamp_seconds("id").alias("date"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ordered.rolling_order(df, [Order("median", "x", "m", 251)])
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 15_000
    x = np.array([r.x for r in got.orderBy("date").collect()])
    last = got.orderBy(F.desc("date")).first()
    assert last.m == np.median(x[-251:])


def test_a_row_costs_the_same_in_a_long_window():
    rng = np.random.default_rng(2)
    x = rng.normal(size=30_000).tolist()

    def seconds(n):
        began = time.perf_counter()
        ordered.ranked_values(x, Order("rank", "x", "r", n))
        return time.perf_counter() - began

    seconds(10)
    assert min(seconds(2500) for _ in range(3)) < 4 * min(seconds(250) for _ in range(3))


def test_what_there_is_not():
    for bad in (("mode", "x", "m", 3), ("median", "x", "m", 0)):
        with pytest.raises(ValueError):
            Order(*bad)
