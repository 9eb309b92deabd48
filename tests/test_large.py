"""Operators for groups that no single task should hold, the wide evaluation, and the panel that is the same everywhere."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import crosssection as cs
from barloom.operators import evaluate, metrics
from barloom.operators import timeseries as ts
from barloom.sources import panel as panels

DAY = dt.date(2020, 1, 1)


def test_large_ranks_are_the_ranks(spark):
    """Ties on and between the bounds, NaN, nulls, a constant group, an empty one, and a null key."""
    rng = np.random.default_rng(8)
    rows = []
    for g, n in ((1, 3000), (2, 40), (3, 1), (None, 200)):
        for i in range(n):
            u = rng.random()
            x = None if u < 0.1 else float("nan") if u < 0.15 else float(rng.integers(0, 30)) if u < 0.6 else float(rng.normal(15, 9))
            rows.append((g, str(i), x, "x"))
    rows += [(4, str(i), 5.0, "x") for i in range(100)] + [(5, str(i), None, "x") for i in range(9)]
    df = spark.createDataFrame(rows, "g int, instrument string, v double, _range string").drop("_range")
    got = {(r.g, r.instrument): r.rank_v for r in cs.large_rank(df, "v", ["g"], ranges=7).collect()}
    want = {(r.g, r.instrument): r["rank"] for r in df.withColumn("date", F.col("g")).select("g", "instrument", cs.cs_rank("v").alias("rank")).collect()}
    assert len(got) == len(rows) and got == pytest.approx(want)


def test_a_large_date_is_ranked_in_many_tasks(spark):
    df = spark.range(60_000).select(F.lit(DAY).alias("date"), F.col("id").cast("string").alias("instrument"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = cs.large_rank(df, "v")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 60_000 and max(sizes) < 40_000
    v = np.array([r.v for r in got.select("v", "rank_v").orderBy("v").collect()])
    r = np.array([x.rank_v for x in got.select("v", "rank_v").orderBy("v").collect()])
    first, last = np.searchsorted(v, v, "left") + 1, np.searchsorted(v, v, "right")
    np.testing.assert_allclose(r, (first + last) / 2 / 60_000)


@pytest.mark.parametrize("conf", [0.95, 0.99, 0.5, 0.0])
def test_large_value_at_risk_is_the_value_at_risk(spark, conf):
    rng = np.random.default_rng(9)
    rows = [(k, DAY + dt.timedelta(days=i), None if rng.random() < 0.02 else float(round(x, 2))) for k, n in (("a", 5000), ("b", 21), ("c", 1), (None, 50)) for i, x in enumerate(rng.normal(0, 1, n))]
    rows += [("d", DAY + dt.timedelta(days=i), 0.5) for i in range(30)] + [("e", DAY, float("nan"))]
    df = spark.createDataFrame(rows, "portfolio_id string, date date, ret double")
    for f, name in ((metrics.value_at_risk, "var"), (metrics.expected_shortfall, "cvar")):
        small, large = ({r.portfolio_id: r[name] for r in f(df, conf, large=x).collect()} for x in (False, True))
        if f is metrics.expected_shortfall:
            small.pop(None, None), large.pop(None, None)
        assert large == pytest.approx(small) and len(large) >= 4


def test_wide_evaluation(spark, tmp_path):
    made = panels.synthetic_panel(spark, "2020-01-01", "2020-03-31", 9)
    panels.write_panel(made, str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).select("date", "instrument", ts.ts_returns("close", 3).alias("a"), F.when(F.col("volume") > 2e7, F.col("volume")).alias("b"), F.lit(1.0).alias("c"), evaluate.forward_return(1).alias("label"))
    names = ["a", "b", "c"]
    wide = {(r.factor, r.date): (r.ic, r.rank_ic) for r in evaluate.ic_matrix(df, names).collect()}
    long = {(r.factor, r.date): (r.ic, r.rank_ic) for r in evaluate.ic_frame(evaluate.long_form(df, names), "value", by=["factor"]).collect()}
    assert set(wide) == set(long)
    for k in wide:
        for a, b in zip(wide[k], long[k]):
            assert (a is None and b is None) or a == pytest.approx(b, nan_ok=True)
    plan = evaluate.evaluate_factors(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("FileScan parquet") == 1


def test_the_synthetic_panel_is_the_same_everywhere(spark):
    """Against numpy from the hashes, and over other numbers of partitions."""
    import hashlib

    def units(key, n):
        text = [hashlib.md5(f"{key}|{i}".encode()).hexdigest() for i in range(-(-n // 4))]
        return [(int(text[i // 4][8 * (i % 4) : 8 * (i % 4) + 8], 16) + 0.5) / 2**32 for i in range(n)]

    def normal(a, b):
        return np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)

    made = panels.synthetic_panel(spark, "2020-01-01", "2020-02-28", 5, seed=7)
    rows = {(r.instrument, r.date): r for r in made.collect()}
    for i in range(1, 6):
        code = f"{i:06d}"
        a, b, c = units(f"7|{code}", 3)
        drift, vol, total, last = normal(a, b) * 0.004, c * 0.015 + 0.015, 0.0, 100.0
        for day in sorted(d for k, d in rows if k == code):
            u = units(f"7|{code}|{day}", 8)
            total += drift / 10 + vol * normal(*u[:2])
            r = rows[code, day]
            assert r.close == pytest.approx(100 * np.exp(total)) and r.open == pytest.approx(last * (1 + normal(*u[2:4]) * 0.002))
            last = r.close
    base = {tuple(r) for r in made.collect()}
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
        try:
            assert {tuple(r) for r in panels.synthetic_panel(spark, "2020-01-01", "2020-02-28", 5, seed=7).collect()} == base
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
