"""Windows put together from shorter ones give what sliding frames give."""

import datetime as dt
import math

import numpy as np
import pytest

from barloom.operators import doubling, factors
from barloom.operators import timeseries as ts

DAY = dt.date(2020, 1, 1)
INF, NAN = float("inf"), float("nan")


def same(a, b, level):
    # sliding frames lose digits where the level is far above the changes
    # and give NaN or an infinity where an infinity is, by its place
    return a == b or (a is not None and b is not None and (not math.isfinite(a) and not math.isfinite(b) or math.isclose(a, b, rel_tol=1e-11, abs_tol=1e-8 if level else 1e-13)))


@pytest.mark.parametrize("n", [2, 3, 8, 20, 29])
def test_every_operator_gives_its_sliding_value(spark, n):
    """Short series, nulls, NaN, infinities, constant stretches and a level far above its changes."""
    rng = np.random.default_rng(n)
    rows = []
    for k, m in (("a", 150), ("b", 7), ("c", 60), ("d", 120), ("e", 40)):
        for i in range(m):
            x, y = (float(v) for v in rng.normal(0, 3, 2))
            if k == "c":
                x, y = 0.1, 0.1 if i < 40 else y
            if k == "d":
                x, y = 1e6 + x, -1e6 + y
            if k == "a" and i in (40, 90):
                x = None if i == 40 else NAN
            if k == "e" and i in (5, 30):
                y = (INF, -INF)[i > 5]
            rows.append((k, DAY + dt.timedelta(days=i), x, y))
    df = spark.createDataFrame(rows, "instrument string, date date, x double, y double")
    wanted = {f"{o.__name__}_{'_'.join(c)}": (o, c, n) for o in doubling.OPERATORS for c in ([("x", "y"), ("y", "x")] if o is ts.ts_cov else [("x",), ("y",)])}
    got = doubling.rolled(df, wanted).select("*", *[o(*c, n).alias(f"old_{name}") for name, (o, c, n) in wanted.items()]).collect()
    assert len(got) == len(rows)
    wrong = [(r.instrument, r.date, name, r[name], r[f"old_{name}"]) for r in got for name in wanted if not same(r[name], r[f"old_{name}"], r.instrument == "d")]
    assert not wrong, wrong[:5]
    if n <= 20:
        assert all(r.ts_std_x == 0.0 and r.ts_cov_x_y == 0.0 for r in got if r.instrument == "c" and DAY + dt.timedelta(days=n) <= r.date < DAY + dt.timedelta(days=40))


def test_windows_of_two_lengths_share_their_doublings(spark):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(i)) for i in range(100)], "instrument string, date date, x double")
    got = doubling.rolled(df, {"m20": (ts.ts_mean, ("x",), 20), "m60": (ts.ts_mean, ("x",), 60)}).orderBy("date").collect()
    assert got[0].asDict().keys() == {"instrument", "date", "x", "m20", "m60"}
    assert [r.m20 for r in got] == [None] * 19 + [i - 9.5 for i in range(19, 100)] and [r.m60 for r in got] == [None] * 59 + [i - 29.5 for i in range(59, 100)]


def test_factors_read_no_long_sliding_frames(spark):
    """A sliding frame reads all its rows again for every row."""
    df = spark.createDataFrame([("a", DAY, *[1.0] * 7)], "instrument string, date date, open double, high double, low double, close double, volume double, amount double, turnover_rate double")
    plan = factors.compute_factors(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rowframe, -1, -1" in plan and "rowframe, -19," not in plan and "rowframe, -59," not in plan
