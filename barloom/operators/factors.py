"""The factor library, planned in stages: leaves, rolling columns, arithmetic.

A factor is three small functions of the registry: `leaves` are columns that other columns roll over,
`rolling` the windowed columns, `value` the arithmetic on them. compute_factors gathers the stages of
all factors asked for, so that one shuffle and sort by instrument serves them all and no expression
repeats a nested one. Exponential means come first, in a scan by blocks, if any factor asks for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import fdiv, ieee_log
from barloom.operators import doubling
from barloom.operators import timeseries as ts
from barloom.operators.elementwise import neg_part, pos_part
from barloom.operators.timeseries import DATE, INSTRUMENT
from barloom.sources.panel import date_range, with_history


#: Operators that reach as many rows back as they are told; a window of n rows reaches n - 1.
_LAGS = (ts.ts_delay, ts.ts_delta, ts.ts_returns)


class Step:
    """A column of a stage: an operator, the columns that it reads, and its number of rows (0: the row itself)."""

    def __init__(self, operator: Callable[..., Column], *inputs: str, n: int = 0, back: int | None = None):
        self.operator, self.inputs, self.n = operator, inputs, n
        self.back = back if back is not None else n if operator in _LAGS else max(0, n - 1)

    def __call__(self) -> Column:
        return self.operator(*self.inputs, self.n) if self.n else self.operator(*self.inputs)


@dataclass(frozen=True)
class Factor:
    """Stages of a factor. Plain functions may stand for steps; then `lookback` has to be given where it is asked for."""

    value: Callable[[], Column]
    leaves: dict[str, Callable[[], Column]] = field(default_factory=dict)
    rolling: dict[str, Callable[[], Column]] = field(default_factory=dict)
    ewm: tuple[tuple[str, str, float], ...] = ()
    ewm_then: tuple[tuple[str, str, str, float], ...] = ()
    lookback: int | None = None

    def rows_back(self, tolerance: float) -> int:
        """How many rows before its own a value depends on: nested windows add up, and an exponential mean reaches
        as far as its older rows together weigh `tolerance` or more."""
        if self.lookback is not None:
            return self.lookback
        steps = {**self.leaves, **self.rolling}
        means = {out: ((source,), alpha) for source, out, alpha in self.ewm} | {out: ((a, b), alpha) for a, b, out, alpha in self.ewm_then}

        def reach(name: str) -> int:
            if name in means:
                inputs, alpha = means[name]
                own = math.ceil(math.log(tolerance) / math.log(1 - alpha)) if alpha < 1 else 0
            elif name in steps:
                if not isinstance(steps[name], Step):
                    raise ValueError(f"{name} is a plain function: the factor needs a lookback")
                inputs, own = steps[name].inputs, steps[name].back
            else:
                return 0
            return own + max(map(reach, inputs), default=0)

        if not steps and not means and not isinstance(self.value, Step):
            raise ValueError("the factor is one expression: it needs a lookback")
        return max([*map(reach, [*steps, *means]), self.value.back if isinstance(self.value, Step) else 0])


def _returns(n: int, sign: float = 1.0) -> Factor:
    return Factor(lambda: F.lit(sign) * fdiv(F.col("close") - F.col(f"_close_{n}"), f"_close_{n}"), rolling={f"_close_{n}": Step(ts.ts_delay, "close", n=n)})


_RET1 = Step(ts.ts_returns, "close", n=1)
_DELTA1 = Step(ts.ts_delta, "close", n=1)
_MOVED = Step(lambda x: F.abs(ts.ts_delta(x, 1)), "close", back=1)
_UP = Step(lambda x: pos_part(ts.ts_delta(x, 1)), "close", back=1)
_DOWN = Step(lambda x: neg_part(ts.ts_delta(x, 1)), "close", back=1)
_TURNED = Step(lambda x, v: F.abs(ts.ts_returns(x, 1)) * F.col(v), "close", "volume", back=1)

_REGISTRY: dict[str, Factor] = {
    "momentum_20": _returns(20),
    "momentum_60": _returns(60),
    "reversal_5": _returns(5, -1.0),
    "volatility_20": Factor(lambda: F.col("_vol"), {"_ret1": _RET1}, {"_vol": Step(ts.ts_std, "_ret1", n=20)}),
    "volume_ratio_20": Factor(lambda: fdiv("_v20", "_v60"), {}, {"_v20": Step(ts.ts_mean, "volume", n=20), "_v60": Step(ts.ts_mean, "volume", n=60)}),
    "turnover_20": Factor(lambda: F.col("_turn"), {}, {"_turn": Step(ts.ts_mean, "turnover_rate", n=20)}),
    "corr_cv_20": Factor(lambda: fdiv("_cov_cv", F.col("_std_c") * F.col("_std_v")), {"_logv": Step(ieee_log, "volume")}, {"_cov_cv": Step(ts.ts_cov, "close", "_logv", n=20), "_std_c": Step(ts.ts_std, "close", n=20), "_std_v": Step(ts.ts_std, "_logv", n=20)}),
    "beta_oc_20": Factor(lambda: fdiv("_cov_oc", "_var_o"), {}, {"_cov_oc": Step(ts.ts_cov, "open", "close", n=20), "_var_o": Step(ts.ts_variance, "open", n=20)}),
    "rsi_14": Factor(lambda: F.lit(100.0) - fdiv(F.lit(100.0), F.lit(1.0) + fdiv("_gain", "_loss")), {"_up": _UP, "_down": _DOWN}, ewm=(("_up", "_gain", 1 / 14), ("_down", "_loss", 1 / 14))),
    "macd": Factor(lambda: F.lit(2.0) * ((F.col("_fast") - F.col("_slow")) - F.col("_dea")), ewm=(("close", "_fast", 2 / 13), ("close", "_slow", 2 / 27)), ewm_then=(("_fast", "_slow", "_dea", 2 / 10),)),
    "rsv_20": Factor(lambda: fdiv(F.col("close") - F.col("_low20"), F.col("_high20") - F.col("_low20")), {}, {"_low20": Step(ts.ts_min, "low", n=20), "_high20": Step(ts.ts_max, "high", n=20)}),
    "cntp_20": Factor(lambda: F.col("_ups") / F.lit(20.0), {"_d1": _DELTA1}, {"_ups": Step(ts.ts_pos_count, "_d1", n=20)}),
    "sump_20": Factor(lambda: fdiv("_gains", "_moves"), {"_dabs": _MOVED, "_dpos": _UP}, {"_gains": Step(ts.ts_sum, "_dpos", n=20), "_moves": Step(ts.ts_sum, "_dabs", n=20)}),
    "kbar_kmid": Factor(Step(lambda a, b: fdiv(a, b) - F.lit(1.0), "close", "open")),
    "kbar_klen": Factor(Step(lambda a, b, c: fdiv(F.col(a) - F.col(b), c), "high", "low", "open")),
    "wvma_20": Factor(lambda: fdiv("_wsd", "_wmean"), {"_w": _TURNED}, {"_wsd": Step(ts.ts_std, "_w", n=20), "_wmean": Step(ts.ts_mean, "_w", n=20)}),
}


def factor_names() -> list[str]:
    return list(_REGISTRY)


def get_factor(name: str) -> Factor:
    """The registered factor; KeyError for an unknown name."""
    return _REGISTRY[name]


def register_factor(name: str, factor: Factor | Callable[[], Column], lookback: int | None = None) -> None:
    """Adds a user's factor: staged, or one expression, whose look-back in rows only its author knows."""
    _REGISTRY[name] = factor if isinstance(factor, Factor) else Factor(factor, lookback=lookback)


#: Windows of so many rows or more are put together from shorter ones; below it a sliding frame is as cheap.
LONG = 8

#: What the rows of an exponential mean before the look-back may weigh together.
TOLERANCE = 1e-12


def lookback(names: Iterable[str], tolerance: float = TOLERANCE) -> int:
    """Rows of an instrument before a date that the named factors of the date depend on; ValueError where a factor does not tell."""
    return max((get_factor(n).rows_back(tolerance) for n in names), default=0)


def compute_factors(panel: DataFrame, names: Iterable[str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """date, instrument, `keep` columns and the named factors (all by default) of every bar."""
    names = list(_REGISTRY) if names is None else list(names)
    found = [get_factor(n) for n in names]
    stage: dict[str, Callable[[], Column]] = {}
    for f in found:
        stage.update(f.leaves)
    df = panel.withColumns({n: c() for n, c in stage.items()}) if stage else panel
    ewm = dict.fromkeys(s for f in found for s in f.ewm)
    if ewm:
        df = ts.ts_ewma(df, ewm, dict.fromkeys(s for f in found for s in f.ewm_then))
    rolling: dict[str, Callable[[], Column]] = {}
    for f in found:
        rolling.update(f.rolling)
    long = {n: (c.operator, c.inputs, c.n) for n, c in rolling.items() if isinstance(c, Step) and c.n >= LONG and c.operator in doubling.OPERATORS}
    if long:
        df = doubling.rolled(df, long)
    if short := {n: c for n, c in rolling.items() if n not in long}:
        df = df.select("*", *[c().alias(n) for n, c in short.items()])
    return df.select(DATE, INSTRUMENT, *keep, *[f.value().alias(n) for n, f in zip(names, found)])


def factors_between(panel: DataFrame, start: str, end: str | None = None, names: Iterable[str] | None = None, keep: Iterable[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """compute_factors on the bars from `start` to `end`, with the values that the whole panel would give.

    Each instrument is read from as many of its rows before `start` as the factors look back, and the
    scan from the earliest of these dates; the rows before `start` are cut off again behind the factors.
    `keep` columns that are windows themselves see the same rows and no others.
    """
    names = list(_REGISTRY) if names is None else list(names)
    rows = with_history(panel, start, end, lookback(names, tolerance))
    return date_range(compute_factors(rows, names, keep), start, end)
