"""All registered queries of the research library, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.jobs import research
from barloom.jobs.tables import BARS_SQL, CAPITAL, LABELLED_SQL, NAV_SQL, SWEEP_WEIGHTS_SQL, WEIGHTS_SQL, bars, digits, digits_sql, labelled, nav, value, weights
from barloom.operators import crosssection as cs
from barloom.operators import elementwise as el
from barloom.operators import evaluate, factors, metrics, ordered, portfolio
from barloom.operators import timeseries as ts
from barloom.operators.ordered import Order
from barloom.sources import panel

Query = Callable[[SparkSession, str], DataFrame]

W = "OVER (PARTITION BY instrument ORDER BY date)"


def _w(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY date ROWS {n - 1} PRECEDING)"


def _agg(fn: str, x: str, n: int) -> str:
    """A rolling aggregate that is null until n values are there."""
    return f"(CASE WHEN count({x}) {_w(n)} = {n} THEN {fn.format(x)} {_w(n)} END)"


def _listed(body: str, x: str, n: int) -> list[dict[str, str]]:
    """Layers that give the window as a list l; body is over l and x."""
    return [{"l": f"list({x}) {_w(n)}", "k": f"count({x}) {_w(n)}"}, {"v": f"CASE WHEN k = {n} THEN ({body})::DOUBLE END"}]


def _sql(layers: list[dict[str, str]], final: str = "v", source: str = "bars", ctes: str = BARS_SQL) -> str:
    out, last = ctes, source
    for i, layer in enumerate(layers):
        out += f",\ns{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {last})"
        last = f"s{i}"
    return f"WITH {out}\nSELECT date, instrument, {digits_sql('value', final)} FROM {last}"


D = "close - lag(close, 1) " + W
RET = [{"r": f"({D}) / lag(close, 1) {W}"}]
#: x is the one-row return where an operator needs a signed series.
COV = "covar_samp({0}, {1})"


def _pair(fn: str, n: int) -> str:
    return f"(CASE WHEN count(close) {_w(n)} = {n} THEN {fn} {_w(n)} END)"


def _moment(n: int, power: int, shift: float) -> list[dict[str, str]]:
    return [
        {"l": f"list(close) {_w(n)}", "k": f"count(close) {_w(n)}", "m": f"avg(close) {_w(n)}"},
        {"m2": "list_avg(list_transform(l, lambda e: (e - m) * (e - m)))", "mp": f"list_avg(list_transform(l, lambda e: pow(e - m, {power})))"},
        {"v": f"CASE WHEN k = {n} THEN mp / pow(m2, {power / 2}) - {shift} END"},
    ]


def _returned(expression: Callable[[], Column]) -> Query:
    """Over bars with r, the one-row return, as a column."""
    return lambda s, d: value(bars(s, d).withColumn("r", ts.ts_returns("close", 1)), expression())


def _valued(expression: Callable[[], Column]) -> Query:
    return lambda s, d: value(bars(s, d), expression())


def _ewm_sql(x: str, alpha: float, name: str) -> list[dict[str, str]]:
    """Closed form of the exponentially weighted mean of a series without nulls."""
    g = f"(1 - {alpha!r}::DOUBLE)"
    return [{f"{name}_t": f"row_number() {W}"}, {name: f"sum(({x}) * pow({g}, -{name}_t)) {_w(10**6)} / sum(pow({g}, -{name}_t)) {_w(10**6)}"}]


REG_B = f"{_pair('covar_samp(close, open)', 5)} / {_pair('var_samp(open)', 5)}"
REG = [{"b": REG_B}, {"a": f"{_agg('avg({})', 'close', 5)} - b * {_agg('avg({})', 'open', 5)}"}, {"f": "a + b * open"}]

ROLLING: dict[str, tuple[Query, str]] = {
    "ts_delay": (_valued(lambda: ts.ts_delay("close", 3)), _sql([{"v": f"lag(close, 3) {W}"}])),
    "ts_delta": (_valued(lambda: ts.ts_delta("close", 3)), _sql([{"v": f"close - lag(close, 3) {W}"}])),
    "ts_returns": (_valued(lambda: ts.ts_returns("close", 5)), _sql([{"v": f"(close - lag(close, 5) {W}) / lag(close, 5) {W}"}])),
    **{
        f"ts_{k}": (_valued(lambda f=f: f("close", 10)), _sql([{"v": _agg(q, "close", 10)}]))
        for k, f, q in (
            ("sum", ts.ts_sum, "sum({})"), ("max", ts.ts_max, "max({})"), ("min", ts.ts_min, "min({})"), ("mean", ts.ts_mean, "avg({})"),
            ("median", ts.ts_median, "median({})"), ("std", ts.ts_std, "stddev_samp({})"), ("variance", ts.ts_variance, "var_samp({})"),
        )
    },
    "ts_product": (_valued(lambda: ts.ts_product("close", 4)), _sql([{"v": _agg("product({})", "close", 4)}])),
    "ts_skew": (_valued(lambda: ts.ts_skew("close", 10)), _sql(_moment(10, 3, 0.0))),
    "ts_kurt": (_valued(lambda: ts.ts_kurt("close", 10)), _sql(_moment(10, 4, 3.0))),
    "ts_ewma": (lambda s, d: value(ts.ts_ewma(bars(s, d), [("close", "e", 0.2)]), F.col("e")), _sql(_ewm_sql("close", 0.2, "e"), "e")),
    "ts_quantile_up": (_valued(lambda: ts.ts_quantile_up("close", 10)), _sql(_listed("list_sort(l)[8]", "close", 10))),
    "ts_quantile_down": (_valued(lambda: ts.ts_quantile_down("close", 10)), _sql(_listed("list_sort(l)[3]", "close", 10))),
    "ts_rank": (_valued(lambda: ts.ts_rank("close", 10)), _sql(_listed("len(list_filter(l, lambda e: e <= close)) / 10.0", "close", 10))),
    "ts_argmax": (_valued(lambda: ts.ts_argmax("close", 10)), _sql(_listed("list_position(l, list_max(l)) - 1", "close", 10))),
    "ts_argmin": (_valued(lambda: ts.ts_argmin("close", 10)), _sql(_listed("list_position(l, list_min(l)) - 1", "close", 10))),
    "ts_pos_count": (_returned(lambda: ts.ts_pos_count("r", 10)), _sql([*RET, {"v": f"CASE WHEN count(r) {_w(10)} = 10 THEN (count(*) FILTER (WHERE r > 0) {_w(10)})::DOUBLE END"}])),
    "ts_neg_count": (_returned(lambda: ts.ts_neg_count("r", 10)), _sql([*RET, {"v": f"CASE WHEN count(r) {_w(10)} = 10 THEN (count(*) FILTER (WHERE r < 0) {_w(10)})::DOUBLE END"}])),
    "ts_decay": (_valued(lambda: ts.ts_decay("close", 4)), _sql([{"v": f"(close * 4 + lag(close, 1) {W} * 3 + lag(close, 2) {W} * 2 + lag(close, 3) {W}) / 10.0::DOUBLE"}])),
    "ts_dstd": (_returned(lambda: ts.ts_dstd("r", 10)), _sql([*RET, {"p": "CASE WHEN r > 0 THEN r END"}, {"v": f"CASE WHEN count(r) {_w(10)} < 2 THEN NULL WHEN count(p) {_w(10)} <= 1 THEN 0 ELSE stddev_pop(p) {_w(10)} END"}])),
    "ts_zscore": (_valued(lambda: ts.ts_zscore("close", 10)), _sql([{"v": f"(close - {_agg('avg({})', 'close', 10)}) / {_agg('stddev_samp({})', 'close', 10)}"}])),
    "ts_robust_zscore": (_valued(lambda: ts.ts_robust_zscore("close", 5)), _sql([{"o": f"close - {_agg('median({})', 'close', 5)}"}, {"ao": "abs(o)"}, {"v": f"o / (1.4826::DOUBLE * {_agg('median({})', 'ao', 5)})"}])),
    "ts_scale": (_valued(lambda: ts.ts_scale("close", 10)), _sql([{"v": f"(close - {_agg('min({})', 'close', 10)}) / ({_agg('max({})', 'close', 10)} - {_agg('min({})', 'close', 10)})"}])),
    "ts_sharpe": (_valued(lambda: ts.ts_sharpe("close", 10)), _sql([{"v": f"{_agg('avg({})', 'close', 10)} / {_agg('stddev_samp({})', 'close', 10)}"}])),
    "ts_av_diff": (_valued(lambda: ts.ts_av_diff("close", 10)), _sql([{"v": f"close - {_agg('avg({})', 'close', 10)}"}])),
    "ts_max_diff": (_valued(lambda: ts.ts_max_diff("close", 10)), _sql([{"v": f"close - {_agg('max({})', 'close', 10)}"}])),
    "ts_min_diff": (_valued(lambda: ts.ts_min_diff("close", 10)), _sql([{"v": f"close - {_agg('min({})', 'close', 10)}"}])),
    "ts_corr": (_valued(lambda: ts.ts_corr("close", "volume", 10)), _sql([{"v": f"{_pair('covar_samp(close, volume)', 10)} / ({_pair('stddev_samp(close)', 10)} * {_pair('stddev_samp(volume)', 10)})"}])),
    "ts_cov": (_valued(lambda: ts.ts_cov("close", "volume", 10)), _sql([{"v": _pair("covar_samp(close, volume)", 10)}])),
    "ts_beta": (_valued(lambda: ts.ts_beta("volume", "close", 10)), _sql([{"v": f"{_pair('covar_samp(close, volume)', 10)} / {_pair('var_samp(volume)', 10)}"}])),
    **{
        f"ts_regression_{k}": (_valued(lambda k=k: ts.ts_regression("open", "close", 5, k)), _sql([*REG, {"v": q}] if k < 4 else [*REG, {"fc": "CASE WHEN f IS NOT NULL THEN close END"}, {"c": f"CASE WHEN count(f) {_w(5)} = 5 THEN covar_samp(f, fc) {_w(5)} / (stddev_samp(f) {_w(5)} * stddev_samp(fc) {_w(5)}) END"}, {"v": "c * c"}]))
        for k, q in ((0, "close - f"), (1, "b"), (2, "a"), (3, "f"), (4, ""))
    },
    "ts_ffill": (lambda s, d: value(bars(s, d).withColumn("h", F.when(F.col("volume") > 20, F.col("close"))), ts.ts_ffill("h")), _sql([{"h": "CASE WHEN volume > 20 THEN close END"}, {"v": "last_value(h IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING)"}])),
    "ts_backfill": (lambda s, d: value(bars(s, d).withColumn("h", F.when(F.col("volume") > 20, F.col("close"))), ts.ts_backfill("h")), _sql([{"h": "CASE WHEN volume > 20 THEN close END"}, {"v": "first_value(h IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}])),
}
#: A year's window: each row costs as in a short one.
LONG = 250
ORDERS = {
    "median": (Order("median", "close", "median", LONG), "median(close)"), "up": (Order("quantile", "close", "up", LONG, 0.75), f"list_sort(l)[{round((LONG - 1) * 0.75) + 1}]"),
    "down": (Order("quantile", "close", "down", LONG, 0.25), f"list_sort(l)[{round((LONG - 1) * 0.25) + 1}]"), "rank": (Order("rank", "close", "rank", LONG), f"len(list_filter(l, lambda e: e <= close)) / {LONG}.0::DOUBLE"),
    "most": (Order("argmax", "close", "most", LONG), "list_position(l, list_max(l)) - 1"), "least": (Order("argmin", "close", "least", LONG), "list_position(l, list_min(l)) - 1"),
}
_ORDER_COLUMNS = ", ".join(f"CASE WHEN k = {LONG} THEN ({'list_median(l)' if n == 'median' else q})::DOUBLE END AS {n}" for n, (_, q) in ORDERS.items())
ROLLING["rolling_order"] = (
    lambda s, d: _numbers(ordered.rolling_order(bars(s, d).select("date", "instrument", "close"), [o for o, _ in ORDERS.values()]).drop("close"), "date", "instrument"),
    f"WITH {BARS_SQL}, s0 AS (SELECT *, list(close) {_w(LONG)} AS l, count(close) {_w(LONG)} AS k FROM bars), z AS (SELECT date, instrument, {_ORDER_COLUMNS} FROM s0) SELECT date, instrument, {', '.join(digits_sql(n, n) for n in ORDERS)} FROM z",
)

WD = "OVER (PARTITION BY date)"
#: m20 has nulls in its first rows, which ranks and pairs must treat rightly.
CB = f"(covar_samp(vol, m20) {WD} / nullif(var_samp(vol) {WD}, 0))"


def _crossed(expression: Callable[[], Column]) -> Query:
    return lambda s, d: value(labelled(s, d), expression())


def _cross_sql(layers: list[dict[str, str]], final: str = "v") -> str:
    return _sql(layers, final, "labelled", LABELLED_SQL)


def _ieee(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


def _rank_sql(x: str, keys: str = "date") -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN ((rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) + count({x}) OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST RANGE UNBOUNDED PRECEDING)) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {keys}) END)"


PAIRED = {"y": "CASE WHEN vol IS NOT NULL THEN m20 END", "x": "CASE WHEN m20 IS NOT NULL THEN vol END"}
BETA = [PAIRED, {"c": f"covar_samp(x, y) {WD}", "vv": f"var_samp(vol) {WD}"}, {"b": _ieee("c", "vv")}]
CROSS: dict[str, tuple[Query, str]] = {
    "cs_rank": (_crossed(lambda: cs.cs_rank("m20")), _cross_sql([{"v": _rank_sql("m20")}])),
    "cs_zscore": (_crossed(lambda: cs.cs_zscore("m20")), _cross_sql([{"m": f"avg(m20) {WD}", "s": f"stddev_samp(m20) {WD}"}, {"v": _ieee("m20 - m", "s")}])),
    "cs_robust_zscore": (_crossed(lambda: cs.cs_robust_zscore("m20")), _cross_sql([{"o": f"m20 - median(m20) {WD}"}, {"q": f"1.4826::DOUBLE * median(abs(o)) {WD}"}, {"v": _ieee("o", "q")}])),
    "cs_scale": (_crossed(lambda: cs.cs_scale("m20")), _cross_sql([{"lo": f"min(m20) {WD}", "hi": f"max(m20) {WD}"}, {"v": _ieee("m20 - lo", "hi - lo")}])),
    "cs_mean": (_crossed(lambda: cs.cs_mean("m20")), _cross_sql([{"v": f"avg(m20) {WD}"}])),
    "cs_std": (_crossed(lambda: cs.cs_std("m20")), _cross_sql([{"v": f"stddev_samp(m20) {WD}"}])),
    "cs_variance": (_crossed(lambda: cs.cs_variance("m20")), _cross_sql([{"v": f"var_samp(m20) {WD}"}])),
    "cs_cov": (_crossed(lambda: cs.cs_cov("vol", "m20")), _cross_sql([PAIRED, {"v": f"covar_samp(x, y) {WD}"}])),
    "cs_corr": (_crossed(lambda: cs.cs_corr("vol", "m20")), _cross_sql([PAIRED, {"c": f"covar_samp(x, y) {WD}", "q": f"stddev_samp(x) {WD} * stddev_samp(y) {WD}"}, {"v": _ieee("c", "q")}])),
    "cs_beta": (_crossed(lambda: cs.cs_beta("vol", "m20")), _cross_sql(BETA, "b")),
    "cs_alpha": (_crossed(lambda: cs.cs_alpha("vol", "m20")), _cross_sql([*BETA, {"v": f"avg(m20) {WD} - avg(vol) {WD} * b"}])),
    "cs_resid": (_crossed(lambda: cs.cs_resid("vol", "m20")), _cross_sql([*BETA, {"a": f"avg(m20) {WD} - avg(vol) {WD} * b"}, {"v": "m20 - vol * b - a"}])),
    "cs_shrink": (_crossed(lambda: cs.cs_shrink("m20")), _cross_sql([{"v": "CASE WHEN m20 > 3 THEN 3 WHEN m20 < -3 THEN -3 ELSE m20 END::DOUBLE"}])),
    "demean": (_crossed(lambda: cs.demean("m20")), _cross_sql([{"v": f"m20 - avg(m20) {WD}"}])),
    "mad_winsor": (_crossed(lambda: cs.mad_winsor("m20")), _cross_sql([{"m": f"median(m20) {WD}"}, {"q": f"3 * 1.4826::DOUBLE * median(abs(m20 - m)) {WD}"}, {"v": "CASE WHEN m20 > m + q THEN m + q WHEN m20 < m - q THEN m - q ELSE m20 END"}])),
    "market_neutralize": (_crossed(lambda: cs.market_neutralize("m20")), _cross_sql([{"o": f"m20 - avg(m20) {WD}"}, {"q": f"sum(abs(o)) {WD}"}, {"v": _ieee("o", "q")}])),
    "market_neutralize_long": (_crossed(lambda: cs.market_neutralize("m20", True)), _cross_sql([{"o": f"m20 - avg(m20) {WD}"}, {"q": f"sum(abs(o)) {WD}"}, {"u": _ieee("o", "q")}, {"v": "CASE WHEN u < 0 THEN 0 ELSE u * 2 END"}])),
    "neutralize": (lambda s, d: value(cs.neutralize(labelled(s, d), ["m20"], ["vol"]), F.col("m20")), _cross_sql([*BETA, {"a": f"avg(m20) {WD} - avg(vol) {WD} * b"}, {"v": "m20 - vol * b - a"}])),
    **{f"standardize_{m}": (lambda s, d, m=m: value(cs.standardize(labelled(s, d), ["m20", "vol"], m), F.col("m20")), "") for m in cs.METHODS},
}
for _m, _k in (("zscore", "cs_zscore"), ("robust_zscore", "cs_robust_zscore"), ("rank", "cs_rank"), ("scale", "cs_scale")):
    CROSS[f"standardize_{_m}"] = (CROSS[f"standardize_{_m}"][0], CROSS[_k][1])

#: A year is one group here: a large one, whose ranks are put together from ranges of values.
CROSS["cs_rank_large"] = (lambda s, d: value(cs.large_rank(labelled(s, d).withColumn("yr", F.year("date")), "m20", ["yr"]), F.col("rank_m20")), _cross_sql([{"yr": "year(date)"}, {"v": _rank_sql("m20", "yr")}]))

ELEMENTS: dict[str, tuple[Query, str]] = {
    k: (_returned(f), _sql([*RET, {"v": q}]))
    for k, f, q in (
        ("mean", lambda: el.mean("open", "close"), "(open + close) / 2.0::DOUBLE"),
        ("sign", lambda: el.sign("r"), "sign(r)::DOUBLE"),
        ("abs", lambda: el.abs_("r"), "abs(r)"),
        ("sign_power", lambda: el.sign_power("r", 0.5), "sign(r) * pow(abs(r), 0.5::DOUBLE)"),
        ("log", lambda: el.log(F.col("r")), "CASE WHEN r > 0 THEN ln(r) WHEN r = 0 THEN '-inf'::DOUBLE WHEN r < 0 THEN 'nan'::DOUBLE END"),
        ("tanh", lambda: el.tanh("r"), "tanh(r)"),
        ("sigmoid", lambda: el.sigmoid("r"), "1.0::DOUBLE / (1.0::DOUBLE + exp(-r))"),
        ("bigger", lambda: el.bigger("r", "close"), "greatest(r, close)"),
        ("smaller", lambda: el.smaller("r", "close"), "least(r, close)"),
        ("inf_mask", lambda: el.inf_mask(el.log("r")), "CASE WHEN r > 0 THEN ln(r) WHEN r < 0 THEN 'nan'::DOUBLE END"),
        ("pos_part", lambda: el.pos_part("r"), "greatest(coalesce(r, 0), 0)"),
        ("neg_part", lambda: el.neg_part("r"), "abs(least(coalesce(r, 0), 0))"),
    )
}

FACTOR_SQL: dict[str, str] = {
    "momentum_20": _sql([{"v": f"(close - lag(close, 20) {W}) / lag(close, 20) {W}"}]),
    "momentum_60": _sql([{"v": f"(close - lag(close, 60) {W}) / lag(close, 60) {W}"}]),
    "reversal_5": _sql([{"v": f"-((close - lag(close, 5) {W}) / lag(close, 5) {W})"}]),
    "volatility_20": _sql([*RET, {"v": _agg("stddev_samp({})", "r", 20)}]),
    "volume_ratio_20": _sql([{"v": f"{_agg('avg({})', 'volume', 20)} / {_agg('avg({})', 'volume', 60)}"}]),
    "turnover_20": _sql([{"v": _agg("avg({})", "turnover_rate", 20)}]),
    "corr_cv_20": _sql([{"g": "ln(volume)"}, {"v": f"{_pair('covar_samp(close, g)', 20)} / ({_pair('stddev_samp(close)', 20)} * {_pair('stddev_samp(g)', 20)})"}]),
    "beta_oc_20": _sql([{"v": f"{_pair('covar_samp(close, open)', 20)} / {_pair('var_samp(open)', 20)}"}]),
    "rsi_14": _sql([{"d": D}, *_ewm_sql("greatest(coalesce(d, 0), 0)", 1 / 14, "u"), *_ewm_sql("abs(least(coalesce(d, 0), 0))", 1 / 14, "w"), {"v": "100.0::DOUBLE - 100.0::DOUBLE / (1 + u::DOUBLE / w::DOUBLE)"}]),
    "macd": _sql([*_ewm_sql("close", 2 / 13, "fa"), *_ewm_sql("close", 2 / 27, "sl"), *_ewm_sql("fa - sl", 2 / 10, "de"), {"v": "2 * ((fa - sl) - de)"}]),
    "rsv_20": _sql([{"v": f"(close - {_agg('min({})', 'low', 20)}) / ({_agg('max({})', 'high', 20)} - {_agg('min({})', 'low', 20)})"}]),
    "cntp_20": _sql([{"d": D}, {"v": f"CASE WHEN count(d) {_w(20)} = 20 THEN (count(*) FILTER (WHERE d > 0) {_w(20)}) / 20.0::DOUBLE END"}]),
    "sump_20": _sql([{"d": D}, {"p": "greatest(coalesce(d, 0), 0)", "ad": "abs(d)"}, {"v": f"{_agg('sum({})', 'p', 20)} / {_agg('sum({})', 'ad', 20)}"}]),
    "kbar_kmid": _sql([{"v": "close / open - 1"}]),
    "kbar_klen": _sql([{"v": "(high - low) / open"}]),
    "wvma_20": _sql([*RET, {"w": "abs(r) * volume"}, {"v": f"{_agg('stddev_samp({})', 'w', 20)} / {_agg('avg({})', 'w', 20)}"}]),
}


def _factor(name: str) -> Query:
    return lambda s, d: value(factors.compute_factors(bars(s, d), [name]), F.col(name))


FACTORS = {f"factor_{n}": (_factor(n), q) for n, q in FACTOR_SQL.items()}


def _between_sql() -> str:
    """Four factors of the whole panel, restricted to the dates afterwards."""
    start, end = RANGE
    own = {n: FACTOR_SQL[n].replace(f"WITH {BARS_SQL}", "WITH bars AS (SELECT * FROM b0)", 1) for n in BETWEEN}
    first, *rest = BETWEEN
    columns = ", ".join(f"{n}.value AS {n}, {n}.value_undefined AS {n}_undefined" for n in BETWEEN)
    joins = " ".join(f"JOIN ({own[n]}) {n} ON {n}.date = {first}.date AND {n}.instrument = {first}.instrument" for n in rest)
    return f"WITH {BARS_SQL}, b0 AS MATERIALIZED (SELECT * FROM bars) SELECT {first}.date, {first}.instrument, {columns} FROM ({own[first]}) {first} {joins} WHERE {first}.date BETWEEN DATE '{start}' AND DATE '{end}'"


#: A simple lag, a window over a lag, and both kinds of exponential means.
BETWEEN, RANGE = ("momentum_60", "volatility_20", "rsi_14", "macd"), ("1995-03-01", "1995-12-31")
FACTORS["factors_between"] = (lambda s, d: _numbers(factors.factors_between(bars(s, d), *RANGE, BETWEEN), "date", "instrument"), _between_sql())


def _numbers(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, and all other columns as digits."""
    return df.select(*keys, *[c for n in df.columns if n not in keys for c in digits(n.replace("-", "_").lower(), F.col(f"`{n}`"))])


def _numbers_sql(ctes: str, select: dict[str, str], source: str, keys: str, tail: str = "") -> str:
    inner = ", ".join([*([keys] if keys else []), *[f"{e} AS {n}" for n, e in select.items()]])
    return f"WITH {ctes}, z AS (SELECT {inner} FROM {source} {tail})\nSELECT {keys + ', ' if keys else ''}{', '.join(digits_sql(n, n) for n in select)} FROM z"


def _corr_sql(x: str, y: str) -> str:
    """Complete pairs; NaN for a constant side, null below two pairs."""
    px, py = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_samp({px}, {py})::DOUBLE / (stddev_samp({px}) * stddev_samp({py}))"


RANKED_SQL = f"{LABELLED_SQL}, rk AS (SELECT *, {_rank_sql('m20')} AS rf, {_rank_sql('label')} AS rl FROM labelled)"
IC_SQL = f"{RANKED_SQL}, ics AS (SELECT date, {_corr_sql('m20', 'label')} AS ic, {_corr_sql('rf', 'rl')} AS rank_ic FROM rk GROUP BY date)"


def _summary_sql(source: str, ctes: str, by: str = "") -> str:
    out = {}
    for c, short in (("ic", "icir"), ("rank_ic", "rank_icir")):
        x = f"CASE WHEN NOT isnan({c}) THEN {c} END"
        out[f"{c}_mean"] = f"coalesce(avg({x}), 'nan'::DOUBLE)"
        ratio = f"(CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) ELSE 'nan'::DOUBLE END)"
        out[short] = ratio
        out[f"{c}_t"] = f"{ratio} * sqrt(count({x})::DOUBLE)"
    return _numbers_sql(ctes, out, source, by, f"GROUP BY {by}" if by else "")


LAYERS = {f"group{i}": f"avg(CASE WHEN ceil(rf * 5) = {i} THEN label END)" for i in range(1, 6)}
LAYER_SQL = f"{RANKED_SQL}, lay AS (SELECT date, {', '.join(f'{e} AS {n}' for n, e in LAYERS.items())} FROM rk GROUP BY date), lays AS (SELECT *, group1 - group5 AS long_short FROM lay)"
NEUTRAL_SQL = f"{LABELLED_SQL}, o AS (SELECT *, m20 - avg(m20) {WD} AS o FROM labelled), nw AS (SELECT *, {_ieee('o', f'sum(abs(o)) {WD}')} AS w FROM o)"
MULTI_SQL = f"{LABELLED_SQL}, lf AS (SELECT date, instrument, label, 'm20' AS factor, m20 AS v FROM labelled UNION ALL SELECT date, instrument, label, 'vol', vol FROM labelled), rk2 AS (SELECT *, {_rank_sql('v', 'factor, date')} AS rf, {_rank_sql('label', 'factor, date')} AS rl FROM lf), ics AS (SELECT factor, date, {_corr_sql('v', 'label')} AS ic, {_corr_sql('rf', 'rl')} AS rank_ic FROM rk2 GROUP BY factor, date)"


def _bench_keyed(f: Callable[[DataFrame], DataFrame], *keys: str) -> Query:
    return lambda s, d: _numbers(f(nav(s, d)), *keys)


EVALUATION: dict[str, tuple[Query, str]] = {
    "forward_return": (_valued(lambda: evaluate.forward_return(5)), _sql([{"v": f"lead(close, 5) {W} / close - 1"}])),
    "ic_series": (lambda s, d: _numbers(evaluate.ic_series(labelled(s, d), "m20"), "date"), _numbers_sql(IC_SQL, {"ic": "ic"}, "ics", "date")),
    "rank_ic_series": (lambda s, d: _numbers(evaluate.rank_ic_series(labelled(s, d), "m20"), "date"), _numbers_sql(IC_SQL, {"rank_ic": "rank_ic"}, "ics", "date")),
    "ic_summary": (lambda s, d: _numbers(evaluate.ic_summary(evaluate.ic_frame(labelled(s, d), "m20"))), _summary_sql("ics", IC_SQL)),
    "evaluate_factors": (lambda s, d: _numbers(evaluate.evaluate_factors(labelled(s, d), ["m20", "vol"]), "factor"), _summary_sql("ics", MULTI_SQL, "factor")),
    "group_return": (lambda s, d: _numbers(evaluate.group_return(labelled(s, d), "m20", groups=5), "date"), _numbers_sql(LAYER_SQL, {k: k for k in [*LAYERS, "long_short"]}, "lays", "date")),
    "group_means": (lambda s, d: _numbers(evaluate.group_means(evaluate.group_return(labelled(s, d), "m20", groups=5)), "layer"), f"WITH {LAYER_SQL}, u AS ({' UNION ALL '.join(f'SELECT {chr(39)}{name}{chr(39)} AS layer, avg({c}) AS m FROM lays' for name, c in [*[(f'Group{i}', f'group{i}') for i in range(1, 6)], ('long-short', 'long_short')])}) SELECT layer, {digits_sql('mean_return', 'm')} FROM u"),
    "factor_turnover": (lambda s, d: _numbers(evaluate.factor_turnover(labelled(s, d), "m20"), "date"), _numbers_sql(f"{NEUTRAL_SQL}, ch AS (SELECT date, abs(w - lag(w) {W}) AS c FROM nw)", {"turnover": "sum(coalesce(c, 0))"}, "ch", "date", "GROUP BY date")),
    "factor_portfolio": (lambda s, d: _numbers(evaluate.factor_portfolio(labelled(s, d), "vol"), "date"), _numbers_sql(f"{NEUTRAL_SQL.replace('m20 - avg(m20)', 'vol - avg(vol)')}, dr AS (SELECT date, coalesce(sum(w * label), 0) AS ret FROM nw GROUP BY date)", {"ret": "ret", "nav": "product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"}, "dr", "date")),
    "split_dates": (lambda s, d: evaluate.split_dates(bars(s, d)), f"WITH {BARS_SQL}, n AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) SELECT max(CASE WHEN k = floor(n * 0.6::DOUBLE) + 1 THEN date END) AS train_end, max(CASE WHEN k = floor(n * 0.8::DOUBLE) + 1 THEN date END) AS valid_end FROM n"),
    "split_train_valid_test": (lambda s, d: bars(s, d).groupBy(evaluate.split_column(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("1997-01-01"))).alias("split")).agg(F.count(F.lit(1)).alias("n")), f"WITH {BARS_SQL} SELECT CASE WHEN date <= DATE '1995-01-01' THEN 'train' WHEN date <= DATE '1997-01-01' THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM bars GROUP BY 1"),
    "fill_null": (_crossed(lambda: evaluate.fill_null("m20")), _cross_sql([{"v": "coalesce(m20, 0)"}])),
    "select_signal": (lambda s, d: value(labelled(s, d).where("m20 IS NOT NULL AND label IS NOT NULL"), F.col("m20")), _cross_sql([{"v": "m20"}]) + " WHERE m20 IS NOT NULL AND label IS NOT NULL"),
}

PREV = [{"pc": f"lag(close) {W}"}, {"band": "CASE WHEN starts_with(instrument, '300') OR starts_with(instrument, '688') THEN 0.2::DOUBLE WHEN starts_with(instrument, '8') OR starts_with(instrument, '4') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END"}]
FEE = {"c": "greatest(5.0::DOUBLE, amount * 0.00025::DOUBLE)"}
BENCH = f"{BARS_SQL}, r AS (SELECT date, close / lag(close) {W} - 1 AS r FROM bars), m AS (SELECT date, coalesce(avg(r), 0) AS m FROM r GROUP BY date)"
WRET_SQL = f"""{WEIGHTS_SQL},
fw AS (SELECT date, instrument, lead(close) {W} / close - 1 AS f FROM bars),
h AS (SELECT DISTINCT portfolio_id, instrument FROM weights),
j AS (SELECT h.portfolio_id, fw.date, h.instrument, coalesce(weight, 0) AS w, coalesce(f, 0) AS f FROM h JOIN fw ON fw.instrument = h.instrument LEFT JOIN weights x ON x.portfolio_id = h.portfolio_id AND x.instrument = h.instrument AND x.date = fw.date),
dd AS (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY portfolio_id, instrument ORDER BY date), 0) AS d FROM j),
dy AS (SELECT portfolio_id, date, sum(w * f) AS gross, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells FROM dd GROUP BY portfolio_id, date),
nt AS (SELECT *, gross - buys * 0.00076::DOUBLE - sells * 0.00176::DOUBLE AS net FROM dy)"""

HELD = f""",
fl AS (SELECT date, instrument, close, CASE WHEN pc > 0 AND close >= pc * (1 + band) - 1e-6::DOUBLE THEN 1 WHEN pc > 0 AND close <= pc * (1 - band) + 1e-6::DOUBLE THEN -1 ELSE 0 END AS flag
  FROM (SELECT *, lag(close) {W} AS pc, {PREV[1]["band"]} AS band FROM bars)),
h AS (SELECT DISTINCT portfolio_id, instrument FROM weights),
tg AS (SELECT h.portfolio_id, h.instrument, fl.date, close, flag, CASE WHEN close > 0 THEN CAST(floor((coalesce(weight, 0) * {CAPITAL}::DOUBLE / close) / 100.0::DOUBLE) * 100 AS BIGINT) ELSE 0 END AS target
  FROM h JOIN fl ON fl.instrument = h.instrument LEFT JOIN weights x ON x.portfolio_id = h.portfolio_id AND x.instrument = h.instrument AND x.date = fl.date),
rn AS (SELECT *, sum(CASE WHEN flag = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id, instrument ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM tg),
held AS (SELECT * EXCLUDE (acts), list_reduce(list_prepend({{'t': 0::BIGINT, 'f': 0}}, acts), lambda a, x: {{'t': CASE WHEN x.f > 0 THEN least(a.t, x.t) WHEN x.f < 0 THEN greatest(a.t, x.t) ELSE x.t END, 'f': x.f}}).t AS shares
  FROM (SELECT *, list({{'t': target, 'f': flag}}) OVER (PARTITION BY portfolio_id, instrument, run ORDER BY date ROWS UNBOUNDED PRECEDING) AS acts FROM rn))"""
HELD_SQL = WEIGHTS_SQL + HELD
ORDER_SQL = f"""{HELD_SQL},
df AS (SELECT *, shares - coalesce(lag(shares) OVER p, 0) AS diff, lag(close) OVER p AS last, coalesce(lag(shares) OVER p, 0) AS was FROM held WINDOW p AS (PARTITION BY portfolio_id, instrument ORDER BY date)),
pr AS (SELECT *, CASE WHEN diff > 0 THEN 'buy' ELSE 'sell' END AS side, close * CASE WHEN diff > 0 THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END AS price FROM df),
ord AS (SELECT *, greatest(5.0::DOUBLE, abs(diff) * price * 0.00025::DOUBLE) + abs(diff) * price * CASE WHEN diff > 0 THEN 0.00001::DOUBLE ELSE 0.00101::DOUBLE END AS fee FROM pr)"""
BOOK_SQL = f"""{ORDER_SQL},
dy AS (SELECT portfolio_id, date, coalesce(sum(was * (close - last)), 0) AS pnl, sum(CASE WHEN diff = 0 THEN 0 ELSE fee END + abs(diff) * close * 0.0005::DOUBLE) AS cost, sum(abs(diff) * close) AS traded FROM ord GROUP BY portfolio_id, date),
bk AS (SELECT *, 1 + sum(pnl - cost) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) / {CAPITAL}::DOUBLE AS raw FROM dy)"""
SWEEP_SQL = f"""{SWEEP_WEIGHTS_SQL}{HELD},
df AS (SELECT *, shares - coalesce(lag(shares) OVER p, 0) AS diff, lag(close) OVER p AS last, coalesce(lag(shares) OVER p, 0) AS was FROM held WINDOW p AS (PARTITION BY portfolio_id, instrument ORDER BY date)),
ord AS (SELECT g.portfolio_id, date, close, last, was, diff, min_commission, commission, transfer, stamp, slippage, abs(diff) * close * CASE WHEN diff > 0 THEN 1 + slippage ELSE 1 - slippage END AS filled FROM df JOIN grid g ON g.plan = df.portfolio_id),
dy AS (SELECT portfolio_id, date, coalesce(sum(was * (close - last)), 0) AS pnl,
  sum(CASE WHEN diff = 0 THEN 0 ELSE greatest(min_commission, filled * commission) + filled * transfer + CASE WHEN diff < 0 THEN filled * stamp ELSE 0 END END + abs(diff) * close * slippage) AS cost, sum(abs(diff) * close) AS traded FROM ord GROUP BY portfolio_id, date),
bk AS (SELECT *, 1 + sum(pnl - cost) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) / {CAPITAL}::DOUBLE AS raw FROM dy)"""
BOOK = {"pnl": "pnl", "cost": "cost", "traded": "traded", "turnover": f"traded / ({CAPITAL}::DOUBLE * (raw + cost / {CAPITAL}::DOUBLE))", "nav": "raw / first_value(raw) OVER (PARTITION BY portfolio_id ORDER BY date)"}

PORTFOLIOS: dict[str, tuple[Query, str]] = {
    "topk_weights": (lambda s, d: _numbers(weights(s, d).where("portfolio_id = 'p10'").drop("portfolio_id"), "date", "instrument"), _numbers_sql(WEIGHTS_SQL, {"weight": "weight"}, "weights", "date, instrument", "WHERE portfolio_id = 'p10'")),
    "sweep_weights": (lambda s, d: _numbers(weights(s, d), "portfolio_id", "date", "instrument"), _numbers_sql(WEIGHTS_SQL, {"weight": "weight"}, "weights", "portfolio_id, date, instrument")),
    "binary_signal": (_crossed(lambda: portfolio.binary_signal("m20", 0.2)), _cross_sql([{"v": f"CASE WHEN m20 IS NOT NULL THEN CASE WHEN (rank() OVER (PARTITION BY date ORDER BY m20 DESC NULLS LAST) + count(m20) OVER (PARTITION BY date ORDER BY m20 DESC NULLS LAST RANGE UNBOUNDED PRECEDING)) / 2.0::DOUBLE <= count(*) {WD} * 0.2::DOUBLE THEN 1 ELSE 0 END END"}])),
    "previous_close": (_valued(portfolio.previous_close), _sql(PREV, "pc")),
    "price_band": (_valued(portfolio.price_band), _sql(PREV, "band")),
    "limit_flag": (_valued(lambda: portfolio.limit_flag("close", portfolio.previous_close(), portfolio.price_band())), _sql([*PREV, {"v": "CASE WHEN pc > 0 AND close >= pc * (1 + band) - 1e-6::DOUBLE THEN 1 WHEN pc > 0 AND close <= pc * (1 - band) + 1e-6::DOUBLE THEN -1 ELSE 0 END"}])),
    "commission": (_valued(lambda: portfolio.commission(F.col("amount"))), _sql([FEE], "c")),
    "buy_fee": (_valued(lambda: portfolio.buy_fee(F.col("amount"))), _sql([FEE, {"v": "c + amount * 0.00001::DOUBLE"}])),
    "sell_fee": (_valued(lambda: portfolio.sell_fee(F.col("amount"))), _sql([FEE, {"v": "c + amount * 0.00001::DOUBLE + amount * 0.001::DOUBLE"}])),
    "round_lot": (_valued(lambda: portfolio.round_lot(F.col("amount"))), _sql([{"v": "floor(amount / 100.0::DOUBLE) * 100"}])),
    "target_shares": (_valued(lambda: portfolio.target_shares(F.lit(0.02), F.col("close"), 1e7)), _sql([{"v": "floor((0.02::DOUBLE * 10000000.0::DOUBLE / close) / 100.0::DOUBLE) * 100"}])),
    "weight_returns": (lambda s, d: _numbers(research.held_returns(s, d), "portfolio_id", "date"), _numbers_sql(WRET_SQL, {"gross": "gross", "buys": "buys", "sells": "sells", "net": "net", "nav": "product(1 + net) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)"}, "nt", "portfolio_id, date")),
    "equal_weight_benchmark": (lambda s, d: _numbers(portfolio.equal_weight_benchmark(bars(s, d)), "date"), _numbers_sql(BENCH, {"benchmark": "product(1 + m) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"}, "m", "date")),
    "attach_benchmark": (_bench_keyed(lambda df: df, "portfolio_id", "date"), _numbers_sql(NAV_SQL, {"nav": "nav", "benchmark": "benchmark"}, "nav", "portfolio_id, date")),
    "positions": (lambda s, d: _numbers(research.held_positions(s, d), "portfolio_id", "instrument", "date"), _numbers_sql(HELD_SQL, {k: k for k in ("close", "flag", "target", "shares")}, "held", "portfolio_id, instrument, date")),
    "blotter": (lambda s, d: _numbers(research.orders(s, d), "portfolio_id", "date", "instrument", "side"), _numbers_sql(ORDER_SQL, {"shares": "abs(diff)", "price": "price", "fee": "fee"}, "ord", "portfolio_id, date, instrument, side", "WHERE diff <> 0")),
    "daily_book": (lambda s, d: _numbers(research.book(s, d), "portfolio_id", "date"), _numbers_sql(BOOK_SQL, BOOK, "bk", "portfolio_id, date")),
    "sweep_book": (lambda s, d: _numbers(research.cost_sweep(s, d), "portfolio_id", "date"), _numbers_sql(SWEEP_SQL, BOOK, "bk", "portfolio_id, date")),
}

K = "portfolio_id"
MET = {
    "total_return": "arg_max(nav, date) / arg_min(nav, date) - 1",
    "annualized_return": "CASE WHEN count(nav) >= 2 AND arg_min(nav, date) > 0 THEN pow(arg_max(nav, date) / arg_min(nav, date), 252.0::DOUBLE / (count(nav) - 1)) - 1 ELSE 'nan'::DOUBLE END",
    "annualized_volatility": "CASE WHEN count(ret) >= 2 THEN stddev_samp(ret) * sqrt(252.0::DOUBLE) ELSE 'nan'::DOUBLE END",
    "sharpe": "CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) ELSE 'nan'::DOUBLE END",
    "sortino": "CASE WHEN avg(CASE WHEN ret < 0 THEN ret * ret END) > 0 THEN avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252.0::DOUBLE) ELSE 'nan'::DOUBLE END",
    "max_drawdown": "-min(drawdown)",
    "win_rate": "avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END)",
    "information_ratio": "CASE WHEN stddev_samp(ret - bench_ret) > 0 THEN avg(ret - bench_ret) / stddev_samp(ret - bench_ret) * sqrt(252.0::DOUBLE) ELSE 'nan'::DOUBLE END",
    "beta": "coalesce(regr_slope(ret, bench_ret), 'nan'::DOUBLE)",
    "alpha": "coalesce(pow(1 + regr_intercept(ret, bench_ret), 252.0::DOUBLE) - 1, 'nan'::DOUBLE)",
}
MET_SQL = f"{NAV_SQL}, mm AS (SELECT {K}, {', '.join(f'{e} AS {n}' for n, e in MET.items())} FROM rets GROUP BY {K})"
CALMAR = "CASE WHEN max_drawdown > 0 THEN annualized_return / max_drawdown ELSE 'nan'::DOUBLE END"
RR = f"{NAV_SQL}, rr AS (SELECT {K}, date, ret FROM rets WHERE ret IS NOT NULL)"


def _var_sql(conf: str, name: str) -> str:
    return f"{name}a AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ret) - 1 AS k, ceil((count(*) OVER (PARTITION BY {K}) - 1)::DOUBLE * (1.0::DOUBLE - {conf}::DOUBLE)) AS place FROM rr), {name} AS (SELECT {K}, ret AS cut FROM {name}a WHERE k = place)"


RISK = f"{RR}, {_var_sql('0.95', 'v95')}, {_var_sql('0.99', 'v99')}"
DD_SQL = f"fl AS (SELECT *, coalesce(nav >= max(nav) OVER (PARTITION BY {K} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS pk FROM nav), ru AS (SELECT *, sum(pk) OVER (PARTITION BY {K} ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM fl), dg AS (SELECT {K}, max(n) AS max_drawdown_days FROM (SELECT {K}, run, sum(1 - pk) AS n FROM ru GROUP BY {K}, run) GROUP BY {K})"
CV = {n: f"(SELECT -avg(ret) FROM rr WHERE rr.{K} = dg.{K} AND ret <= (SELECT cut FROM {v} WHERE {v}.{K} = dg.{K}))" for n, v in (("cvar_95", "v95"), ("cvar_99", "v99"))}
HIST = f"{RR}, hb AS (SELECT {K}, least(59, floor((ret - min(ret) OVER p) / (max(ret) OVER p - min(ret) OVER p) * 60.0::DOUBLE)::INT) AS bin FROM rr WINDOW p AS (PARTITION BY {K}))"


def _unpivoted(run: str, table: str, columns: dict[str, str], source: str, entity: str = "''", date: str = "date") -> str:
    """Rows run_id, table_name, entity, date, measure, v, all values as DOUBLE."""
    return " UNION ALL ".join(f"SELECT '{run}' AS run_id, '{table}' AS table_name, {entity} AS entity, {date} AS date, '{name}' AS measure, ({e})::DOUBLE AS v FROM {source}" for name, e in columns.items())


RUN_FACTORS = {"momentum_20": f"(close - lag(close, 20) {W}) / lag(close, 20) {W}", "reversal_5": f"-((close - lag(close, 5) {W}) / lag(close, 5) {W})"}


def _run_sql(run: str, factor: str) -> str:
    """Everything that a run of one factor writes, from the bars b0, in long form. Days without a change have a return of 0, whatever the order of sums."""
    ranked = f"rk AS (SELECT *, {_rank_sql('z')} AS rf, {_rank_sql('label')} AS rl FROM z)"
    layers = {f"Group{i}": f"avg(CASE WHEN ceil(rf * 10) = {i} THEN label END)" for i in range(1, 11)}
    wide = ", ".join(f"{e} AS {n}" for n, e in layers.items())
    weights = "weights AS (SELECT '' AS portfolio_id, date, instrument, 1.0::DOUBLE / k AS weight FROM (SELECT *, greatest(1, CAST(floor(count(*) OVER (PARTITION BY date) * 0.2::DOUBLE + 0.5::DOUBLE) AS INT)) AS k, row_number() OVER (PARTITION BY date ORDER BY z DESC, instrument) AS n FROM z WHERE z IS NOT NULL) WHERE n <= k)"
    ctes = f"""bars AS (SELECT * FROM b0), raw AS (SELECT date, instrument, close, lead(close) {W} / close - 1 AS label, {RUN_FACTORS[factor]} AS f FROM bars),
z AS MATERIALIZED (SELECT date, instrument, close, label, CASE WHEN stddev_samp(f) {WD} > 0 THEN (f - avg(f) {WD}) / stddev_samp(f) {WD} END AS z FROM raw),
{ranked},
ic AS (SELECT date, {_corr_sql('z', 'label')} AS ic, {_corr_sql('rf', 'rl')} AS rank_ic FROM rk GROUP BY date),
lay AS (SELECT *, Group1 - Group10 AS ls FROM (SELECT date, {wide} FROM rk GROUP BY date)),
nw AS (SELECT *, {_ieee('o', f'sum(abs(o)) {WD}')} AS w FROM (SELECT *, z - avg(z) {WD} AS o FROM z)),
tov AS (SELECT date, sum(coalesce(c, 0)) AS turnover FROM (SELECT date, abs(w - lag(w) {W}) AS c FROM nw) GROUP BY date),
{weights}{HELD}{ORDER_SQL[len(HELD_SQL):]}{BOOK_SQL[len(ORDER_SQL):]},
bm AS (SELECT date, product(1 + m) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT date, coalesce(avg(r), 0) AS m FROM (SELECT date, close / lag(close) {W} - 1 AS r FROM bars) GROUP BY date)),
nav AS MATERIALIZED (SELECT bk.portfolio_id, bk.date, round(raw / first_value(raw) OVER p, 12) AS nav, b / first_value(b) OVER p AS benchmark
  FROM bk JOIN bm ON bm.date = bk.date WINDOW p AS (PARTITION BY portfolio_id ORDER BY bk.date)){NAV_SQL[NAV_SQL.index(",\nrets AS"):]},
mm AS (SELECT {K}, {', '.join(f'{e} AS {n}' for n, e in MET.items())} FROM rets GROUP BY {K}){RISK[len(NAV_SQL):]}, {DD_SQL.replace("fl AS (", "below AS (").replace("FROM fl)", "FROM below)")},
ics AS (SELECT * FROM ic)"""
    risk = {"max_drawdown_days": "max_drawdown_days", "var_95": f"(SELECT -cut FROM v95 WHERE v95.{K} = dg.{K})", "cvar_95": CV["cvar_95"], "var_99": f"(SELECT -cut FROM v99 WHERE v99.{K} = dg.{K})", "cvar_99": CV["cvar_99"]}
    summary = {}
    for c, short in (("ic", "icir"), ("rank_ic", "rank_icir")):
        x = f"CASE WHEN NOT isnan({c}) THEN {c} END"
        ratio = f"(CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) ELSE 'nan'::DOUBLE END)"
        summary |= {f"{c}_mean": f"coalesce(avg({x}), 'nan'::DOUBLE)", short: ratio, f"{c}_t": f"{ratio} * sqrt(count({x})::DOUBLE)"}
    parts = [
        _unpivoted(run, "ic", {"ic": "ic", "rank_ic": "rank_ic"}, "ic"),
        _unpivoted(run, "layers", {**{n: n for n in layers}, "long_short": "ls"}, "lay"),
        _unpivoted(run, "turnover", {"turnover": "turnover"}, "tov"),
        _unpivoted(run, "trades", {"shares": "abs(diff)", "price": "price", "fee": "fee"}, "(SELECT * FROM ord WHERE diff <> 0)", "instrument || '/' || side"),
        _unpivoted(run, "nav", {"nav": "nav", "benchmark": "benchmark"}, "nav"),
        _unpivoted(run, "metrics", {**{n: n for n in MET}, "calmar": CALMAR}, "mm", date="NULL::DATE"),
        _unpivoted(run, "metrics", risk, "dg", date="NULL::DATE"),
        _unpivoted(run, "metrics", summary, "ics", date="NULL::DATE"),
    ]
    return f"WITH {ctes} {' UNION ALL '.join(parts)}"


def _runs_sql() -> str:
    own = " UNION ALL ".join(f"SELECT * FROM ({_run_sql(run, factor)})" for run, factor in research.RUNS)
    return f"WITH {BARS_SQL}, b0 AS MATERIALIZED (SELECT * FROM bars), u AS ({own}) SELECT run_id, table_name, entity, date, measure, {digits_sql('value', 'v')} FROM u"


def _returns_of(s: SparkSession, d: str) -> DataFrame:
    return metrics.daily_returns(nav(s, d))


METRICS: dict[str, tuple[Query, str]] = {
    "daily_returns": (_bench_keyed(lambda df: metrics.daily_returns(df).select(K, "date", "ret"), K, "date"), _numbers_sql(NAV_SQL, {"ret": "ret"}, "rets", f"{K}, date")),
    "drawdown_series": (_bench_keyed(lambda df: metrics.drawdown_series(df).select(K, "date", "drawdown"), K, "date"), _numbers_sql(NAV_SQL, {"drawdown": "drawdown"}, "rets", f"{K}, date")),
    "summary": (_bench_keyed(metrics.summary, K), _numbers_sql(MET_SQL, {**{n: n for n in MET}, "calmar": CALMAR}, "mm", K)),
    **{n: (_bench_keyed(lambda df, n=n: metrics.summary(df).select(K, n), K), _numbers_sql(MET_SQL, {n: CALMAR if n == "calmar" else n}, "mm", K)) for n in ("annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown", "information_ratio", "calmar", "win_rate", "beta", "alpha")},
    "value_at_risk": (lambda s, d: _numbers(metrics.value_at_risk(_returns_of(s, d), 0.95), K), _numbers_sql(RISK, {"var": "-cut"}, "v95", K)),
    "expected_shortfall": (lambda s, d: _numbers(metrics.expected_shortfall(_returns_of(s, d), 0.95), K), _numbers_sql(f"{RISK}, es AS (SELECT rr.{K}, -avg(ret) AS c FROM rr JOIN v95 ON v95.{K} = rr.{K} WHERE ret <= cut GROUP BY rr.{K})", {"cvar": "c"}, "es", K)),
    "value_at_risk_large": (lambda s, d: _numbers(metrics.value_at_risk(_returns_of(s, d).withColumn("yr", F.year("date")), 0.95, ["yr"], large=True), "yr"), _numbers_sql(f"{RR}, ya AS (SELECT year(date) AS yr, ret, row_number() OVER (PARTITION BY year(date) ORDER BY ret) - 1 AS k, ceil((count(*) OVER (PARTITION BY year(date)) - 1)::DOUBLE * (1.0::DOUBLE - 0.95::DOUBLE)) AS place FROM rr), y95 AS (SELECT yr, ret AS cut FROM ya WHERE k = place)", {"var": "-cut"}, "y95", "yr")),
    "longest_drawdown_days": (lambda s, d: metrics.longest_drawdown_days(nav(s, d)), f"WITH {NAV_SQL}, {DD_SQL} SELECT {K}, max_drawdown_days::BIGINT AS max_drawdown_days FROM dg"),
    "rolling_value_at_risk": (lambda s, d: _numbers(metrics.rolling_value_at_risk(_returns_of(s, d)).select(K, "date", "rolling_var"), K, "date"), _numbers_sql(f"{RR}, rl AS (SELECT {K}, date, list(ret) OVER (PARTITION BY {K} ORDER BY date ROWS 59 PRECEDING) AS l FROM rr)", {"rolling_var": "CASE WHEN len(l) = 60 THEN -list_sort(l)[4] ELSE 'nan'::DOUBLE END"}, "rl", f"{K}, date")),
    "risk_metrics": (lambda s, d: _numbers(metrics.risk_metrics(nav(s, d)), K), _numbers_sql(f"{RISK}, {DD_SQL}", {"max_drawdown_days": "max_drawdown_days::DOUBLE", "var_95": f"(SELECT -cut FROM v95 WHERE v95.{K} = dg.{K})", "cvar_95": CV["cvar_95"], "var_99": f"(SELECT -cut FROM v99 WHERE v99.{K} = dg.{K})", "cvar_99": CV["cvar_99"]}, "dg", K)),
    "scenario_stress": (lambda s, d: _numbers(metrics.scenario_stress(nav(s, d)), K, "scenario"), _numbers_sql(f"{MET_SQL}, sc AS (SELECT * FROM (VALUES ('single_day_5', -0.05::DOUBLE, 1), ('single_day_10', -0.1::DOUBLE, 1), ('three_days_5', -0.05::DOUBLE, 3), ('five_days_3', -0.03::DOUBLE, 5)) t(scenario, shock, days))", {"loss": "pow(1 + (CASE WHEN isnan(beta) THEN 1 ELSE beta END) * shock, days) - 1"}, "mm, sc", f"{K}, scenario")),
    "return_histogram": (lambda s, d: metrics.return_histogram(_returns_of(s, d)), f"WITH {HIST} SELECT {K}, bin, count(*) AS n FROM hb GROUP BY {K}, bin"),
}



def _units_sql(key: str, n: int) -> str:
    return ", ".join(f"(('0x' || substr(md5({key} || '|{i // 4}'), {8 * (i % 4) + 1}, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u{i}" for i in range(n))


def _synthetic_sql() -> str:
    normal = lambda a, b: f"sqrt(-2 * ln(u{a})) * cos(2 * pi() * u{b})"
    p = "OVER (PARTITION BY instrument ORDER BY date)"
    return f"""WITH {BARS_SQL}, pf AS (SELECT count(DISTINCT instrument) AS k, min(date) AS lo, max(date) AS hi FROM bars),
c0 AS (SELECT lpad(unnest(range(1, k + 1))::VARCHAR, 6, '0') AS instrument FROM pf), c1 AS (SELECT instrument, {_units_sql("'42|' || instrument", 3)} FROM c0),
c2 AS (SELECT instrument, {normal(0, 1)} * 0.004::DOUBLE AS drift, u2 * 0.015::DOUBLE + 0.015::DOUBLE AS vol FROM c1),
days AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM pf),
d0 AS (SELECT *, {_units_sql("'42|' || instrument || '|' || date::VARCHAR", 8)} FROM c2, (SELECT date FROM days WHERE isodow(date) < 6)),
d1 AS (SELECT date, instrument, drift / 10 + vol * {normal(0, 1)} AS r, {normal(2, 3)} AS n1, {normal(4, 5)} AS n2, {normal(6, 7)} AS n3 FROM d0),
d2 AS (SELECT *, 100 * exp(sum(r) {p[:-1]} ROWS UNBOUNDED PRECEDING)) AS close FROM d1),
d3 AS (SELECT *, coalesce(lag(close) {p}, 100) * (1 + n1 * 0.002::DOUBLE) AS open, greatest(1e5::DOUBLE, 1e7::DOUBLE * (1 + 20 * abs(r) + n2 * 0.1::DOUBLE)) AS volume FROM d2),
d4 AS (SELECT date, instrument, open, greatest(open, close) * (1 + abs(n2) * 0.003::DOUBLE) AS high, least(open, close) * (1 - abs(n3) * 0.003::DOUBLE) AS low, close, volume, close * volume AS amount, least(greatest(volume / 2e9::DOUBLE * 100, 0.05::DOUBLE), 15.0::DOUBLE) AS turnover_rate FROM d3)
SELECT date, instrument, {", ".join(digits_sql(n, n) for n in panel.NUMBERS)} FROM d4"""


SOURCES: dict[str, tuple[Query, str]] = {
    "build_bars": (lambda s, d: _numbers(bars(s, d), "date", "instrument"), _numbers_sql(BARS_SQL, {n: n for n in panel.NUMBERS}, "bars", "date, instrument")),
    "validate_panel": (lambda s, d: _numbers(panel.validate_panel(bars(s, d)).select("date", "instrument", "close"), "date", "instrument"), _numbers_sql(BARS_SQL, {"close": "close"}, "bars", "date, instrument")),
    "panel_profile": (lambda s, d: panel.profile(bars(s, d)), f"WITH {BARS_SQL} SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_instruments, min(date) AS first_date, max(date) AS last_date FROM bars"),
    "union_panels": (lambda s, d: _numbers(panel.union_panels([bars(s, d).where("instrument < '6'"), bars(s, d).where("instrument >= '6'")]).select("date", "instrument", "close"), "date", "instrument"), _numbers_sql(BARS_SQL, {"close": "close"}, "bars", "date, instrument")),
    "date_range": (lambda s, d: _numbers(panel.date_range(bars(s, d), "1994-01-01", "1995-12-31").select("date", "instrument", "close"), "date", "instrument"), _numbers_sql(BARS_SQL, {"close": "close"}, "bars", "date, instrument", "WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")),
    "universe": (lambda s, d: _numbers(panel.universe(bars(s, d), bars(s, d).groupBy("instrument").agg(F.sum("amount").alias("a")).where("a > 13000000").select("instrument")).select("date", "instrument", "close"), "date", "instrument"), _numbers_sql(BARS_SQL, {"close": "close"}, "bars", "date, instrument", "WHERE instrument IN (SELECT instrument FROM bars GROUP BY instrument HAVING sum(amount) > 13000000)")),
    "panel_round_trip": (lambda s, d: _numbers(research.round_trip(s, d).select("date", "instrument", "close"), "date", "instrument"), _numbers_sql(BARS_SQL, {"close": "close"}, "bars", "date, instrument")),
    "research_runs": (lambda s, d: _numbers(research.two_runs(s, d), "run_id", "table_name", "entity", "date", "measure"), _runs_sql()),
    "synthetic_panel": (lambda s, d: _numbers(research.synthetic_like(s, d), "date", "instrument"), _synthetic_sql()),
}



def _raw_factor_sql(name: str) -> str:
    """A factor of the bars b0 in steps of research.STEP, NaN as null."""
    own = FACTOR_SQL[name].replace(f"WITH {BARS_SQL}", "WITH bars AS (SELECT * FROM b0)", 1)
    return own.replace(digits_sql("value", "v"), f"CASE WHEN NOT isnan(v) THEN round((v)::DOUBLE / {research.STEP!r}::DOUBLE) * {research.STEP!r}::DOUBLE END AS v")


def _research_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{n}' AS factor, date, instrument, v FROM ({_raw_factor_sql(n)})" for n in FACTOR_SQL)
    ctes = f"""{BARS_SQL}, b0 AS MATERIALIZED (SELECT * FROM bars), lab AS (SELECT date, instrument, lead(close, 1) {W} / close - 1 AS label FROM b0),
lf AS MATERIALIZED (SELECT x.*, label FROM ({long}) x JOIN lab ON lab.date = x.date AND lab.instrument = x.instrument),
rk2 AS (SELECT *, {_rank_sql('v', 'factor, date')} AS rf, {_rank_sql('label', 'factor, date')} AS rl FROM lf),
ics AS (SELECT factor, date, {_corr_sql('v', 'label')} AS ic, {_corr_sql('rf', 'rl')} AS rank_ic FROM rk2 GROUP BY factor, date)"""
    return _summary_sql("ics", ctes, "factor")


def _linear_sql() -> str:
    """Coefficients b0 (of 1), b1, ... of the rows of train by elimination, and p: the predictions of all rows."""
    names, k = research.FEATURES, len(research.FEATURES)
    x = ["1", *names]
    scaled = ", ".join(f"coalesce(CASE WHEN stddev_samp({n}) {WD} > 0 THEN ({n} - avg({n}) {WD}) / stddev_samp({n}) {WD} END, 0)::DOUBLE AS {n}" for n in names)
    sums = ", ".join(f"sum({a} * {b})::DOUBLE AS m_{i}_{j}" for i, a in enumerate(x) for j, b in enumerate([*x, "label"]))
    out = f"""{BARS_SQL}, f0 AS (SELECT date, instrument, lead(close) {W} / close - 1 AS label, ({D}) / lag(close) {W} AS r, {RUN_FACTORS['momentum_20']} AS momentum_20, {RUN_FACTORS['reversal_5']} AS reversal_5, close / open - 1 AS kbar_kmid FROM bars),
f1 AS (SELECT *, {_agg('stddev_samp({})', 'r', 20)} AS volatility_20 FROM f0),
d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM f1)),
cut AS (SELECT max(CASE WHEN k = floor(n * 0.6::DOUBLE) + 1 THEN date END) AS train_end, max(CASE WHEN k = floor(n * 0.8::DOUBLE) + 1 THEN date END) AS valid_end FROM d),
sc AS MATERIALIZED (SELECT date, instrument, label, {scaled}, CASE WHEN date <= train_end THEN 'train' WHEN date <= valid_end THEN 'valid' ELSE 'test' END AS split FROM f1, cut),
e0 AS (SELECT {sums} FROM sc WHERE split = 'train' AND label IS NOT NULL)"""
    for p in range(k + 1):
        cells = ", ".join(f"m_{i}_{j}" if i == p else f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p} AS m_{i}_{j}" for i in range(k + 1) for j in range(k + 2))
        out += f",\ne{p + 1} AS (SELECT {cells} FROM e{p})"
    value = " + ".join(f"m_{i}_{k + 1} / m_{i}_{i} * {a}" for i, a in enumerate(x))
    return out + f",\np AS (SELECT date, instrument, label, split, {value} AS predict FROM sc, e{k + 1} WHERE label IS NOT NULL)"


MODELS: dict[str, tuple[Query, str]] = {
    "fit_predict_trees": (research.trees, ""),
    "fit_predict_linear": (lambda s, d: _numbers(research.linear(s, d), "date", "instrument"), _numbers_sql(_linear_sql(), {"predict": "predict"}, "p", "date, instrument", "WHERE split = 'test'")),
    "feature_importances": (research.tree_importances, ""),
    "validation_ic": (lambda s, d: _numbers(research.valid_ic(s, d)), _numbers_sql(_linear_sql(), {"ic": _corr_sql("predict", "label")}, "p", "", "WHERE split = 'valid'")),
    "factor_research": (lambda s, d: _numbers(research.factor_research(s, d), "factor"), _research_sql()),
}


def _all() -> dict[str, tuple[Query, str]]:
    return {**EVALUATION, **ROLLING, **CROSS, **ELEMENTS, **FACTORS, **PORTFOLIOS, **METRICS, **SOURCES, **MODELS}


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _all().items() if s}
