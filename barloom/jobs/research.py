"""Jobs that put several operators together."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import INF
from barloom.jobs.tables import CAPITAL, bars, fifty_portfolios, signal_panel, two_portfolios
from barloom.operators import crosssection as cs
from barloom.operators import evaluate, factors, metrics, models, portfolio
from barloom.sources import panel, results

FEATURES = ["momentum_20", "reversal_5", "volatility_20", "kbar_kmid"]


def features(spark: SparkSession, sf_dir: str, names: Sequence[str] = FEATURES) -> DataFrame:
    """Standardized factors and the next return as label, from one shuffle by instrument and one by date."""
    p = bars(spark, sf_dir).withColumn("label", evaluate.forward_return(1))
    f = factors.compute_factors(p, list(names), keep=["label"])
    # NaN becomes null before the cross-section, so that one undefined value does not spoil a date
    f = f.select("date", "instrument", "label", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    z = f.withColumns({f"_m_{c}": cs.cs_mean(c) for c in names} | {f"_s_{c}": cs.cs_std(c) for c in names})
    return z.select("date", "instrument", "label", *[F.when(F.col(f"_s_{c}") > 0, F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).alias(c) for c in names])


#: Values that differ by less are ties: sums in another order do not change ranks.
STEP = 1e-10


def factor_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors of the library evaluated at once: one row for each. A z-score by date would change no correlation of a date, so none is taken."""
    names = factors.factor_names()
    p = bars(spark, sf_dir).withColumn("label", evaluate.forward_return(1))
    raw = factors.compute_factors(p, names, keep=["label"])
    # NaN becomes null before the cross-section, so that one undefined value does not spoil a date
    raw = raw.select("date", "instrument", "label", *[F.when(~F.isnan(c), F.rint(F.col(c) / STEP) * STEP).alias(c) for c in names])
    return evaluate.evaluate_factors(raw, names)


def _bounds(df: DataFrame) -> tuple[str, str]:
    """The ends of train and valid rows; bars have the dates of their factors, and need no windows to tell them."""
    row = evaluate.split_dates(df).first()
    return str(row["train_end"]), str(row["valid_end"])


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of boosted trees on all factors of the library."""
    names = factors.factor_names()
    df = features(spark, sf_dir, names)
    return models.fit_predict(df, names, *_bounds(bars(spark, sf_dir)), models.boosted_trees())


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    return models.fit_predict(df, FEATURES, *_bounds(bars(spark, sf_dir)), models.linear())


def tree_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = factors.factor_names()
    df = features(spark, sf_dir, names)
    prepared = models.prepare(df, names, *_bounds(bars(spark, sf_dir))).persist()
    try:
        model = models.fit(prepared, models.boosted_trees())
    finally:
        prepared.unpersist()
    return models.top_importances(models.importances(model, names, spark))


def valid_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    prepared = models.prepare(df, FEATURES, *_bounds(bars(spark, sf_dir)))
    return models.validation_ic(models.fit(prepared, models.linear()).transform(prepared))


def held_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = portfolio.sweep_positions(signal_panel(spark, sf_dir), two_portfolios(spark), CAPITAL)
    return held.drop("last", "was")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.sweep_blotter(signal_panel(spark, sf_dir), two_portfolios(spark), CAPITAL)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.sweep_book(signal_panel(spark, sf_dir), two_portfolios(spark), CAPITAL)


def held_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.sweep_returns(signal_panel(spark, sf_dir), two_portfolios(spark))


def cost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily book of fifty portfolios: five signals, two sizes, five sets of costs."""
    return portfolio.sweep_book(signal_panel(spark, sf_dir), fifty_portfolios(spark), CAPITAL)


#: Tables that a run writes besides its signals.
RUN_TABLES = ("ic", "layers", "turnover", "trades", "nav", "metrics")


def research_run(bars: DataFrame, base: str, run_id: str, factor: str, method: str = "zscore", horizon: int = 1, groups: int = 10, top_k: float = 0.2, capital: float = 1e8, costs: portfolio.Costs = portfolio.Costs()) -> None:  # noqa: B008
    """One signal from bars to results: factor, cross-section, IC, layers, turnover, book and metrics, written as one run.

    signals (date, instrument, close, label, predict) are written first and everything else starts from them. Positions are
    written too until the run ends: orders and book both start from them, and their fold is the dearest step.
    Metrics are in long form (metric, value): performance, risk and the summary of the ICs.
    """
    spark = bars.sparkSession
    with results.Run(spark, base, run_id) as run:
        p = bars.withColumn("label", evaluate.forward_return(horizon))
        f = cs.standardize(factors.compute_factors(p, [factor], keep=["close", "label"]), [factor], method, keep=["close", "label"])
        value = F.col(factor)
        # neither NaN nor an infinity is a signal
        usable = ~F.isnan(value) & (F.abs(value) < F.lit(INF))
        signals = run.put("signals", f.select("date", "instrument", "close", "label", F.when(usable, value).alias("predict")))
        ics = run.put("ic", evaluate.ic_frame(signals, "predict"))
        run.put("layers", evaluate.group_return(signals, "predict", groups=groups))
        run.put("turnover", evaluate.factor_turnover(signals, "predict"))
        grid = spark.createDataFrame([(run_id, "predict", float(top_k), costs.lot, *map(float, (costs.commission, costs.min_commission, costs.stamp, costs.transfer, costs.slippage)))], "portfolio_id string, signal string, top_k double, lot int, commission double, min_commission double, stamp double, transfer double, slippage double")
        held = run.aside("positions", portfolio.sweep_positions(signals, grid, capital))
        run.put("trades", portfolio.blotter(held, costs))
        book = portfolio.daily_book(held, capital, costs)
        nav = run.put("nav", portfolio.attach_benchmark(book, portfolio.equal_weight_benchmark(signals)))
        performance = metrics.summary(nav).join(metrics.risk_metrics(nav), "portfolio_id").drop("portfolio_id")
        run.put("metrics", _long(performance, "metric").unionByName(_long(evaluate.ic_summary(ics), "metric")))


def _long(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, the name of each other column and its value as a double."""
    own = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns if c not in keys])
    return own.unpivot(list(keys), [f"`{c}`" for c in own.columns if c not in keys], name, "value").withColumn(name, F.translate(name, "-`", "_"))


RUNS = (("momentum", "momentum_20"), ("reversal", "reversal_5"))


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes two runs and rereads all their tables: run_id, table_name, entity, date, measure, value."""
    base = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    p = bars(spark, sf_dir)
    for run_id, factor in RUNS:
        research_run(p, base, run_id, factor, capital=CAPITAL)
    parts = []
    for table in RUN_TABLES:
        t = results.read_results(spark, base, table)
        entity = F.concat_ws("/", "instrument", "side") if table == "trades" else F.lit("")
        date = F.col("date") if "date" in t.columns else F.lit(None).cast("date")
        t = t.withColumns({"table_name": F.lit(table), "entity": entity, "date": date}).drop("instrument", "side", "portfolio_id")
        keys = ("run_id", "table_name", "entity", "date")
        parts.append(t.withColumnRenamed("metric", "measure").select(*keys, "measure", "value") if table == "metrics" else _long(t, "measure", keys))
    return panel.union_panels(parts)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; in local mode alone a temporary one will do."""
    if base := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-panel-')}"


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel written by year and read again."""
    path = f"{shared_folder(spark)}/panel-{spark.sparkContext.applicationId}"
    panel.write_panel(bars(spark, sf_dir), path)
    return panel.read_panel(spark, path, ["close"])


def synthetic_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic panel over the dates and with as many instruments as the bars of the tables."""
    row = panel.profile(bars(spark, sf_dir)).first()
    return panel.synthetic_panel(spark, str(row["first_date"]), str(row["last_date"]), row["n_instruments"])
