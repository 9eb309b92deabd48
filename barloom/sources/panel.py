"""Bar panels: reading, writing, checking, building from trades, generating, restricting, profiling."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.operators.timeseries import DATE, INSTRUMENT

NUMBERS = ("open", "high", "low", "close", "volume", "amount", "turnover_rate")
PANEL = T.StructType([T.StructField(DATE, T.DateType()), T.StructField(INSTRUMENT, T.StringType()), *[T.StructField(n, T.DoubleType()) for n in NUMBERS]])


def validate_panel(df: DataFrame, unique: bool = True) -> DataFrame:
    """The panel's columns by name and type, others kept after them; ValueError for a missing one or a repeated (date, instrument)."""
    if missing := [c for c in (DATE, INSTRUMENT) if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    types = {f.name: f.dataType for f in PANEL.fields}
    out = df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in [*[n for n in types if n in df.columns], *[c for c in df.columns if c not in types]]])
    if unique and out.groupBy(DATE, INSTRUMENT).count().where("count > 1").limit(1).count():
        raise ValueError("a date and instrument occur twice")
    return out


def read_panel(spark: SparkSession, path: str, columns: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A written panel, restricted by date in the scan; only `columns` besides the keys are read if given."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(DATE, INSTRUMENT, *columns)
    return date_range(df, start, end)


def write_panel(df: DataFrame, path: str) -> None:
    """Partitions by year: dates prune, and files stay large."""
    df.withColumn("year", F.year(DATE)).repartition("year", F.pmod(F.hash(INSTRUMENT), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)


def union_panels(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(DATE) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(DATE) <= F.to_date(F.lit(end)))
    return df


def with_history(df: DataFrame, start: str, end: str | None, rows: int) -> DataFrame:
    """The bars from `start` to `end` and, of every instrument that has any, its last `rows` bars before `start`.

    A first pass reads dates and instruments alone and finds where each instrument has to begin. The earliest
    of these dates goes into the scan as a filter; the others sort out instruments with more bars than that.
    """
    inside = F.col(DATE) >= F.to_date(F.lit(start))
    dates = date_range(df, None, end).select(INSTRUMENT, DATE)
    # a rank from the latest row before start on; no more than `rows` of them are kept on either side of the shuffle
    before = dates.where(~inside).withColumn("_n", F.row_number().over(Window.partitionBy(INSTRUMENT).orderBy(F.desc(DATE)))).where(F.col("_n") <= rows)
    first = before.select(INSTRUMENT, DATE).unionByName(dates.where(inside)).groupBy(INSTRUMENT).agg(F.min(DATE).alias("_first"), F.max(DATE).alias("_last"))
    first = first.where(F.col("_last") >= F.to_date(F.lit(start))).select(INSTRUMENT, "_first")
    least = first.agg(F.min("_first")).first()[0]
    own = date_range(df, None if least is None else str(least), end)
    return own.join(first, INSTRUMENT).where(F.col(DATE) >= F.col("_first")).select(*df.columns)


def universe(df: DataFrame, codes: str | Iterable[str] | DataFrame) -> DataFrame:
    """The bars of some instruments: a comma-separated string, a list, or a table with a column `instrument`."""
    if isinstance(codes, DataFrame):
        return df.join(codes.select(INSTRUMENT).distinct(), INSTRUMENT, "left_semi")
    if isinstance(codes, str):
        codes = [c.strip() for c in codes.split(",") if c.strip()]
    return df.where(F.col(INSTRUMENT).isin(list(codes)))


def build_bars(trades: DataFrame, instrument: Column, date: Column, price: Column, quantity: Column, order: Column, float_shares: float = 1000.0) -> DataFrame:
    """Bars from single trades, with open and close by `order` within the day.

    First and last trades have structs as state, which only sorted aggregation holds. Trades are dealt by instrument
    and sorted once, which also serves the windows along instruments that follow.
    """
    # the trades' own columns travel, of which Spark keeps those that are named; price, quantity and order, made of them, are made behind the exchange
    dealt = trades.withColumn("_dealt", instrument).repartition("_dealt")
    rows = dealt.select(F.col("_dealt").alias(INSTRUMENT), date.alias(DATE), price.cast("double").alias("_p"), quantity.cast("double").alias("_q"), order.alias("_o"))
    bars = rows.groupBy(INSTRUMENT, DATE).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"),
        F.sum("_q").alias("volume"), F.sum(F.col("_p") * F.col("_q")).alias("amount"),
    )
    return bars.select(DATE, INSTRUMENT, *NUMBERS[:-1], (F.col("volume") / F.lit(float_shares) * F.lit(100.0)).alias("turnover_rate"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, instruments, first and last date."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(INSTRUMENT).alias("n_instruments"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"))


def hashed_units(key: Column, n: int) -> list[Column]:
    """n numbers between 0 and 1 from a text: each is 32 bits of an md5 of the text and a count, whatever the partitions."""
    digests = [F.md5(F.concat_ws("|", key, F.lit(str(i)))) for i in range(-(-n // 4))]
    return [(F.conv(F.substring(digests[i // 4], 8 * (i % 4) + 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32) for i in range(n)]


def _normal(a: str, b: str) -> Column:
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * F.lit(math.pi) * F.col(b))


def synthetic_panel(spark: SparkSession, start: str, end: str, instruments: int, seed: int = 42) -> DataFrame:
    """Weekday bars of a random walk for each code: drift and volatility by code, opens near the last close.

    All noise is a hash of seed, code and date, so the panel is the same on any cluster, in every run and retry.
    """
    code = F.lpad((F.col("id") + 1).cast("string"), 6, "0")
    units = lambda key, n: {f"_u{i}": u for i, u in enumerate(hashed_units(key, n))}
    codes = spark.range(instruments).select(code.alias(INSTRUMENT)).withColumns(units(F.concat_ws("|", F.lit(str(seed)), INSTRUMENT), 3))
    codes = codes.select(INSTRUMENT, (_normal("_u0", "_u1") * 0.004).alias("_drift"), (F.col("_u2") * 0.015 + 0.015).alias("_vol"))
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL 1 DAY")))
    df = codes.select("*", days.alias(DATE)).where(F.weekday(DATE) < 5)
    df = df.withColumns(units(F.concat_ws("|", F.lit(str(seed)), INSTRUMENT, F.col(DATE).cast("string")), 8))
    df = df.select(INSTRUMENT, DATE, (F.col("_drift") / 10 + F.col("_vol") * _normal("_u0", "_u1")).alias("_r"), *[_normal(f"_u{2 * i}", f"_u{2 * i + 1}").alias(f"_n{i}") for i in (1, 2, 3)])
    w = Window.partitionBy(INSTRUMENT).orderBy(DATE)
    df = df.withColumn("close", F.lit(100.0) * F.exp(F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)) * (1 + F.col("_n1") * 0.002))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    df = df.withColumns({"high": top * (1 + F.abs("_n2") * 0.003), "low": bottom * (1 - F.abs("_n3") * 0.003), "volume": F.greatest(F.lit(1e5), F.lit(1e7) * (1 + 20 * F.abs("_r") + F.col("_n2") * 0.1))})
    turnover = F.least(F.greatest(F.col("volume") / 2e9 * 100, F.lit(0.05)), F.lit(15.0))
    return df.select(DATE, INSTRUMENT, "open", "high", "low", "close", "volume", (F.col("close") * F.col("volume")).alias("amount"), turnover.alias("turnover_rate"))
