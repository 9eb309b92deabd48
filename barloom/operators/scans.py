"""Recurrences along a series by blocks, for what no window function expresses.

A recurrence state' = step(state, row) can be computed by blocks of rows if the effect of a whole block on
any state is a value of fixed size: blocks are folded by themselves, the effects carry the state from
block to block, and the rows of a block follow from its first state. The cost of a row does not grow with the
length of its series, everything is a built-in function, and with `spread` a single series is worked
on by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATE = "date"
#: Rows of a block where blocks are counted: a row's state is appended to those of its block, so a row costs as its block is long.
BLOCK = 32

Fold = Callable[[Column, Column], Column]


def block_scan(rows: DataFrame, keys: Iterable[str], start: Column, step: Fold, effect: Column, absorb: Fold, apply: Fold, order: str = DATE, spread: Column | None = None) -> DataFrame:
    """The rows with `was` and `now`: the state before and after each row of its series, from `start` on.

    step(state, row) gives the next state. `effect` is that of no rows, absorb(effect, row) adds a row to it, and
    apply(state, effect) gives the state after all its rows. Rows of one series have distinct values of
    `order`, or the order of equal ones goes by the other columns. Without `spread` the blocks are counts of
    rows and the series of a key stays in one task, on the exchange by the keys that may be there already.
    `spread` is a column that does not fall along the order, such as a number of days divided by the days of
    a block: its values are the blocks, and they are dealt to tasks one by one.
    """
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys and c != order]
    if spread is None:
        count = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        rows = rows.withColumn("_block", F.floor((count - 1) / BLOCK))
    else:
        rows = rows.withColumn("_block", spread)
    packed = rows.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct(order, *others))).alias("_rows"))
    effects = packed.withColumn("_effect", F.aggregate("_rows", effect, absorb))
    if spread is None:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        packed = effects.withColumn("_start", F.aggregate(F.collect_list("_effect").over(before), start, apply))
    else:
        # effects alone come together by series, and the states at the blocks' beginnings go back to the blocks
        own = effects.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_effect"))).alias("_b"))
        states = F.aggregate("_b", F.array(start), lambda a, e: F.array_append(a, apply(F.element_at(a, -1), e["_effect"])))
        own = own.select(*keys, F.col("_b._block").alias("_block"), states.alias("_start"))
        own = own.select(*keys, "_block", F.slice("_start", 1, F.size("_block")).alias("_start"))
        own = own.select(*keys, F.explode(F.arrays_zip("_block", "_start")).alias("_z")).select(*keys, "_z._block", "_z._start")
        packed = packed.join(own, [*keys, "_block"])
    states = F.aggregate("_rows", F.array("_start"), lambda a, e: F.array_append(a, step(F.element_at(a, -1), e)))
    packed = packed.select(*keys, "_rows", states.alias("_states"))
    n = F.size("_rows")
    packed = packed.select(*keys, "_rows", F.slice("_states", 1, n).alias("_was"), F.slice("_states", 2, n).alias("_now"))
    out = packed.select(*keys, F.explode(F.arrays_zip("_rows", "_was", "_now")).alias("_z"))
    return out.select(*keys, *[F.col("_z._rows")[c].alias(c) for c in (order, *others)], F.col("_z._was").alias("was"), F.col("_z._now").alias("now"))


#: Beyond any number of shares: a bound that does not bind.
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62


def clamp_scan(rows: DataFrame, keys: Iterable[str], low: Column, high: Column, order: str = DATE, spread: Column | None = None) -> DataFrame:
    """The rows with `was` and `now`: a number that starts at 0 and on each row is moved into [low, high].

    Clamps compose: after [a, b], [c, d] is the clamp to a and b moved into [c, d]. NO_LOW and NO_HIGH stand for an open side.
    """

    def moved(x: Column, e: Column) -> Column:
        return F.least(F.greatest(x, e["low"]), e["high"])

    rows = rows.withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
    bounds = lambda e: F.struct(e["_low"].alias("low"), e["_high"].alias("high"))
    both = lambda f, e: F.struct(moved(f["low"], e).alias("low"), moved(f["high"], e).alias("high"))
    whole = F.struct(F.lit(NO_LOW).alias("low"), F.lit(NO_HIGH).alias("high"))
    out = block_scan(rows, keys, F.lit(0).cast("long"), lambda x, e: moved(x, bounds(e)), whole, lambda f, e: both(f, bounds(e)), moved, order, spread)
    return out.drop("_low", "_high")


def decayed_means(rows: DataFrame, specs: Iterable[tuple[str, str, float]], keys: Iterable[str], order: str = DATE, spread: Column | None = None) -> DataFrame:
    """Adds the exponentially weighted means (input, output, alpha).

    State and effect of a series are a decayed sum, the decayed count of values and, for an effect, the decay of its
    rows. A null gives null and keeps its place; NaN makes all later means NaN.
    """
    specs = list(specs)
    zero = F.struct(*[F.lit(0.0).alias(f"{p}{i}") for i in range(len(specs)) for p in "sw"])
    none = F.struct(*[F.lit(x).alias(f"{p}{i}") for i in range(len(specs)) for p, x in (("s", 0.0), ("w", 0.0), ("d", 1.0))])

    def added(f: Column, e: Column) -> list[Column]:
        out = []
        for i, (name, _, alpha) in enumerate(specs):
            x, g = e[name].cast("double"), F.lit(1.0 - alpha)
            out.append((f[f"s{i}"] * g + F.coalesce(x, F.lit(0.0))).alias(f"s{i}"))
            out.append((f[f"w{i}"] * g + F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(1.0))).alias(f"w{i}"))
        return out

    def decays(f: Column) -> list[Column]:
        return [(f[f"d{i}"] * F.lit(1.0 - alpha)).alias(f"d{i}") for i, (_, _, alpha) in enumerate(specs)]

    def carried(s: Column, f: Column) -> Column:
        return F.struct(*[(s[f"{p}{i}"] * f[f"d{i}"] + f[f"{p}{i}"]).alias(f"{p}{i}") for i in range(len(specs)) for p in "sw"])

    def absorbed(f: Column, e: Column) -> Column:
        own, last = added(f, e), decays(f)
        return F.struct(*[c for i in range(len(specs)) for c in (own[2 * i], own[2 * i + 1], last[i])])

    names = rows.columns
    out = block_scan(rows, keys, zero, lambda s, e: F.struct(*added(s, e)), none, absorbed, carried, order, spread)
    means = [F.when(F.col(name).isNotNull(), F.try_divide(F.col(f"now.s{i}"), F.col(f"now.w{i}"))).alias(made) for i, (name, made, _) in enumerate(specs)]
    return out.select(*names, *means)
