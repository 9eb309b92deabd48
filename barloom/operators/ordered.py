"""Rolling order statistics of long windows: medians, quantiles, ranks and places of extremes.

The column operators of barloom.operators.timeseries gather and sort each row's window; their cost grows with it. Here a
window is kept in order while one value enters and one leaves, so a row costs about the same for 20 and for 2,500
rows. Series are cut into blocks of rows that bring the rows before them along: a block is a task's unit of work,
memory is bounded by it, and one long series is spread over many tasks. Results are those of the column operators.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.numeric import fdiv
from barloom.operators.timeseries import DATE, INSTRUMENT, MAD_SCALE

#: Rows of a block, or as many as the longest window.
BLOCK = 8192
KINDS = ("median", "quantile", "rank", "argmax", "argmin")


@dataclass(frozen=True)
class Order:
    """One rolling statistic: its kind, the column it reads, its name, the rows of its window, and the share of a quantile."""

    kind: str
    column: str
    name: str
    n: int
    q: float = 0.5

    def __post_init__(self):
        if self.kind not in KINDS or self.n < 1:
            raise ValueError(f"no such statistic: {self}")


def sorted_windows(x: list[float | None], n: int) -> Iterator[tuple[list[float], int]]:
    """For each place the values of its window in order without NaN, and the number of NaN; the list is one and the same. Nulls are in neither."""
    order: list[float] = []
    nans = 0
    for i, v in enumerate(x):
        if v is not None:
            if v != v:
                nans += 1
            else:
                insort(order, v)
        if i >= n and (old := x[i - n]) is not None:
            if old != old:
                nans -= 1
            else:
                del order[bisect_left(order, old)]
        yield order, nans


def _at(order: list[float], k: int) -> float:
    """The k-th value, NaN behind all numbers."""
    return order[k] if k < len(order) else math.nan


def ranked_values(x: list[float | None], spec: Order) -> list[float | None]:
    """median, quantile or rank of the last n rows at each row; null unless all n are there."""
    n, out = spec.n, []
    near = round((n - 1) * spec.q)
    low, high = (n - 1) // 2, n // 2
    for v, (order, nans) in zip(x, sorted_windows(x, n)):
        if len(order) + nans < n:
            out.append(None)
        elif spec.kind == "median":
            a, b = _at(order, low), _at(order, high)
            out.append(a if low == high else (a + b) / 2)
        elif spec.kind == "quantile":
            out.append(_at(order, near))
        else:
            out.append(math.nan if v != v else bisect_right(order, v) / n)
    return out


def extreme_places(x: list[float | None], spec: Order) -> list[float | None]:
    """Place of the first greatest or least value of the last n rows; NaN is the greatest for argmax, and goes first for argmin."""
    n, out = spec.n, []
    sign = -1.0 if spec.kind == "argmax" else 1.0
    waiting: deque[tuple[tuple[int, float], int]] = deque()
    have = 0
    for i, v in enumerate(x):
        have += v is not None
        if i >= n:
            have -= x[i - n] is not None
        if v is not None:
            key = (0, 0.0) if v != v else (1, sign * v)
            # what comes first stays where keys are equal
            while waiting and waiting[-1][0] > key:
                waiting.pop()
            waiting.append((key, i))
        while waiting and waiting[0][1] <= i - n:
            waiting.popleft()
        out.append(float(waiting[0][1] - (i - n + 1)) if have == n else None)
    return out


def rolling_order(df: DataFrame, specs: Iterable[Order], key: str = INSTRUMENT, date: str = DATE) -> DataFrame:
    """Adds the statistics as doubles. Rows of equal dates within a key are taken in any order, as windows take them."""
    specs = list(specs)
    reach = max((s.n for s in specs), default=1) - 1
    size = max(BLOCK, reach)
    rows = df.withColumn("_i", (F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1).cast("long"))
    own = F.floor(F.col("_i") / size)
    # the last rows of a block go with the next one too
    blocks = F.when(F.col("_i") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_b", F.explode(blocks))
    names = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_i")
        first = np.asarray(group.column("_i")) // size == group.column("_b")[0].as_py()
        cached: dict[str, list[float | None]] = {}
        made = []
        for s in specs:
            x = cached.setdefault(s.column, group.column(s.column).cast(pa.float64()).to_pylist())
            made.append((extreme_places if s.kind.startswith("arg") else ranked_values)(x, s))
        out = group.select(names)
        for s, v in zip(specs, made):
            out = out.append_column(s.name, pa.array(v, pa.float64(), from_pandas=False))
        return out.filter(pa.array(first))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{s.name}` double" for s in specs]
    # dealt anew: the count of rows has brought each series together in one task
    return rows.repartition(key, "_b").groupBy(key, "_b").applyInArrow(run, ", ".join(fields))


def robust_zscore(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """Adds what ts_robust_zscore gives, for long windows: two passes, since a deviation is from its own row's median."""
    df = rolling_order(df, [Order("median", column, "_median", n)])
    df = df.withColumn("_off", F.col(column) - F.col("_median")).withColumn("_size", F.abs("_off"))
    df = rolling_order(df, [Order("median", "_size", "_mad", n)])
    value: Column = fdiv("_off", F.lit(MAD_SCALE) * F.col("_mad"))
    return df.withColumn(name, value).drop("_median", "_off", "_size", "_mad")
