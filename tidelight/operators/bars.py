"""Event bars: trades of a group cut into bars by time, count, size, imbalance or runs.

Bars that a counter or clock closes are window expressions. Bars whose
accumulator resets with its overshoot dropped, or whose threshold learns, are
sequential by nature; one fold assigns their bar numbers group by group, and the
bars themselves are again plain aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(tape: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The tape with ``rn``: the trade's place in its group."""
    return tape.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def summarise(tape: DataFrame, keys: list[str], price: str = "price", size: str = "size", sign: str = "sign", rn: str = "rn") -> DataFrame:
    """One row for each bar: prices, volume-weighted price, counts and imbalances."""
    p, q, b = F.col(price), F.col(size), F.col(sign)
    total = F.sum(q)
    return tape.groupBy(*keys).agg(
        F.min_by(p, rn).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, rn).alias("close"),
        F.coalesce(F.try_divide(F.sum(p * q), total), F.max_by(p, rn)).alias("vwap"),
        F.count(F.lit(1)).alias("n_ticks"),
        total.alias("volume"),
        F.sum(F.when(b > 0, q).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(b > 0, 0.0).otherwise(q)).alias("sell_volume"),
        F.sum(b).alias("tick_imbalance"),
        F.sum(b * q).alias("volume_imbalance"),
    )


def tick_bars(tape: DataFrame, group: str, order: list[str], n: int, **cols: str) -> DataFrame:
    """A bar for every ``n`` trades; trades left over at the end make none."""
    dealt = numbered(tape, group, order).withColumn("bar", F.floor((F.col("rn") - 1) / n))
    return summarise(dealt, [group, "bar"], **cols).filter(F.col("n_ticks") == n)


def time_bars(tape: DataFrame, group: str, ts: str, order: list[str], seconds: int, **cols: str) -> DataFrame:
    """A bar for every clock interval with a trade."""
    dealt = numbered(tape, group, order).withColumn("bar", F.floor(F.col(ts) / seconds))
    return summarise(dealt, [group, "bar"], **cols)


@dataclass(frozen=True)
class Size:
    """Close once the flow reaches ``size``; what goes over is dropped.

    With ``bars_per_window`` the size follows an average of the flow of past windows.
    """

    size: float
    bars_per_window: float | None = None
    span_windows: float = 12.0

    def assign(self, v: np.ndarray, b: np.ndarray, window: np.ndarray) -> np.ndarray:
        bars, bar, held, size, seen = np.zeros(len(v), np.int64), 0, 0.0, self.size, 0.0
        flow, rate = size * (self.bars_per_window or 0.0), 2 / (self.span_windows + 1)
        for i in range(len(v)):
            if i and window[i] != window[i - 1]:
                if self.bars_per_window:
                    flow += rate * (seen - flow)
                    size, seen = max(flow / self.bars_per_window, 1e-9), 0.0
                bar, held = bar + (held > 0), 0.0
            bars[i] = bar
            held += v[i]
            seen += v[i]
            if held >= size:
                bar, held = bar + 1, 0.0
        return bars


def expected_abs(mu: float, sd: float) -> float:
    """Mean absolute value of a normal variable."""
    if sd <= 0:
        return abs(mu)
    return sd * math.sqrt(2 / math.pi) * math.exp(-((mu / sd) ** 2) / 2) + mu * math.erf(mu / sd / math.sqrt(2))


@dataclass(frozen=True)
class Learning:
    """What imbalance and run bars share: an expected bar length that follows past bars within bounds."""

    length: float
    span_bars: float = 20.0
    clip: float = 4.0
    scale: float = 1.0

    def next_length(self, expected: float, n: int) -> float:
        moved = expected + 2 / (self.span_bars + 1) * (n - expected)
        return min(max(moved, self.length / self.clip), self.length * self.clip)


def states(x: np.ndarray, start: float, rate: float, on: np.ndarray | None = None) -> np.ndarray:
    """An exponential average before each value and after the last; where ``on`` is False a value passes it by."""
    steps = zip(x.tolist(), (on if on is not None else np.ones(len(x), bool)).tolist(), strict=True)
    return np.fromiter(accumulate(steps, lambda m, v: m + rate * (v[0] - m) if v[1] else m, initial=start), float, len(x) + 1)


def closes(flow: list[np.ndarray], expected: Callable[[int, float], float], next_length: Callable[[float, int], float], length: float) -> np.ndarray:
    """Bar numbers where a bar closes once any of the flows summed from its first trade is as large as expected there.

    The sums come from prefix sums, searched in growing stretches; ``expected(first trade, length)``.
    """
    n = len(flow[0])
    sums = [np.r_[0.0, np.cumsum(x)] for x in flow]
    bars, bar, at = np.zeros(n, np.int64), 0, 0
    while at < n:
        limit, lo, width, end = expected(at, length), at, max(16, int(2 * length)), n
        while lo < n:
            hi = min(n, lo + width)
            reached = np.max([np.abs(c[lo + 1 : hi + 1] - c[at]) for c in sums], axis=0) >= limit
            if reached.any():
                end = lo + int(reached.argmax()) + 1
                break
            lo, width = hi, 2 * width
        bars[at:end] = bar
        length, bar, at = next_length(length, end - at), bar + 1, end
    return bars


@dataclass(frozen=True)
class Imbalance(Learning):
    """Close once the signed flow is as one-sided as expected of a bar, by averages frozen at its first trade."""

    mean: float = 0.0
    sd: float = 1.0

    def assign(self, v: np.ndarray, b: np.ndarray, window: np.ndarray) -> np.ndarray:
        x, rate = v * b, 2 / (10 * self.length + 1)
        mean, square = states(x, self.mean, rate), states(x * x, self.sd**2 + self.mean**2, rate)
        spread = np.sqrt(np.maximum(square - mean * mean, 0.0))
        expected = lambda at, length: self.scale * max(length * abs(mean[at]), spread[at] * math.sqrt(length))
        return closes([x], expected, self.next_length, self.length)


@dataclass(frozen=True)
class Run(Learning):
    """Close once one side's flow is as large as the greater side is expected to be."""

    p_buy: float = 0.5
    v_buy: float = 1.0
    v_sell: float = 1.0
    v2: float = 1.0

    def assign(self, v: np.ndarray, b: np.ndarray, window: np.ndarray) -> np.ndarray:
        rate, bought = 2 / (10 * self.length + 1), b > 0
        share, square = states(bought.astype(float), self.p_buy, rate), states(v * v, self.v2, rate)
        buys, sells = share * states(v, self.v_buy, rate, bought), (1 - share) * states(v, self.v_sell, rate, ~bought)
        spread = np.sqrt(np.maximum(square - (buys - sells) ** 2, 0.0))

        def expected(at: int, length: float) -> float:
            gap = expected_abs(length * (buys[at] - sells[at]), math.sqrt(length) * spread[at])
            return self.scale * (length * (buys[at] + sells[at]) + gap) / 2

        return closes([np.where(bought, v, 0.0), np.where(bought, 0.0, v)], expected, self.next_length, self.length)


def assign_bars(tape: DataFrame, group: str, order: list[str], rule: Size | Imbalance | Run, flow: Column, sign: str = "sign", window: str | None = None) -> DataFrame:
    """The tape with ``rn`` and ``bar`` by a sequential rule. A group's trades meet in one task, so a group should be bounded (a series, or a series and day)."""
    rows = numbered(tape, group, order).withColumn("_flow", flow.cast("double")).withColumn("_window", F.col(window) if window else F.lit(0))

    def run(table):
        table = table.sort_by("rn")
        v, b, w = (table.column(c).to_numpy() for c in ("_flow", sign, "_window"))
        return table.append_column("bar", pa.array(rule.assign(v, b, w)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(group).applyInArrow(run, f"{fields}, bar long").drop("_flow", "_window")


def closed(bars: DataFrame, group: str) -> DataFrame:
    """Without each group's last bar, which may not have been closed."""
    last = F.max("bar").over(Window.partitionBy(group))
    return bars.withColumn("_last", last).filter("bar < _last").drop("_last")


def tick_rule(tape: DataFrame, group: str, order: list[str], price: str = "price", initial: int = 1) -> DataFrame:
    """The tape with ``inferred``: the sign of the last price change, carried over unchanged prices."""
    w = Window.partitionBy(group).orderBy(*order)
    moved = F.signum(F.col(price) - F.lag(price).over(w))
    known = F.last(F.when(moved != 0, moved), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tape.withColumn("inferred", F.coalesce(known, F.lit(float(initial))).cast("int"))


def calibration(tape: DataFrame, group: str, flow: Column, sign: str = "sign") -> DataFrame:
    """Moments that size bars: mean flow of a group, and of signed and one-sided flow."""
    b = F.col(sign)
    return tape.agg(
        F.count_distinct(group).alias("windows"),
        (F.count(F.lit(1)) / F.count_distinct(group)).alias("ticks"),
        (F.sum(flow) / F.count_distinct(group)).alias("per_window"),
        F.avg(b * flow).alias("bv_mean"),
        F.stddev_pop(b * flow).alias("bv_sd"),
        F.avg((b > 0).cast("double")).alias("p_buy"),
        F.avg(F.when(b > 0, flow)).alias("v_buy"),
        F.avg(F.when(b < 0, flow)).alias("v_sell"),
        F.avg(flow * flow).alias("v2"),
    )


def fit_scale(count_bars, target: float, lo: float = 0.05, hi: float = 20.0, steps: int = 14) -> float:
    """Bisection on the log of a scale until ``count_bars(scale)`` bars a window come to ``target``."""
    a, z = math.log(lo), math.log(hi)
    for _ in range(steps):
        mid = (a + z) / 2
        a, z = (mid, z) if count_bars(math.exp(mid)) > target else (a, mid)
    return math.exp((a + z) / 2)
