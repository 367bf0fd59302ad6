"""Fair price of a binary on an averaged price: inputs second by second, the streaming form, and its fit."""

from __future__ import annotations

import math
from collections import OrderedDict
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelight.functions.maths import bound, norm_cdf
from tidelight.functions.pricing import variance_of_left
from tidelight.operators.sizing import ewma


def window_inputs(closes: DataFrame, windows: DataFrame, group: str, lag: int, half_life: float, length: int = 300, lookback: int = 60) -> DataFrame:
    """``group, start, t, m, sigma_raw, units`` of every second ``t`` of every window.

    ``closes``: ``group, sec, close``, the close of the second that begins at ``sec``, gaps
    allowed; the price at an instant is the close of the second before. ``m`` is the
    expected settling average less the opening one, in logs; the opening average needs
    every one of its closes (else null). A group is one bounded series.
    """
    span = closes.groupBy(group).agg(F.min("sec").alias("_a"), F.max("sec").alias("_z"))
    grid = span.select(group, F.explode(F.sequence("_a", "_z")).alias("sec"))
    w = Window.partitionBy(group).orderBy("sec")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(closes.select(group, "sec", "close"), [group, "sec"], "left").withColumn("x", F.ln(F.last("close", ignorenulls=True).over(run)))
    filled = filled.withColumn("r", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))).withColumn("r2", F.col("r") * F.col("r"))
    path = ewma(filled.select(group, "sec", "x", "r2"), group, ["sec"], "r2", half_life, "var").withColumn("sum_x", F.sum("x").over(run))
    path = path.select(group, (F.col("sec") + 1).alias("at"), "x", "var", "sum_x")

    end = length - lag
    opening = windows.select(group, "start", F.explode(F.sequence(F.col("start") - lookback - lag, F.col("start") - lag - 1)).alias("sec")).join(closes, [group, "sec"])
    k = opening.groupBy(group, "start").agg(F.when(F.count("close") == lookback, F.ln(F.avg("close"))).alias("k"))
    seconds = windows.select(group, "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("t"))
    now = seconds.withColumn("at", F.col("start") + F.col("t")).join(path.select(group, "at", "x", "var"), [group, "at"]).drop("at")
    upto = path.select(F.col(group), F.col("at").alias("_i"), F.col("sum_x").alias("_hi"))
    since = path.select(F.col(group), F.col("at").alias("_j"), F.col("sum_x").alias("_lo"))
    now = now.withColumn("_i", F.col("start") + F.least(F.col("t"), F.lit(end))).withColumn("_j", F.col("start") + end - lookback)
    now = now.join(upto, [group, "_i"], "left").join(since, [group, "_j"], "left")
    inside = F.when(F.col("_i") > F.col("_j"), F.col("_hi") - F.coalesce(F.col("_lo"), F.lit(0.0))).otherwise(0.0)
    tau = (end - F.col("t")).cast("double")
    mean = F.when(tau >= lookback, F.col("x")).when(tau > 0, (inside + tau * F.col("x")) / lookback).otherwise(inside / lookback)
    out = now.join(k, [group, "start"], "left").withColumn("units", variance_of_left(tau, lookback))
    return out.select(group, "start", "t", (mean - F.col("k")).alias("m"), F.sqrt("var").alias("sigma_raw"), "units")


def fair_prices(inputs: DataFrame, multiple: float, basis: float, floor: float) -> DataFrame:
    """``inputs`` with ``fair``: the chance that the average settles at or over its start; null where the start is not known."""
    sigma = F.greatest(F.col("sigma_raw") * multiple, F.lit(floor))
    sd = F.sqrt(sigma * sigma * F.col("units") + basis**2)
    certain = F.when(F.col("m") >= 0, 1.0).otherwise(0.0)
    return inputs.withColumn("fair", F.when(F.col("m").isNull(), None).when(sd > 0, bound(F.try_divide(F.col("m"), sd), norm_cdf)).otherwise(certain))


def fit_fair(samples: DataFrame, floor: float, rounds: int = 6, points: int = 7) -> dict[str, float]:
    """``multiple, basis, log_loss`` of greatest likelihood; ``samples``: ``m, sigma_raw, units, y``.

    A grid of parameters is scored in one pass over the rows, then a finer one around
    the best, and so on; only the scores come to the driver.
    """
    centre, width = [0.0, math.log(2e-5)], [2.0, 4.0]
    best: dict[str, float] = {}
    rows = samples.filter("m is not null and y is not null").select("m", "sigma_raw", "units", F.col("y").cast("double").alias("y"))
    for _ in range(rounds):
        step = [2 * w / (points - 1) for w in width]
        grid = [(centre[0] - width[0] + i * step[0], centre[1] - width[1] + j * step[1]) for i in range(points) for j in range(points)]
        each = rows.withColumn("g", F.explode(F.array(*[F.struct(F.lit(math.exp(a)).alias("multiple"), F.lit(math.exp(b)).alias("basis")) for a, b in grid])))
        sigma = F.greatest(F.col("sigma_raw") * F.col("g.multiple"), F.lit(floor))
        z = F.col("m") / F.sqrt(sigma * sigma * F.col("units") + F.col("g.basis") * F.col("g.basis"))
        p = each.select("g", "y", F.least(F.greatest(bound(z, norm_cdf), F.lit(1e-9)), F.lit(1 - 1e-9)).alias("p"))
        loss = F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p"))))
        top = p.groupBy("g").agg(loss.alias("loss")).orderBy("loss", "g").first()
        best = {"multiple": top["g"]["multiple"], "basis": top["g"]["basis"], "log_loss": top["loss"]}
        centre, width = [math.log(best["multiple"]), math.log(best["basis"])], [s * 1.25 for s in step]
    return best


class FairStream:
    """The same price fed one second at a time; any number of windows, each with its own lookback, can be watched.

    Watch a window its lookback and the lag before its start, or its opening average can't be formed.
    """

    def __init__(self, half_life: float, multiple: float, basis: float, lag: int, floor: float, length: int = 300):
        self.keep, self.multiple, self.basis, self.lag, self.floor, self.length = 0.5 ** (1 / half_life), multiple, basis, lag, floor, length
        self.total = self.weight = 0.0
        self.at: int | None = None
        self.x = math.nan
        self.recent: OrderedDict[int, float] = OrderedDict()
        self.watched: dict[int, dict] = {}

    def watch(self, start: int, lookback: int = 60) -> None:
        self.watched.setdefault(start, {"n": lookback, "k": None, "inside": 0.0})

    def forget(self, start: int) -> None:
        self.watched.pop(start, None)

    def feed(self, instant: int, price: float) -> None:
        """The price at an instant; instants come one second after another."""
        x = math.log(price)
        change = 0.0 if self.at is None else x - self.x
        self.total, self.weight = self.total * self.keep + change * change, self.weight * self.keep + 1.0
        self.at, self.x = instant, x
        self.recent[instant] = price
        while len(self.recent) > max((w["n"] for w in self.watched.values()), default=60) + self.lag + 4:
            self.recent.popitem(last=False)
        for start, w in self.watched.items():
            opened = start - self.lag
            if w["k"] is None and instant >= opened:
                prices = [self.recent[i] for i in range(opened - w["n"] + 1, opened + 1) if i in self.recent]
                w["k"] = math.log(sum(prices) / w["n"]) if len(prices) == w["n"] else math.nan
            end = start + self.length - self.lag
            if end - w["n"] < instant <= end:
                w["inside"] += x

    def fair(self, start: int) -> float:
        w = self.watched[start]
        if w["k"] is None or self.at is None or math.isnan(w["k"]):
            return math.nan
        n, tau = w["n"], self.length - self.lag - (self.at - start)
        mean = self.x if tau >= n else (w["inside"] + max(tau, 0) * self.x) / n
        units = tau - n + (n + 1) * (2 * n + 1) / (6 * n) if tau >= n else max(tau, 0) * (tau + 1) * (2 * tau + 1) / (6 * n * n)
        sigma = max(math.sqrt(self.total / self.weight) * self.multiple, self.floor)
        sd = math.sqrt(sigma * sigma * units + self.basis**2)
        return NormalDist().cdf((mean - w["k"]) / sd) if sd > 0 else float(mean >= w["k"])
