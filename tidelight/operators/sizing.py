"""Sequential sizing and simulation: exponentially weighted moments, held positions, fills, trading rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from tidelight.operators.folds import folded


def ewma(df: DataFrame, group: str, order: list[str], value: str, half_life: float, name: str = "ewma") -> DataFrame:
    """Exponentially weighted mean with the weights of all past rows, as one ordered fold of a bounded series."""
    keep = 0.5 ** (1 / half_life)

    def means(x: list) -> list:
        total, weight, out = 0.0, 0.0, []
        for v in x:
            total, weight = total * keep + v, weight * keep + 1
            out.append(total / weight)
        return out

    return folded(df, group, order, value, name, "double", means)


def hold_to_expiry(size: np.ndarray, side: np.ndarray, flat_grows: bool = True) -> np.ndarray:
    """Stake added at each bet when the position only grows toward the running mean of signed sizes.

    Without ``flat_grows`` a series whose first bet is nothing stays flat, as no target has that side.
    """
    held, total, out = 0.0, 0.0, np.zeros(len(size))
    if not flat_grows and len(size) and size[0] * np.sign(side[0]) == 0:
        return out
    for i, x in enumerate(size * np.sign(side)):
        total += x
        target = total / (i + 1)
        if (held == 0 or (target > 0) == (held > 0)) and abs(target) > abs(held):
            out[i] = abs(target) - abs(held)
            held = target
    return out


def fill_orders(prices: np.ndarray, sizes: np.ndarray, limit: float, wanted: float, share: float) -> np.ndarray:
    """What an order takes of each print at or under its limit, at most a share of it, until it is filled."""
    room = np.where(prices <= limit, sizes * share, 0.0)
    before = np.r_[0.0, np.cumsum(room)[:-1]]
    return np.clip(wanted - before, 0.0, room)


def trading_rule_mesh(forecast: float, phi: float, sigma: float, takes: list[float], stops: list[float], paths: int, steps: int, seed: int) -> dict[str, list]:
    """Sharpe ratio of each (profit take, stop) pair over simulated mean-reverting paths."""
    rng = np.random.default_rng(seed)
    p = np.zeros(paths)
    gains = np.empty((steps, paths))
    for k in range(steps):
        p = (1 - phi) * forecast + phi * p + sigma * rng.standard_normal(paths)
        gains[k] = p
    out: dict[str, list] = {"take": [], "stop": [], "sharpe": []}
    for take in takes:
        for stop in stops:
            hit = (gains >= take) | (gains <= -stop)
            first = np.where(hit.any(0), hit.argmax(0), steps - 1)
            g = gains[first, np.arange(paths)]
            sd = g.std(ddof=1)
            for k, v in zip(out, (take, stop, float(g.mean() / sd) if sd > 0 else math.nan), strict=True):
                out[k].append(v)
    return out


def integer_partitions(k: int, n: int) -> list[tuple[int, ...]]:
    """Ways to write ``k`` as ``n`` ordered non-negative parts."""
    if n == 1:
        return [(k,)]
    return [(i, *rest) for i in range(k + 1) for rest in integer_partitions(k - i, n - 1)]
