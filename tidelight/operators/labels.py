"""Labels of events on a price path: barriers, bins, horizons and the CUSUM filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelight.operators.asof import asof_join, range_join
from tidelight.operators.folds import folded


def cusum_flags(returns: list[float | None], h: float) -> list[int]:
    """+1 or -1 where the upper or lower cumulative sum passes ``h`` and is reset, else 0; the lower is looked at first."""
    up = down = 0.0
    out = []
    for r in returns:
        flag = 0
        if r is not None:
            up, down = max(0.0, up + r), min(0.0, down + r)
            if down < -h:
                down, flag = 0.0, -1
            elif up > h:
                up, flag = 0.0, 1
        out.append(flag)
    return out


def cusum_filter(df: DataFrame, group: str, order: list[str], ret: str, h: float) -> DataFrame:
    """``df`` with ``flag``: the fold of :func:`cusum_flags` over each group's ordered returns; a null return changes nothing."""
    return folded(df, group, order, ret, "flag", "int", lambda r: cusum_flags(r, h))


def vertical_barrier(events: DataFrame, path: DataFrame, group: str, t: str, path_t: str, horizon: int) -> DataFrame:
    """Events with ``t1``: the first path time at or after ``t + horizon``."""
    due = events.withColumn("_due", F.col(t) + horizon)
    hit = asof_join(due, path.select(group, path_t), group, "_due", path_t, [], "forward")
    return hit.withColumnRenamed("matched_time", "t1").drop("_due")


def triple_barrier(events: DataFrame, path: DataFrame, group: str, t: str, price: str, path_t: str, path_price: str, up: float, down: float, horizon: int) -> DataFrame:
    """Events with ``touch`` (time), ``side`` (1, -1, 0 at the horizon) and ``ret``.

    The first path point within the horizon whose return leaves ``(-down, up)``
    decides; the equi-join is on time buckets of the horizon's width. From a price
    of 0 no return is defined: the event runs to its horizon with a null ``ret``.
    """
    points = path.select(F.col(group), F.col(path_t).alias("_pt"), F.col(path_price).alias("_pp"))
    pairs = range_join(events, points, group, F.col(t) + 1, F.col(t) + horizon, "_pt", horizon)
    r = F.try_divide(F.col("_pp"), F.col(price)) - 1
    first = lambda cond: F.min(F.when(cond, F.struct("_pt", r.alias("r"))))
    keys = events.columns
    got = pairs.groupBy(*keys).agg(first(r >= up).alias("_u"), first(r <= -down).alias("_d"), F.max(F.struct("_pt", r.alias("r"))).alias("_l"))
    u, d = F.col("_u._pt"), F.col("_d._pt")
    is_up, is_down = u.isNotNull() & (d.isNull() | (u < d)), d.isNotNull() & (u.isNull() | (d < u))
    pick = F.when(is_up, F.col("_u")).when(is_down, F.col("_d")).otherwise(F.col("_l"))
    return got.select(*keys, pick["_pt"].alias("touch"), F.when(is_up, 1).when(is_down, -1).otherwise(0).alias("side"), pick["r"].alias("ret"))


def fixed_horizon(path: DataFrame, group: str, order: list[str], price: str, steps: int) -> DataFrame:
    """Rows with ``end`` (the later price ``steps`` on, or the last), ``ret`` from the row before, and its ``label``."""
    w = Window.partitionBy(group).orderBy(*order)
    last = F.last(price).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ref, end = F.lag(price).over(w), F.coalesce(F.lead(price, steps - 1).over(w), last)
    return path.withColumn("ret", end - ref).withColumn("label", F.signum("ret"))
