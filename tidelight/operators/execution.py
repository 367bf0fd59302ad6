"""Fills, settlement and implementation shortfall of orders on binary outcomes, as projections and conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side_value(side: Column, up: Column) -> Column:
    """What a share of a side is worth where a share of Up is worth ``up``."""
    return F.when(side == "up", up).otherwise(1 - up)


def token_mid(quotes: DataFrame, asks: DataFrame, group: str, second: str, side: str, last: int) -> DataFrame:
    """``asks`` (``group, second, side``) with ``mid`` of the side's quotes at the second, held within the window, and whether they were ``crossed``."""
    at = F.least(F.greatest(F.col(second), F.lit(0)), F.lit(last))
    q = quotes.select(F.col(group), F.col(second).alias("_at"), "ask", "bid")
    hit = asks.withColumn("_at", at).join(q, [group, "_at"], "left").drop("_at")
    mid = side_value(F.col(side), (F.col("ask") + F.col("bid")) / 2)
    return hit.withColumn("mid", mid).withColumn("crossed", F.col("bid") > F.col("ask")).drop("ask", "bid")


def settle(fills: DataFrame, window: str, y: Column) -> DataFrame:
    """One row for each window: shares by side, cost, fees, payoff and profit, and the parts of what execution cost.

    ``fills``: ``side, shares, price, fee, quote, mid, maker``; parts of fills without a quote or mid add nothing.
    """
    q = F.col("shares")
    held = lambda s: F.sum(F.when(F.col("side") == s, q).otherwise(0.0))
    rows = fills.withColumn("_y", y)
    out = rows.groupBy(window).agg(
        held("up").alias("up"), held("down").alias("down"), F.sum(q * F.col("price")).alias("cost"), F.sum("fee").alias("fees"),
        F.sum(q * side_value(F.col("side"), F.col("_y"))).alias("payoff"), F.count(F.lit(1)).alias("n_fills"), F.sum(F.col("maker").cast("int")).alias("maker_fills"),
        F.coalesce(F.sum((F.col("quote") - F.col("mid")) * q), F.lit(0.0)).alias("half_spread"), F.coalesce(F.sum((F.col("price") - F.col("quote")) * q), F.lit(0.0)).alias("slippage"),
    )
    return out.withColumn("pnl", F.col("payoff") - F.col("cost") - F.col("fees"))


def order_costs(orders: DataFrame) -> DataFrame:
    """Orders (``dollars, cost, fill_ratio, price, mid, fee, payoff``) with shares, profit, and the parts of the shortfall against the decision's mid."""
    ordered = F.col("dollars") / F.col("cost")
    o = orders.withColumn("ordered", ordered).withColumn("filled", F.col("ordered") * F.col("fill_ratio"))
    edge = F.col("payoff") - F.col("mid")
    o = o.withColumn("pnl", F.col("filled") * (F.col("payoff") - F.col("cost"))).withColumn("paper", F.col("ordered") * edge)
    o = o.withColumn("arrival_cost", F.col("filled") * (F.col("price") - F.col("mid"))).withColumn("fees", F.col("filled") * F.col("fee"))
    o = o.withColumn("opportunity_cost", (F.col("ordered") - F.col("filled")) * edge)
    return o.withColumn("shortfall", F.col("arrival_cost") + F.col("fees") + F.col("opportunity_cost"))


def shortfall(costs: DataFrame, group: str) -> DataFrame:
    """Sums over orders that had a mid, and costs by turnover; ``costs``: see :func:`order_costs`."""
    known = costs.filter("mid is not null")
    parts = ["paper", "arrival_cost", "fees", "opportunity_cost", "shortfall", "pnl"]
    s = known.groupBy(group).agg(F.count(F.lit(1)).alias("orders"), *[F.sum(c).alias(c) for c in parts], F.sum(F.col("filled") * F.col("price")).alias("turnover"))
    by = lambda c: F.try_divide(F.col(c), F.col("turnover"))
    out = s.withColumn("fees_per_turnover", by("fees")).withColumn("slippage_per_turnover", by("arrival_cost")).withColumn("pnl_per_turnover", by("pnl"))
    return out.withColumn("return_on_costs", F.try_divide(F.col("pnl"), F.col("arrival_cost") + F.col("fees")))


def maker_spread(fills: DataFrame, window: str, y: Column) -> DataFrame:
    """What resting orders earned: the effective spread at the fill, and how the mid moved later and until settlement. Fills at crossed quotes stay out."""
    m = fills.withColumn("_y", side_value(F.col("side"), y)).filter("maker and mid_fill is not null and not crossed_fill")
    q, mid = F.col("shares"), F.col("mid_fill")
    return m.groupBy(window).agg(
        F.sum(q * (mid - F.col("price"))).alias("effective_spread"), F.coalesce(F.sum(q * (F.col("mid_later") - mid)), F.lit(0.0)).alias("markout"),
        F.sum(q * (F.col("_y") - mid)).alias("settled"), F.sum(q).alias("spread_shares"),
    )


def report(results: DataFrame, group: str, order: list[str], bankroll: float, ruin: float) -> DataFrame:
    """Totals of each group's windows (``pnl, fees, cost, n_fills``), the deepest drawdown of its equity from ``bankroll``, and whether it ended ruined."""
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = results.withColumn("_equity", bankroll + F.sum("pnl").over(run)).withColumn("_high", F.greatest(F.lit(bankroll), F.max("_equity").over(run)))
    out = e.groupBy(group).agg(
        F.count(F.lit(1)).alias("traded"), F.sum("pnl").alias("pnl"), F.sum("fees").alias("fees"), F.sum("cost").alias("turnover"), F.sum("n_fills").alias("fills"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.max(1 - F.col("_equity") / F.col("_high")).alias("max_drawdown"),
    )
    return out.withColumn("ruined", bankroll + F.col("pnl") < ruin * bankroll).withColumn("return", F.col("pnl") / bankroll)


def time_weighted_return(df: DataFrame, group: str, order: list[str], pnl: str, bankroll: float, years: float) -> DataFrame:
    """``twrr``: the yearly growth of an account; -1 once it is lost.

    Each period grows what the last left, so the product of growth is the last equity over the first. Profits given as
    decimals are summed exactly, so that an account that comes to nothing is lost.
    """
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("_equity", bankroll + F.sum(pnl).over(run))
    out = e.groupBy(group).agg(F.min("_equity").alias("_low"), (F.sum(pnl) / bankroll + 1).alias("_growth"))
    return out.select(group, F.when(F.col("_low") <= 0, -1.0).otherwise(F.pow(F.greatest("_growth", F.lit(0.0)), F.lit(1 / years)) - 1).alias("twrr"))


def first_barrier(events: DataFrame, path: DataFrame, group: str, t: str, price: str, target: str, path_t: str, path_price: str, up: float, down: float, horizon: int, least: float = 0.0) -> DataFrame:
    """``t1``: the earliest of the two barriers (multiples of each event's ``target``) and the horizon's end; events whose target isn't above ``least`` go."""
    from tidelight.operators.asof import range_join

    keys = events.columns
    points = path.select(F.col(group), F.col(path_t).alias("_pt"), F.col(path_price).alias("_pp"))
    kept = events.filter(F.col(target) > least)
    pairs = range_join(kept, points, group, F.col(t) + 1, F.col(t) + horizon, "_pt", horizon)
    r = F.try_divide(F.col("_pp"), F.col(price)) - 1
    hit = pairs.groupBy(*keys).agg(F.min(F.when(r > up * F.col(target), F.col("_pt"))).alias("pt"), F.min(F.when(r < -down * F.col(target), F.col("_pt"))).alias("sl"))
    out = kept.join(hit, keys, "left")
    return out.withColumn("t1", F.least(F.col(t) + horizon, F.col("pt"), F.col("sl")))
