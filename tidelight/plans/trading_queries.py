"""Queries of execution, fair prices, tape features, strategies, simulated critical values and portfolios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.functions.maths import norm_cdf_sql
from tidelight.operators import execution as ex
from tidelight.operators import fair, montecarlo, portfolio, strategies
from tidelight.operators import sequences as sq
from tidelight.plans.evaluation_queries import rounded
from tidelight.plans.registry import query
from tidelight.plans.sequence_queries import daily, monthly
from tidelight.plans.stat_queries import RET_SQL, exact_returns, returns
from tidelight.sources.tables import EVENTS_SQL, events, read

FILLS_SQL = """fl AS (SELECT l_orderkey AS w, CASE WHEN l_returnflag = 'R' THEN 'down' ELSE 'up' END AS side, l_quantity AS shares, 0.2 + 5 * l_discount AS price, l_quantity * l_tax / 50 AS fee, 0.19 + 5 * l_discount AS quote, 0.18 + 5 * l_discount + l_tax / 10 AS mid,
    l_linestatus = 'F' AS maker, 0.2 + 5 * l_discount + l_tax / 20 AS mid_fill, 0.2 + 4 * l_discount + l_tax / 10 AS mid_later, l_linenumber = 7 AS crossed_fill, (l_orderkey % 2)::DOUBLE AS y FROM lineitem)"""


def fills(spark, sf):
    """Line items as fills of a window (the order): sides, prices, fees, quotes and mids."""
    li, d, tax = read(spark, sf, "lineitem"), F.col("l_discount"), F.col("l_tax")
    return li.select(
        F.col("l_orderkey").alias("w"), F.when(F.col("l_returnflag") == "R", "down").otherwise("up").alias("side"), F.col("l_quantity").alias("shares"), (0.2 + 5 * d).alias("price"), (F.col("l_quantity") * tax / 50).alias("fee"),
        (0.19 + 5 * d).alias("quote"), (0.18 + 5 * d + tax / 10).alias("mid"), (F.col("l_linestatus") == "F").alias("maker"), (0.2 + 5 * d + tax / 20).alias("mid_fill"), (0.2 + 4 * d + tax / 10).alias("mid_later"),
        (F.col("l_linenumber") == 7).alias("crossed_fill"), (F.col("l_orderkey") % 2).cast("double").alias("y"),
    )


SETTLED_SQL = f"""{FILLS_SQL}, se AS (SELECT w, sum(CASE WHEN side = 'up' THEN shares ELSE 0 END) AS up, sum(CASE WHEN side = 'down' THEN shares ELSE 0 END) AS down, sum(shares * price) AS cost, sum(fee) AS fees, sum(shares * CASE WHEN side = 'up' THEN y ELSE 1 - y END) AS payoff,
    count(*) AS n_fills, sum(maker::INT) AS maker_fills, sum((quote - mid) * shares) AS half_spread, sum((price - quote) * shares) AS slippage FROM fl GROUP BY w)"""


@query("settle_windows", f"WITH {SETTLED_SQL} SELECT w, up, down, round(cost, 7) AS cost, round(fees, 7) AS fees, payoff, n_fills, maker_fills, round(half_spread, 7) AS half_spread, round(slippage, 7) AS slippage, round(payoff - cost - fees, 7) AS pnl FROM se")
def settle_windows(spark, sf):
    """Shares, cost, fees, payoff and profit of each window's fills."""
    return rounded(ex.settle(fills(spark, sf), "w", F.col("y")), w=None, up=None, down=None, cost=7, fees=7, payoff=None, n_fills=None, maker_fills=None, half_spread=7, slippage=7, pnl=7)


@query("maker_spread", f"WITH {FILLS_SQL}, m AS (SELECT *, CASE WHEN side = 'up' THEN y ELSE 1 - y END AS ys FROM fl WHERE maker AND NOT crossed_fill) SELECT w, round(sum(shares * (mid_fill - price)), 7) AS effective_spread, round(sum(shares * (mid_later - mid_fill)), 7) AS markout, round(sum(shares * (ys - mid_fill)), 7) AS settled, sum(shares) AS spread_shares FROM m GROUP BY w")
def maker_spread(spark, sf):
    """Effective spread and markouts of resting orders."""
    return rounded(ex.maker_spread(fills(spark, sf), "w", F.col("y")), w=None, effective_spread=7, markout=7, settled=7, spread_shares=None)


@query(
    "backtest_report",
    f"""WITH {SETTLED_SQL}, r AS (SELECT *, w % 40 AS g, payoff - cost - fees AS pnl FROM se), e AS (SELECT *, 20000 + sum(pnl) OVER (PARTITION BY g ORDER BY w ROWS UNBOUNDED PRECEDING) AS eq FROM r), h AS (SELECT *, greatest(20000, max(eq) OVER (PARTITION BY g ORDER BY w ROWS UNBOUNDED PRECEDING)) AS high FROM e)
        SELECT g, count(*) AS traded, round(sum(pnl), 5) AS pnl, round(sum(fees), 5) AS fees, round(sum(cost), 5) AS turnover, sum(n_fills) AS fills, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 9) AS hit_rate, round(max(1 - eq / high), 8) AS max_drawdown, 20000 + sum(pnl) < 2000 AS ruined, round(sum(pnl) / 20000, 8) AS return FROM h GROUP BY g""",
)
def backtest_report(spark, sf):
    """Totals, hit rate, drawdown and ruin of accounts that hold the settled windows."""
    s = ex.settle(fills(spark, sf), "w", F.col("y")).withColumn("g", F.col("w") % 40)
    return rounded(ex.report(s, "g", ["w"], 20000.0, 0.1), g=None, traded=None, pnl=5, fees=5, turnover=5, fills=None, hit_rate=9, max_drawdown=8, ruined=None, **{"return": 8})


COSTS_SQL = """o AS (SELECT l_suppkey AS g, l_extendedprice / 1000 / (0.22 + 5 * l_discount) AS ordered, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0.5 END AS ratio, 0.2 + 5 * l_discount AS price, 0.22 + 5 * l_discount AS cost, 0.19 + 5 * l_discount AS mid, l_tax / 10 AS fee, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS payoff FROM lineitem),
    p AS (SELECT g, ordered * (payoff - mid) AS paper, ordered * ratio * (price - mid) AS arrival_cost, ordered * ratio * fee AS fees, ordered * (1 - ratio) * (payoff - mid) AS opportunity_cost, ordered * ratio * (payoff - cost) AS pnl, ordered * ratio * price AS turnover FROM o)"""


@query(
    "execution_shortfall",
    f"""WITH {COSTS_SQL} SELECT g, count(*) AS orders, round(sum(paper), 5) AS paper, round(sum(arrival_cost), 5) AS arrival_cost, round(sum(opportunity_cost), 5) AS opportunity_cost, round(sum(arrival_cost + fees + opportunity_cost), 5) AS shortfall, round(sum(pnl) / sum(turnover), 9) AS pnl_per_turnover,
        round(sum(arrival_cost) / sum(turnover), 9) AS slippage_per_turnover, round(sum(pnl) / (sum(arrival_cost) + sum(fees)), 7) AS return_on_costs FROM p GROUP BY g""",
)
def execution_shortfall(spark, sf):
    """Implementation shortfall of each supplier's orders against the mid at decision, and costs by turnover."""
    li, d = read(spark, sf, "lineitem"), F.col("l_discount")
    o = li.select(
        F.col("l_suppkey").alias("g"), (F.col("l_extendedprice") / 1000).alias("dollars"), (0.22 + 5 * d).alias("cost"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5).alias("fill_ratio"),
        (0.2 + 5 * d).alias("price"), (0.19 + 5 * d).alias("mid"), (F.col("l_tax") / 10).alias("fee"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("payoff"),
    )
    out = ex.shortfall(ex.order_costs(o), "g")
    return rounded(out, g=None, orders=None, paper=5, arrival_cost=5, opportunity_cost=5, shortfall=5, pnl_per_turnover=9, slippage_per_turnover=9, return_on_costs=7)


@query("time_weighted_return", f"WITH {RET_SQL}, e AS (SELECT g, r, 3 + sum(r) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq FROM ret) SELECT g, round(CASE WHEN min(eq) <= 0 THEN -1 ELSE pow(greatest(1 + sum(r) / 3, 0), 1 / 7.0) - 1 END, 9) AS twrr FROM e GROUP BY g")
def time_weighted_return(spark, sf):
    """Yearly growth of an account of three on each supplier's daily profit."""
    return rounded(ex.time_weighted_return(exact_returns(spark, sf), "g", ["day"], "r", 3.0, 7.0), g=None, twrr=9)


@query(
    "first_barriers",
    f"""WITH {EVENTS_SQL}, c AS (SELECT event_id, g, ts, value, 0.1 + k / 200.0 AS target FROM ev WHERE kind = 'click' AND 0.1 + k / 200.0 > 0.2), p AS (SELECT g, ts, avg(value) AS value FROM ev GROUP BY ALL), j AS (SELECT c.event_id, p.ts AS pt, p.value / nullif(c.value, 0) - 1 AS r, target FROM c JOIN p ON p.g = c.g AND p.ts > c.ts AND p.ts <= c.ts + 172800),
        h AS (SELECT event_id, min(CASE WHEN r > 2 * target THEN pt END) AS pt, min(CASE WHEN r < -target THEN pt END) AS sl FROM j GROUP BY event_id) SELECT event_id, least(c.ts + 172800, pt, sl) AS t1, pt, sl FROM c LEFT JOIN h USING (event_id)""",
)
def first_barriers(spark, sf):
    """The earliest of a profit barrier, a loss barrier (of each click's own width) and two days; narrow targets go."""
    e = events(spark, sf)
    clicks = e.filter("kind = 'click'").select("event_id", "g", "ts", "value", (0.1 + F.col("k") / 200).alias("target"))
    path = e.groupBy("g", "ts").agg(F.avg("value").alias("value"))
    out = ex.first_barrier(clicks, path, "g", "ts", "value", "target", "ts", "value", 2.0, 1.0, 172800, 0.2)
    return out.select("event_id", "t1", "pt", "sl")


FAIR = {"lag": 1, "half_life": 12.0, "length": 24, "lookback": 4}
HOURS_SQL = f"""{EVENTS_SQL}, cl AS (SELECT kind AS g, floor(ts / 3600)::BIGINT AS sec, avg(value) + 300 AS close FROM ev GROUP BY ALL), sp AS (SELECT g, min(sec) AS a, max(sec) AS z FROM cl GROUP BY g), gr AS (SELECT g, unnest(range(a, z + 1)) AS sec FROM sp),
    fi AS (SELECT g, sec, ln(last_value(close IGNORE NULLS) OVER (PARTITION BY g ORDER BY sec ROWS UNBOUNDED PRECEDING)) AS x FROM gr LEFT JOIN cl USING (g, sec)), rr AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY g ORDER BY sec), 0) AS r, row_number() OVER (PARTITION BY g ORDER BY sec) AS i FROM fi),
    pa AS (SELECT g, sec + 1 AS at, x, sum(r * r * pow(2, i / 12.0)) OVER w / sum(pow(2, i / 12.0)) OVER w AS var FROM rr WINDOW w AS (PARTITION BY g ORDER BY sec ROWS UNBOUNDED PRECEDING)),
    wi AS (SELECT g, unnest(range(a + 24, z - 24, 24)) AS start FROM sp), kk AS (SELECT wi.g, start, CASE WHEN count(close) = 4 THEN ln(avg(close)) END AS k FROM wi JOIN cl ON cl.g = wi.g AND sec >= start - 5 AND sec < start - 1 GROUP BY ALL),
    tt AS (SELECT wi.g, wi.start, t, pa.x, pa.var, 23 - t AS tau FROM wi, range(24) r(t) JOIN pa ON pa.g = wi.g AND pa.at = wi.start + t), ii AS (SELECT tt.g, tt.start, tt.t, sum(p2.x) AS inside FROM tt JOIN pa p2 ON p2.g = tt.g AND p2.at > tt.start + 19 AND p2.at <= tt.start + least(tt.t, 23) GROUP BY ALL),
    mm AS (SELECT tt.g, tt.start, tt.t, CASE WHEN tau >= 4 THEN x WHEN tau > 0 THEN (coalesce(inside, 0) + tau * x) / 4 ELSE coalesce(inside, 0) / 4 END - k AS m, sqrt(var) AS sigma_raw, CASE WHEN tau >= 4 THEN tau - 4 + 5 * 9 / 24.0 WHEN tau > 0 THEN tau * (tau + 1) * (2 * tau + 1) / 96.0 ELSE 0 END AS units
        FROM tt LEFT JOIN ii USING (g, start, t) LEFT JOIN kk USING (g, start)), zz AS (SELECT *, m / sqrt(pow(greatest(sigma_raw * 1.1, 1e-3), 2) * units + 1e-4) AS z FROM mm)"""


def hourly(spark, sf):
    """Hourly mean values of each kind of event as closes, and windows of a day."""
    e = events(spark, sf).groupBy(F.col("kind").alias("g"), F.floor(F.col("ts") / 3600).alias("sec")).agg((F.avg("value") + 300).alias("close"))
    span = e.groupBy("g").agg(F.min("sec").alias("a"), F.max("sec").alias("z"))
    windows = span.select("g", F.explode(F.expr("filter(sequence(a + 24, greatest(z, a + 24), 24L), s -> s < z - 24)")).alias("start"))
    return e, windows


@query("fair_windows", f"WITH {HOURS_SQL} SELECT g, start, t, round(m, 9) AS m, round(sigma_raw, 9) AS sigma_raw, round(units, 7) AS units, CASE WHEN m IS NOT NULL THEN round({norm_cdf_sql('z')}, 8) END AS fair FROM zz")
def fair_windows(spark, sf):
    """Fair price of a day's settling average against its opening one, hour by hour."""
    closes, windows = hourly(spark, sf)
    out = fair.fair_prices(fair.window_inputs(closes, windows, "g", **FAIR), 1.1, 1e-2, 1e-3)
    return rounded(out, g=None, start=None, t=None, m=9, sigma_raw=9, units=7, fair=8)


@query("fair_fit")
def fair_fit(spark, sf):
    """The volatility multiple and basis under which the windows' outcomes are likeliest."""
    closes, windows = hourly(spark, sf)
    inputs = fair.window_inputs(closes, windows, "g", **FAIR)
    outcome = inputs.filter("t = 23 and m is not null").select("g", "start", (F.col("m") >= 0).cast("double").alias("y"))
    best = fair.fit_fair(inputs.filter("t % 4 = 1").join(outcome, ["g", "start"]), 1e-4)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in best.items()], "name string, value double")


SPANS = (3600, 21600, 86400)
OPEN_S = 300


@query(
    "tape_windows",
    f"""WITH {EVENTS_SQL} SELECT event_id, {", ".join(f"round(coalesce(sum(value) OVER w{s}, 0), 5) AS volume_{s}" for s in SPANS)}, round(sum(CASE WHEN kind = 'purchase' THEN value ELSE 0 END) OVER w86400 / nullif(sum(value) OVER w86400, 0), 9) AS buy_share, count(*) OVER w86400 AS trades,
        round((sum(CASE WHEN ts % 3600 < {OPEN_S} THEN value ELSE 0 END) OVER w86400 / (24 * {OPEN_S}.0)) / (nullif(sum(value) OVER w86400, 0) / 86400), 8) AS open_ratio,
        round(CASE WHEN count(*) OVER w86400 >= 2 THEN sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) OVER w86400 / (count(*) OVER w86400)::DOUBLE END, 9) AS round_share
        FROM ev WINDOW {", ".join(f"w{s} AS (PARTITION BY g ORDER BY ts RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING)" for s in SPANS)}""",
)
def tape_windows(spark, sf):
    """Trailing volumes, buy share, share traded at the hours' openings, and share of round sizes, strictly before each event."""
    e, v = events(spark, sf), F.col("value")
    w = lambda s: Window.partitionBy("g").orderBy("ts").rangeBetween(-s, -1)
    day = w(86400)
    total, n = F.sum(v).over(day), F.count(F.lit(1)).over(day)
    opening = F.sum(F.when(F.col("ts") % 3600 < OPEN_S, v).otherwise(0.0)).over(day)
    return e.select(
        "event_id", *[F.round(F.coalesce(F.sum(v).over(w(s)), F.lit(0.0)), 5).alias(f"volume_{s}") for s in SPANS],
        F.round(F.try_divide(F.sum(F.when(F.col("kind") == "purchase", v).otherwise(0.0)).over(day), total), 9).alias("buy_share"), n.alias("trades"),
        F.round(F.try_divide(opening / (24 * OPEN_S), total / 86400), 8).alias("open_ratio"),
        F.round(F.when(n >= 2, F.sum(F.when(F.col("k") % 10 == 0, 1).otherwise(0)).over(day) / n), 9).alias("round_share"),
    )


@query(
    "tape_features",
    f"""WITH {EVENTS_SQL}, l AS (SELECT *, ts - lag(ts) OVER o AS gap, CASE WHEN kind IN ('purchase', 'view') THEN 1 ELSE -1 END AS s FROM ev WINDOW o AS (PARTITION BY g ORDER BY event_id)), f AS (SELECT event_id, count(*) OVER w AS n, avg(CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0 END) OVER w AS round_share,
        quantile_cont(value, 0.5) OVER w AS q50, quantile_cont(value, 0.9) OVER w AS q90, avg(s) OVER w AS sign_mean, stddev_pop(gap) OVER w2 / nullif(avg(gap) OVER w2, 0) AS gap_cv FROM l WINDOW w AS (PARTITION BY g ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY g ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
        SELECT event_id, round(round_share, 9) AS round_share, round(q50, 6) AS q50, round(q90, 6) AS q90, round(sign_mean, 9) AS sign_mean, round(gap_cv, 7) AS gap_cv FROM f WHERE n = 20""",
)
def tape_features(spark, sf):
    """Round sizes, size quantiles, mean sign and spread of gaps of the twenty events before each, where there are so many."""
    o = Window.partitionBy("g").orderBy("event_id")
    w, w2 = o.rowsBetween(-20, -1), o.rowsBetween(-19, -1)
    e = events(spark, sf).withColumn("gap", F.col("ts") - F.lag("ts").over(o)).withColumn("s", F.when(F.col("kind").isin("purchase", "view"), 1).otherwise(-1))
    f = e.select(
        "event_id", F.count(F.lit(1)).over(w).alias("n"), F.avg((F.col("k") % 10 == 0).cast("double")).over(w).alias("round_share"), F.percentile("value", 0.5).over(w).alias("q50"), F.percentile("value", 0.9).over(w).alias("q90"),
        F.avg("s").over(w).alias("sign_mean"), F.try_divide(F.stddev_pop("gap").over(w2), F.avg("gap").over(w2)).alias("gap_cv"),
    )
    return rounded(f.filter("n = 20"), event_id=None, round_share=9, q50=6, q90=6, sign_mean=9, gap_cv=7)


def market_windows(spark, sf):
    """Users' days as windows of 300 seconds, a further one for every 40 events: each event is a quote and, later, a print."""
    e = events(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400))
    n = F.row_number().over(Window.partitionBy("g", "day").orderBy("event_id")) - 1
    e = e.withColumn("n", n).withColumn("window", F.col("day") * 1000 + F.floor(F.col("n") / 40)).withColumn("t", ((F.col("n") % 40 + 1) * 7).cast("int"))
    price = F.least(F.greatest(F.col("k") / 101.0, F.lit(0.03)), F.lit(0.97))
    quote = F.struct("t", (F.col("value") / 500).alias("fair"), F.lit(1e-4).alias("sigma"), (price + 0.01).alias("ask"), (price - 0.01).alias("bid"), F.lit(1.0).alias("ask_age"), F.lit(1.0).alias("bid_age"), ((F.col("k") - 50) / 50).alias("imb"), F.lit(1.0).alias("imb_age"))
    sold = F.when(F.col("kind").isin("purchase", "view"), 1).otherwise(-1)
    prints = F.struct((F.col("t") + 8.0).alias("ts"), sold.alias("sign"), price.alias("p_up"), (F.col("value") / 2).alias("shares"))
    return e.groupBy("g", "window").agg(F.collect_list(quote).alias("quotes"), F.collect_list(prints).alias("prints"), (F.sum("k") % 2).cast("double").alias("y")).select("g", (F.col("window") * 300).alias("start"), "y", "quotes", "prints")


STRATEGIES = {"prob_taker": strategies.ProbTaker(), "flow_taker": strategies.FlowTaker(), "fair_maker": strategies.FairMaker(every=1), "open_fair": strategies.OpenFairTaker(), "endgame_maker": strategies.EndgameMaker(first=5, sure=0.9)}
LIMITS = strategies.Limits(spread=5.0, age=30.0, finite=True, least_left=5, most_left=295, window_cost=0.05, daily_loss=0.10, drawdown=0.15, losses=5)


@query("strategy_backtests")
def strategy_backtests(spark, sf):
    """Five strategies, each alone and under risk limits, on every user's windows: windows traded, fills, fees and profit."""
    windows, out = market_windows(spark, sf), None
    for name, strategy in STRATEGIES.items():
        for managed in (False, True):
            make = (lambda s=strategy: strategies.RiskManaged(s, LIMITS)) if managed else (lambda s=strategy: s)
            r = strategies.backtest(windows, "g", make).select(F.lit(name).alias("strategy"), F.lit(managed).alias("managed"), "*")
            out = r if out is None else out.unionByName(r)
    return out.groupBy("strategy", "managed").agg(F.count(F.lit(1)).alias("windows"), F.sum("n_fills").alias("fills"), F.round(F.sum("fees"), 6).alias("fees"), F.round(F.sum("pnl"), 6).alias("pnl"))


LENGTH, DRAWS = 60, 200


def named(df, name):
    return df.select(F.lit(name).alias("test"), "quantile", F.round("critical", 9).alias("critical"))


@query("break_critical_values")
def break_critical_values(spark, sf):
    """Simulated critical values of the explosiveness, level-shift and trend tests under a random walk."""
    walk = montecarlo.random_walk
    tests = {
        "sadf": lambda rng: np.nanmax(sq.bsadf(walk(rng, LENGTH))),
        "csw_sup": lambda rng: np.nanmax(sq.csw_cusum(walk(rng, LENGTH))),
        "chow_dfc": lambda rng: sq.chow(walk(rng, LENGTH)),
        "smt": lambda rng: np.nanmax(sq.smt(walk(rng, LENGTH))),
    }
    out = None
    for name, f in tests.items():
        part = named(montecarlo.critical_values(montecarlo.simulated(spark, DRAWS, f)), name)
        out = part if out is None else out.unionByName(part)
    return out


@query("wild_bootstrap_flags")
def wild_bootstrap_flags(spark, sf):
    """Each supplier's explosiveness statistic, its own wild-bootstrap critical value, and whether it is passed."""

    def test(y):
        greatest = lambda z: float(np.nanmax(t)) if np.isfinite(t := sq.bsadf(z)).any() else float("nan")
        own, sims = greatest(y), [greatest(montecarlo.wild_walk(y, np.random.default_rng((1, d)))) for d in range(49)] if len(y) > 1 else [float("nan")]
        known = [x for x in sims if np.isfinite(x)]
        critical = float(np.quantile(known, 0.95)) if known else float("nan")
        return {"sadf": [own], "critical": [critical], "flag": [own > critical]}

    return sq.per_series(monthly(spark, sf), "g", "t", "y", "sadf double, critical double, flag boolean", test)


@query("adf_quantiles")
def adf_quantiles(spark, sf):
    """Quantile, spread and tail mean of the Dickey-Fuller statistics of all windows that end at each month of a supplier."""
    out = sq.per_series(monthly(spark, sf), "g", "t", "y", "i long, q double, spread double, tail double, tail_sd double", sq.adf_quantiles)
    return rounded(out, g=None, i=None, q=6, spread=6, tail=6, tail_sd=6)


@query("test_costs", "WITH t AS (SELECT event_id, 1 + event_id % 5 AS n, 50 + event_id % 200 AS rows FROM events) SELECT event_id, n * n * n + n * n * (2 * rows + 3) + n * (4 * rows - 1) + 2 * rows + 2 AS adf_operations, (rows - 20 + 2) * (rows - 20 + 1) // 2 AS sadf_tests FROM t")
def test_costs(spark, sf):
    """Operations of one Dickey-Fuller fit, and the number of fits behind a supremum series."""
    t = events(spark, sf).select("event_id", (1 + F.col("event_id") % 5).alias("n"), (50 + F.col("event_id") % 200).alias("rows"))
    return t.select("event_id", sq.adf_operations(F.col("n"), F.col("rows")).alias("adf_operations"), sq.sadf_tests(F.col("rows"), 20).alias("sadf_tests"))


@query("entropy_bias")
def entropy_bias(spark, sf):
    """Bias of the match-length entropy estimate over messages of three symbols."""
    out = montecarlo.estimator_bias(spark, lambda m: sq.kontoyiannis(m.tolist()), [0.5, 0.3, 0.2], 80, 100)
    return rounded(out, mean=9, sd=9, bias=9)


@query("component_risk")
def component_risk(spark, sf):
    """Share of an even portfolio's variance by principal component, its concentration, and the weights of least variance."""
    names, cov = portfolio.covariance(daily(spark, sf), "day", "g", "v")
    even = np.full(len(names), 1 / len(names))
    values, share = portfolio.component_risk(cov, even)
    weights = portfolio.least_variance(cov)
    rows = [(n, float(v), round(float(s), 9), round(float(w), 7), round(portfolio.concentration(share), 9), portfolio.leading(values, 0.95)) for n, v, s, w in zip(names, values, share, weights, strict=True)]
    return spark.createDataFrame(rows, "asset string, eigenvalue double, risk_share double, least_variance double, concentration double, leading int")


@query("orthogonal_features")
def orthogonal_features(spark, sf):
    """Principal components of line items' sizes, prices, discounts and taxes: their variances, which are the eigenvalues."""
    li = read(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"))
    out, fit = portfolio.orthogonal_features(li, ["a", "b", "c", "d"], 0.95)
    pcs = [f"pc{n + 1}" for n in range(len(fit["eigenvalues"]))]
    one = out.agg(*[F.var_pop(c).alias(c) for c in pcs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.round(c, 7).alias("variance")) for c in pcs])).alias("r")).select("r.*")
