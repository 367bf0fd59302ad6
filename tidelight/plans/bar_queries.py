"""Queries over bars of the supplier tape and the user events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.functions.maths import norm_cdf_sql
from tidelight.operators import bars
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, TAPE_ORDER, TRADES_SQL, events, trades

OUT = ["open", "high", "low", "close", "vwap", "n_ticks", "volume", "buy_volume", "sell_volume", "tick_imbalance", "volume_imbalance"]
BAR_SQL = """arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
    coalesce(sum(price * size) / nullif(sum(size), 0), arg_max(price, rn)) AS vwap, count(*) AS n_ticks, sum(size) AS volume,
    sum(CASE WHEN sign > 0 THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN sign > 0 THEN 0 ELSE size END) AS sell_volume,
    sum(sign)::BIGINT AS tick_imbalance, sum(sign * size) AS volume_imbalance"""
RANKED_SQL = f"{TRADES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts, l_orderkey, l_linenumber, l_partkey) AS rn FROM trades)"
ROUND = "g, bar, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(vwap, 6) AS vwap, n_ticks, round(volume, 6) AS volume, round(buy_volume, 6) AS buy_volume, round(sell_volume, 6) AS sell_volume, tick_imbalance, round(volume_imbalance, 6) AS volume_imbalance"


def rounded(df):
    return df.select("g", "bar", *[F.col(c) if c in ("n_ticks", "tick_imbalance") else F.round(c, 6).alias(c) for c in OUT])


@query("bars_tick", f"WITH {RANKED_SQL}, b AS (SELECT g, (rn - 1) // 20 AS bar, {BAR_SQL} FROM r GROUP BY g, bar) SELECT {ROUND} FROM b WHERE n_ticks = 20")
def bars_tick(spark, sf):
    """Flagship: bars of 20 trades for each supplier."""
    return rounded(bars.tick_bars(trades(spark, sf), "g", TAPE_ORDER, 20))


@query(
    "bars_time",
    f"""WITH {EVENTS_SQL}, r AS (SELECT g, ts // 86400 AS bar, value AS price, k AS size, CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE -1 END AS sign,
        row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS rn FROM ev), b AS (SELECT g, bar, {BAR_SQL} FROM r GROUP BY g, bar) SELECT {ROUND} FROM b""",
)
def bars_time(spark, sf):
    tape = events(spark, sf).select("g", "ts", "event_id", F.col("value").alias("price"), F.col("k").cast("double").alias("size"), F.when(F.col("kind").isin("purchase", "signup"), 1).otherwise(-1).alias("sign"))
    return rounded(bars.time_bars(tape, "g", "ts", ["ts", "event_id"], 86400))


def size_bar_sql(flow: str, size: float) -> str:
    """Bars that drop their overshoot, as a recursion over each supplier's trades."""
    return f"""WITH RECURSIVE {RANKED_SQL}, walk AS (
        SELECT g, rn, {flow} AS held, 0::BIGINT AS bar FROM r WHERE rn = 1
        UNION ALL SELECT r.g, r.rn, CASE WHEN held >= {size} THEN 0 ELSE held END + {flow.replace("size", "r.size").replace("price", "r.price")},
            bar + CASE WHEN held >= {size} THEN 1 ELSE 0 END FROM walk JOIN r ON r.g = walk.g AND r.rn = walk.rn + 1),
        b AS (SELECT g, bar, {BAR_SQL} FROM r JOIN walk USING (g, rn) GROUP BY g, bar), m AS (SELECT g, max(bar) AS last FROM b GROUP BY g)
        SELECT {ROUND} FROM b JOIN m USING (g) WHERE bar < last"""


@query("bars_volume", size_bar_sql("size", 500))
def bars_volume(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Size(500.0), F.col("size"))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query("bars_dollar", size_bar_sql("(price * size)", 700000))
def bars_dollar(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Size(700000.0), F.col("price") * F.col("size"))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


LAST_SQL = f"m AS (SELECT g, max(bar) AS last FROM b GROUP BY g) SELECT {ROUND} FROM b JOIN m USING (g) WHERE bar < last"


def adaptive_bar_sql(size: float, bars_per_window: float, span: float) -> str:
    """Bars whose size follows the mean volume of past years; a year's end closes a bar that holds anything."""
    rate = 2 / (span + 1)
    moved = f"(flow + {rate!r} * (seen - flow))"
    return f"""WITH RECURSIVE {RANKED_SQL}, y AS (SELECT *, year(to_timestamp(ts)) AS yr FROM r), walk AS (
        SELECT g, rn, yr, 0::BIGINT AS bar, size AS held, {size}::DOUBLE AS lim, {size * bars_per_window}::DOUBLE AS flow, size AS seen FROM y WHERE rn = 1
        UNION ALL SELECT g, rn, yr, bar, held + v, lim, flow, seen + v FROM (SELECT y.g, y.rn, y.yr, y.size AS v,
            CASE WHEN y.yr <> w.yr THEN w.bar + CASE WHEN w.held > 0 AND w.held < w.lim THEN 1 WHEN w.held >= w.lim THEN 1 ELSE 0 END WHEN w.held >= w.lim THEN w.bar + 1 ELSE w.bar END AS bar,
            CASE WHEN y.yr <> w.yr OR w.held >= w.lim THEN 0 ELSE w.held END AS held, CASE WHEN y.yr <> w.yr THEN greatest({moved} / {bars_per_window}, 1e-9) ELSE w.lim END AS lim,
            CASE WHEN y.yr <> w.yr THEN {moved} ELSE flow END AS flow, CASE WHEN y.yr <> w.yr THEN 0 ELSE seen END AS seen FROM walk w JOIN y ON y.g = w.g AND y.rn = w.rn + 1)),
        b AS (SELECT g, bar, {BAR_SQL} FROM r JOIN walk USING (g, rn) GROUP BY g, bar), {LAST_SQL}"""


@query("bars_volume_adaptive", adaptive_bar_sql(500.0, 4.0, 12.0))
def bars_volume_adaptive(spark, sf):
    """The bar size follows the average volume of past years."""
    tape = trades(spark, sf).withColumn("year", F.year(F.timestamp_seconds("ts")))
    return rounded(bars.closed(bars.summarise(bars.assign_bars(tape, "g", TAPE_ORDER, bars.Size(500.0, 4.0), F.col("size"), window="year"), ["g", "bar"]), "g"))


def learning_bar_sql(flow: str, length: float, state: dict[str, tuple[float, str]], limit: str, sums: str, reached: str, clip: float = 4.0, span: float = 20.0) -> str:
    """Bars that learn, as a recursion over trades. ``state``: averages' starts and their updates; ``limit`` is taken at a bar's first trade; ``sums`` start at 0 there."""
    names = ", ".join(state)
    grown = f"least(greatest(len + 2 / {span + 1} * (n - len), {length / clip}), {length * clip})"
    sum_names = [x.split(" AS ")[1] for x in sums.split("; ")]
    return f"""WITH RECURSIVE {RANKED_SQL}, t AS (SELECT *, {flow} AS v FROM r), walk AS (
        SELECT g, 0::BIGINT AS rn, -1::BIGINT AS bar, true AS done, 0::BIGINT AS n, {length}::DOUBLE AS len, 0::DOUBLE AS lim, {", ".join(f"0::DOUBLE AS {x}" for x in sum_names)}, {", ".join(f"{v!r}::DOUBLE AS {k}" for k, (v, _) in state.items())} FROM (SELECT DISTINCT g FROM t)
        UNION ALL SELECT g, rn, bar, done, n, CASE WHEN done THEN {grown} ELSE len END AS len, lim, {", ".join(sum_names)}, {", ".join(f"{u} AS {k}" for k, (_, u) in state.items())}
            FROM (SELECT *, {reached} >= lim AS done FROM (SELECT g, rn, v, sign, bar, n, len, lim, {", ".join(f"s_{x} + {e.split(' AS ')[0]} AS {x}" for x, e in zip(sum_names, sums.split("; "), strict=True))}, {names}
            FROM (SELECT t.g, t.rn, t.v, t.sign, CASE WHEN w.done THEN w.bar + 1 ELSE w.bar END AS bar, CASE WHEN w.done THEN 1 ELSE w.n + 1 END AS n, w.len, CASE WHEN w.done THEN {limit} ELSE w.lim END AS lim, {", ".join(f"CASE WHEN w.done THEN 0 ELSE w.{x} END AS s_{x}" for x in sum_names)}, {", ".join(f"w.{k}" for k in state)}
            FROM walk w JOIN t ON t.g = w.g AND t.rn = w.rn + 1)))),
        b AS (SELECT g, bar, {BAR_SQL} FROM r JOIN walk USING (g, rn) GROUP BY g, bar), {LAST_SQL}"""


def imbalance_sql(flow: str, length: float, mean: float, sd: float) -> str:
    rate = 2 / (10 * length + 1)
    state = {"m": (mean, f"m + {rate!r} * (v * sign - m)"), "m2": (sd**2 + mean**2, f"m2 + {rate!r} * (v * sign * v * sign - m2)")}
    return learning_bar_sql(flow, length, state, "greatest(w.len * abs(w.m), sqrt(greatest(w.m2 - w.m * w.m, 0)) * sqrt(w.len))", "v * sign AS theta", "abs(theta)")


def run_sql(flow: str, length: float, p_buy: float, v_buy: float = 1.0, v_sell: float = 1.0, v2: float = 1.0) -> str:
    rate = 2 / (10 * length + 1)
    state = {
        "p": (p_buy, f"p + {rate!r} * (CASE WHEN sign > 0 THEN 1 ELSE 0 END - p)"), "vb": (v_buy, f"CASE WHEN sign > 0 THEN vb + {rate!r} * (v - vb) ELSE vb END"),
        "vs": (v_sell, f"CASE WHEN sign > 0 THEN vs ELSE vs + {rate!r} * (v - vs) END"), "q": (v2, f"q + {rate!r} * (v * v - q)"),
    }
    gap, total = "(w.p * w.vb - (1 - w.p) * w.vs)", "(w.p * w.vb + (1 - w.p) * w.vs)"
    mu, sd = f"(w.len * {gap})", f"(sqrt(w.len) * sqrt(greatest(w.q - {gap} * {gap}, 0)))"
    folded = f"CASE WHEN {sd} <= 0 THEN abs({mu}) ELSE {sd} * sqrt(2 / pi()) * exp(-({mu} / {sd}) * ({mu} / {sd}) / 2) + {mu} * (2 * {norm_cdf_sql(f'({mu} / {sd})')} - 1) END"
    return learning_bar_sql(flow, length, state, f"(w.len * {total} + {folded}) / 2", "CASE WHEN sign > 0 THEN v ELSE 0 END AS bought; CASE WHEN sign > 0 THEN 0 ELSE v END AS sold", "greatest(bought, sold)")


@query("bars_imbalance_tick", imbalance_sql("1e0", 20.0, 0.3, 0.9))
def bars_imbalance_tick(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Imbalance(20.0, mean=0.3, sd=0.9), F.lit(1.0))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query("bars_imbalance_volume", imbalance_sql("size", 20.0, 8.0, 28.0))
def bars_imbalance_volume(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Imbalance(20.0, mean=8.0, sd=28.0), F.col("size"))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query("bars_imbalance_dollar", imbalance_sql("size * price", 20.0, 12000.0, 45000.0))
def bars_imbalance_dollar(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Imbalance(20.0, mean=12000.0, sd=45000.0), F.col("size") * F.col("price"))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query("bars_run_tick", run_sql("1e0", 20.0, 0.66))
def bars_run_tick(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Run(20.0, p_buy=0.66), F.lit(1.0))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query("bars_run_volume", run_sql("size", 20.0, 0.66, 25.0, 25.0, 860.0))
def bars_run_volume(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Run(20.0, p_buy=0.66, v_buy=25.0, v_sell=25.0, v2=860.0), F.col("size"))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query("bars_run_dollar", run_sql("size * price", 20.0, 0.66, 37000.0, 37000.0, 2e9))
def bars_run_dollar(spark, sf):
    dealt = bars.assign_bars(trades(spark, sf), "g", TAPE_ORDER, bars.Run(20.0, p_buy=0.66, v_buy=37000.0, v_sell=37000.0, v2=2e9), F.col("size") * F.col("price"))
    return rounded(bars.closed(bars.summarise(dealt, ["g", "bar"]), "g"))


@query(
    "bar_calibration",
    f"""WITH {TRADES_SQL} SELECT count(DISTINCT g) AS windows, round(count(*) / count(DISTINCT g), 6) AS ticks, round(sum(size) / count(DISTINCT g), 6) AS per_window,
        round(avg(sign * size), 6) AS bv_mean, round(stddev_pop(sign * size), 6) AS bv_sd, round(avg(CASE WHEN sign > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_buy,
        round(avg(CASE WHEN sign > 0 THEN size END), 6) AS v_buy, round(avg(CASE WHEN sign < 0 THEN size END), 6) AS v_sell, round(avg(size * size), 6) AS v2 FROM trades""",
)
def bar_calibration(spark, sf):
    out = bars.calibration(trades(spark, sf), "g", F.col("size"))
    return out.select("windows", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("bar_scale_fit")
def bar_scale_fit(spark, sf):
    """The scale at which tick bars come to 25 a supplier."""
    sizes = trades(spark, sf).groupBy("g").count().groupBy("count").agg(F.count(F.lit(1)).alias("groups")).collect()  # a row for each length that occurs
    total = max(1, sum(r["groups"] for r in sizes))
    scale = bars.fit_scale(lambda s: sum(r["groups"] * (r["count"] // max(1, round(20 * s))) for r in sizes) / total, 25.0)
    return spark.createDataFrame([(round(scale, 6),)], "scale double")


@query(
    "tick_rule_accuracy",
    f"""WITH {TRADES_SQL}, d AS (SELECT *, sign(price - lag(price) OVER w) AS moved, row_number() OVER w AS rn FROM trades WINDOW w AS (PARTITION BY g ORDER BY ts, l_orderkey, l_linenumber, l_partkey)),
        i AS (SELECT *, coalesce(last_value(CASE WHEN moved <> 0 THEN moved END IGNORE NULLS) OVER (PARTITION BY g ORDER BY rn ROWS UNBOUNDED PRECEDING), 1) AS inferred FROM d)
        SELECT g, count(*) AS n, round(avg(CASE WHEN inferred = sign THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM i GROUP BY g""",
)
def tick_rule_accuracy(spark, sf):
    inferred = bars.tick_rule(trades(spark, sf), "g", TAPE_ORDER)
    return inferred.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("inferred") == F.col("sign")).cast("double")), 9).alias("accuracy"))


@query(
    "bar_logit_returns",
    f"""WITH {RANKED_SQL}, b AS (SELECT g, (rn - 1) // 20 AS bar, arg_max(price, rn) AS close, count(*) AS n FROM r GROUP BY g, bar),
        l AS (SELECT g, bar, least(greatest(close / 2500, 0.005), 0.995) AS p FROM b WHERE n = 20),
        d AS (SELECT g, bar, ln(p / (1 - p)) - lag(ln(p / (1 - p))) OVER (PARTITION BY g ORDER BY bar) AS ret FROM l) SELECT g, bar, round(ret, 9) AS ret FROM d WHERE ret IS NOT NULL""",
)
def bar_logit_returns(spark, sf):
    """Bar-to-bar change of the log-odds of the close (as a share of 2,500), never across suppliers."""
    b = bars.tick_bars(trades(spark, sf), "g", TAPE_ORDER, 20)
    p = F.least(F.greatest(F.col("close") / 2500, F.lit(0.005)), F.lit(0.995))
    level = F.ln(p / (1 - p))
    out = b.select("g", "bar", (level - F.lag(level).over(Window.partitionBy("g").orderBy("bar"))).alias("ret"))
    return out.filter("ret is not null").select("g", "bar", F.round("ret", 9).alias("ret"))
