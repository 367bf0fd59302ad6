"""Queries over returns: moments, dependence, drawdowns, corrections, microstructure, overfitting."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.functions.maths import norm_cdf, norm_cdf_sql
from tidelight.operators import bars, stats
from tidelight.plans.bar_queries import BAR_SQL, RANKED_SQL
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, TAPE_ORDER, TRADES_SQL, epoch, events, read, trades

RET_SQL = "ret AS (SELECT l_suppkey AS g, floor(epoch(l_shipdate) / 86400)::BIGINT AS day, sum(round((l_tax - 0.04) * 100) * l_quantity) / 1000 AS r FROM lineitem GROUP BY ALL)"


def returns(spark, sf):
    """Daily profit of each supplier, in exact thousandths."""
    li = read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("g"), F.floor(epoch("l_shipdate") / 86400).alias("day")).agg((F.sum(F.round((F.col("l_tax") - 0.04) * 100) * F.col("l_quantity")) / 1000).alias("r"))


def exact_returns(spark, sf):
    """The same as decimals, whose sums are the same in any order."""
    return returns(spark, sf).withColumn("r", F.col("r").cast("decimal(38,12)"))


MOM_SQL = f"""{RET_SQL}, m AS (SELECT g, avg(r) AS m FROM ret GROUP BY g), k AS (SELECT g, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg((r - m) * (r - m)) AS m2, avg(pow(r - m, 3)) AS m3, avg(pow(r - m, 4)) AS m4,
    avg(ln(1 + r)) AS log_growth, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS hit_rate FROM ret JOIN m USING (g) GROUP BY g), s AS (SELECT *, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurtosis, mean / sd AS sharpe FROM k),
    z AS (SELECT *, sharpe * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS z FROM s)"""


@query("sharpe_summary", f"WITH {MOM_SQL} SELECT g, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(sharpe, 9) AS sharpe, round(skew, 8) AS skew, round(kurtosis, 7) AS kurtosis, round({norm_cdf_sql('z')}, 8) AS psr, round(n / 6.0 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4), 5) AS jarque_bera, round(hit_rate, 9) AS hit_rate FROM z")
def sharpe_summary(spark, sf):
    """Moments, Sharpe ratio, probabilistic Sharpe ratio, Jarque-Bera and hit rate of each supplier's daily profit."""
    digits = {"mean": 9, "sd": 9, "sharpe": 9, "skew": 8, "kurtosis": 7, "psr": 8, "jarque_bera": 5, "hit_rate": 9}
    return stats.summary(returns(spark, sf), "g", "r").select("g", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("cvar", f"WITH {RET_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r, day) AS rn, count(*) OVER (PARTITION BY g) AS n FROM ret) SELECT g, round(avg(r), 9) AS cvar FROM k WHERE rn <= ceil(0.05 * n) GROUP BY g")
def cvar(spark, sf):
    """Mean of the worst twentieth of days."""
    return stats.cvar(returns(spark, sf), "g", "r", ["day"], 0.05).select("g", F.round("cvar", 9).alias("cvar"))


LAGS = 5
LAG_SQL = f"""{RET_SQL}, d AS (SELECT g, day, r - avg(r) OVER (PARTITION BY g) AS d FROM ret), l AS (SELECT g, k, d * CASE k {" ".join(f"WHEN {k} THEN lag(d, {k}) OVER w" for k in range(1, LAGS + 1))} ELSE d END AS p
    FROM d, range(0, {LAGS + 1}) t(k) WINDOW w AS (PARTITION BY g, k ORDER BY day)), c AS (SELECT g, k, sum(p) AS c, count(p) AS pairs FROM l GROUP BY g, k), b AS (SELECT g, c AS v, pairs AS n FROM c WHERE k = 0),
    q AS (SELECT g, n, v, n * (n + 2) * sum(pow(c / v, 2) / (n - k)) AS q, sum(pairs * pow((c / pairs) / (v / n), 2)) AS bp, max(CASE WHEN k = 1 THEN c / v END) AS rho1, sum(2 * (1 - k / {LAGS + 1}.0) * c) AS hac FROM c JOIN b USING (g) WHERE k > 0 GROUP BY g, n, v),
    mm AS (SELECT g, avg(r) AS m FROM ret GROUP BY g)"""


@query("serial_dependence", f"WITH {LAG_SQL} SELECT g, n, round(q, 6) AS q, round(bp, 6) AS bp, round(rho1, 9) AS rho1, round(m / sqrt((v + hac) / n / n), 7) AS nw_t FROM q JOIN mm USING (g)")
def serial_dependence(spark, sf):
    """Ljung-Box and Box-Pierce statistics, first autocorrelation, and Newey-West t of the mean."""
    out = stats.ljung_box(returns(spark, sf), "g", ["day"], "r", LAGS)
    return out.select("g", "n", F.round("q", 6).alias("q"), F.round("bp", 6).alias("bp"), F.round("rho1", 9).alias("rho1"), F.round("nw_t", 7).alias("nw_t"))


@query(
    "holm_bh",
    f"""WITH {MOM_SQL}, p AS (SELECT g, round(1 - {norm_cdf_sql("z")}, 9) AS p FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, g) AS r, count(*) OVER () AS m FROM p)
        SELECT g, p, round(least(max(p * (m - r + 1)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 1), 8) AS holm, round(least(min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS bh FROM r""",
)
def holm_bh(spark, sf):
    """Adjusted p-values of all suppliers' mean profits."""
    p = stats.summary(returns(spark, sf), "g", "r").select("g", F.round(1 - F.col("psr"), 9).alias("p"))
    out = stats.holm(p, "p", ["g"])
    return out.select("g", "p", F.round("holm", 8).alias("holm"), F.round("bh", 8).alias("bh"))


@query(
    "drawdown_tuw",
    f"""WITH {RET_SQL}, e AS (SELECT g, day, round(sum(r) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING), 9) AS eq FROM ret), h AS (SELECT *, max(eq) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING) AS high FROM e),
        m AS (SELECT g, high, min(day) AS start, min(eq) AS low FROM h GROUP BY g, high), n AS (SELECT *, lead(start) OVER (PARTITION BY g ORDER BY high) - start AS under FROM m)
        SELECT g, start, round(high - low, 6) AS depth, under FROM n WHERE high - low > 0""",
)
def drawdown_tuw(spark, sf):
    """Drawdown below each high-water mark and the time under it."""
    return stats.drawdowns(returns(spark, sf), "g", "day", "r").select("g", "start", F.round("depth", 6).alias("depth"), "under")


@query(
    "max_drawdown",
    f"""WITH {RET_SQL}, e AS (SELECT g, day, r, sum(r) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq FROM ret), h AS (SELECT *, greatest(max(eq) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS high FROM e)
        SELECT g, round(max(high - eq), 6) AS dollars, round(max(1 - (1000 + eq) / (1000 + high)), 9) AS fraction FROM h GROUP BY g""",
)
def max_drawdown(spark, sf):
    """Greatest fall of cumulative profit, in dollars and as a share of an account of 1,000."""
    run = Window.partitionBy("g").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    e = returns(spark, sf).withColumn("eq", F.sum("r").over(run)).withColumn("high", F.greatest(F.max("eq").over(run), F.lit(0.0)))
    return e.groupBy("g").agg(F.round(F.max(F.col("high") - F.col("eq")), 6).alias("dollars"), F.round(F.max(1 - (1000 + F.col("eq")) / (1000 + F.col("high"))), 9).alias("fraction"))


def hhi_sql(cond):
    x = f"CASE WHEN {cond} THEN r END"
    return f"CASE WHEN count({x}) > 2 THEN (sum(r * r) FILTER ({cond}) / pow(sum(r) FILTER ({cond}), 2) - 1.0 / count({x})) / (1 - 1.0 / count({x})) END"


@query("hhi_concentration", f"WITH {RET_SQL} SELECT g, round({hhi_sql('r > 0')}, 9) AS hhi_gains, round({hhi_sql('r < 0')}, 9) AS hhi_losses FROM ret GROUP BY g")
def hhi_concentration(spark, sf):
    """Concentration of gains and of losses."""
    c = stats.concentration(returns(spark, sf), "g", "r")
    return c.select("g", F.round("hhi_gains", 9).alias("hhi_gains"), F.round("hhi_losses", 9).alias("hhi_losses"))


@query("run_length", f"WITH {EVENTS_SQL}, s AS (SELECT g, event_id, CASE WHEN kind IN ('purchase', 'signup') THEN 1 WHEN kind = 'error' THEN 0 ELSE -1 END AS s FROM ev), i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) - row_number() OVER (PARTITION BY g, s ORDER BY event_id) AS isl FROM s) SELECT event_id, CASE WHEN s = 0 THEN 0 ELSE row_number() OVER (PARTITION BY g, s, isl ORDER BY event_id) END AS run FROM i")
def run_length(spark, sf):
    """Length of the run of equal signs that ends at each event."""
    s = events(spark, sf).withColumn("s", F.when(F.col("kind").isin("purchase", "signup"), 1).when(F.col("kind") == "error", 0).otherwise(-1))
    return stats.runs(s, "g", ["event_id"], "s").select("event_id", "run")


@query("any_per_second", f"WITH {EVENTS_SQL} SELECT event_id, bool_or(kind = 'error') OVER (PARTITION BY ts // 3600) AS any_error FROM ev")
def any_per_second(spark, sf):
    """Whether any event of the same hour is an error."""
    return events(spark, sf).select("event_id", F.bool_or(F.col("kind") == "error").over(Window.partitionBy(F.floor(F.col("ts") / 3600))).alias("any_error"))


@query(
    "rank_correlations",
    f"""WITH {TRADES_SQL}, x AS (SELECT g, price, size, rank() OVER (PARTITION BY g ORDER BY price) + (count(*) OVER (PARTITION BY g, price) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY g ORDER BY size) + (count(*) OVER (PARTITION BY g, size) - 1) / 2.0 AS rs FROM trades)
        SELECT g, round(corr(price, size), 8) AS pearson, round(corr(rp, rs), 8) AS spearman FROM x GROUP BY g""",
)
def rank_correlations(spark, sf):
    """Pearson and Spearman correlations of price and size."""
    t = trades(spark, sf).withColumn("rp", stats.average_rank(F.col("price"), ["g"])).withColumn("rs", stats.average_rank(F.col("size"), ["g"]))
    return t.groupBy("g").agg(F.round(stats.safe_corr(F.col("price"), F.col("size")), 8).alias("pearson"), F.round(stats.safe_corr(F.col("rp"), F.col("rs")), 8).alias("spearman"))


BARS = f"{RANKED_SQL}, b AS (SELECT g, (rn - 1) // 20 AS bar, {BAR_SQL} FROM r GROUP BY g, bar), bars AS (SELECT * FROM b WHERE n_ticks = 20)"


def tick20(spark, sf):
    return bars.tick_bars(trades(spark, sf), "g", TAPE_ORDER, 20)


@query(
    "microstructure",
    f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER w AS dp, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY g ORDER BY bar))
        SELECT g, round(sum(abs(buy_volume - sell_volume)) / sum(buy_volume + sell_volume), 9) AS vpin, round(avg(abs(lr) / (vwap * volume)) FILTER (vwap * volume > 0) * 1e6, 8) AS amihud, round(regr_slope(dp, volume_imbalance), 7) AS kyle,
        round(sum(dp * volume_imbalance) / sum(volume_imbalance * volume_imbalance) FILTER (dp IS NOT NULL), 7) AS kyle_origin,
        round(sum(lr * sign(volume_imbalance) * sqrt(vwap * volume)) / sum(vwap * volume * abs(sign(volume_imbalance))) FILTER (lr IS NOT NULL), 9) AS hasbrouck,
        round(sqrt(avg(pow(ln(high / low), 2)) / (4 * ln(2))), 9) AS parkinson, round(avg(ln(high / low)) / sqrt(8 / pi()), 9) AS parkinson_abs FROM d GROUP BY g""",
)
def microstructure(spark, sf):
    """VPIN, Amihud, Kyle (with and without intercept), Hasbrouck and Parkinson estimates from tick bars."""
    w = Window.partitionBy("g").orderBy("bar")
    dp, lr = F.col("close") - F.lag("close").over(w), F.ln(F.col("close") / F.lag("close").over(w))
    d = tick20(spark, sf).withColumn("dp", dp).withColumn("lr", lr).withColumn("usd", F.col("vwap") * F.col("volume"))
    x, sgn = F.col("volume_imbalance"), F.signum("volume_imbalance")
    some = F.col("dp").isNotNull()
    hl = F.ln(F.col("high") / F.col("low"))
    return d.groupBy("g").agg(
        F.round(F.sum(F.abs(F.col("buy_volume") - F.col("sell_volume"))) / F.sum(F.col("buy_volume") + F.col("sell_volume")), 9).alias("vpin"),
        F.round(F.avg(F.when(F.col("usd") > 0, F.abs("lr") / F.col("usd"))) * 1e6, 8).alias("amihud"), F.round(F.regr_slope("dp", x), 7).alias("kyle"),
        F.round(F.sum(F.col("dp") * x) / F.sum(F.when(some, x * x)), 7).alias("kyle_origin"),
        F.round(F.sum(F.col("lr") * sgn * F.sqrt("usd")) / F.sum(F.when(some, F.col("usd") * F.abs(sgn))), 9).alias("hasbrouck"),
        F.round(F.sqrt(F.avg(hl * hl) / (4 * F.ln(F.lit(2.0)))), 9).alias("parkinson"), F.round(F.avg(hl) / F.sqrt(8 / F.pi()), 9).alias("parkinson_abs"),
    )


@query(
    "roll_spread",
    f"""WITH {TRADES_SQL}, d AS (SELECT *, price - lag(price) OVER w AS dp FROM trades WINDOW w AS (PARTITION BY g ORDER BY ts, l_orderkey, l_linenumber, l_partkey)),
        l AS (SELECT *, lag(dp) OVER (PARTITION BY g ORDER BY ts, l_orderkey, l_linenumber, l_partkey) AS dq FROM d) SELECT g, round(2 * sqrt(greatest(-covar_samp(dp, dq), 0)), 6) AS spread FROM l GROUP BY g""",
)
def roll_spread(spark, sf):
    """Spread from the covariance of successive price changes."""
    w = Window.partitionBy("g").orderBy(*TAPE_ORDER)
    d = trades(spark, sf).withColumn("dp", F.col("price") - F.lag("price").over(w)).withColumn("dq", F.lag("dp").over(w))
    return d.groupBy("g").agg(F.round(2 * F.sqrt(F.greatest(-F.covar_samp("dp", "dq"), F.lit(0.0))), 6).alias("spread"))


CS = "(3 - 2 * sqrt(2))"


@query(
    "corwin_schultz",
    f"""WITH {BARS}, h AS (SELECT g, bar, ln(high / low) AS hl, lag(ln(high / low)) OVER w AS hl0, ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)) AS span FROM bars WINDOW w AS (PARTITION BY g ORDER BY bar)),
        a AS (SELECT g, bar, hl * hl + hl0 * hl0 AS beta, span * span AS gamma FROM h WHERE hl0 IS NOT NULL), al AS (SELECT *, greatest((sqrt(2) - 1) * sqrt(beta) / {CS} - sqrt(gamma / {CS}), 0) AS alpha FROM a)
        SELECT g, bar, round(beta, 9) AS beta, round(gamma, 9) AS gamma, round(alpha, 8) AS alpha, round(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 8) AS spread,
        round(greatest((pow(2, -0.5) - 1) * sqrt(beta) / (sqrt(8 / pi()) * {CS}) + sqrt(gamma / (8 / pi() * {CS})), 0), 8) AS sigma FROM al""",
)
def corwin_schultz(spark, sf):
    """High-low spread and volatility of successive bars."""
    w = Window.partitionBy("g").orderBy("bar")
    k, root2 = 3 - 2 * 2**0.5, 2**0.5
    hl = F.ln(F.col("high") / F.col("low"))
    span = F.ln(F.greatest("high", F.lag("high").over(w)) / F.least("low", F.lag("low").over(w)))
    h = tick20(spark, sf).withColumn("hl", hl).withColumn("hl0", F.lag("hl").over(w)).withColumn("span", span).filter("hl0 is not null")
    a = h.select("g", "bar", (F.col("hl") ** 2 + F.col("hl0") ** 2).alias("beta"), (F.col("span") ** 2).alias("gamma"))
    a = a.withColumn("alpha", F.greatest((root2 - 1) * F.sqrt("beta") / k - F.sqrt(F.col("gamma") / k), F.lit(0.0)))
    e = F.exp("alpha")
    sigma = F.greatest((2**-0.5 - 1) * F.sqrt("beta") / (F.sqrt(8 / F.pi()) * k) + F.sqrt(F.col("gamma") / (8 / F.pi() * k)), F.lit(0.0))
    return a.select("g", "bar", F.round("beta", 9).alias("beta"), F.round("gamma", 9).alias("gamma"), F.round("alpha", 8).alias("alpha"), F.round(2 * (e - 1) / (1 + e), 8).alias("spread"), F.round(sigma, 8).alias("sigma"))


@query(
    "bulk_volume",
    f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER (PARTITION BY g ORDER BY bar) AS dp FROM bars), s AS (SELECT *, dp / stddev_samp(dp) OVER (PARTITION BY g) AS z FROM d) SELECT g, bar, round(volume * {norm_cdf_sql("z")}, 6) AS buy FROM s WHERE dp IS NOT NULL""",
)
def bulk_volume(spark, sf):
    """Buy volume of a bar from its standardised price change."""
    d = tick20(spark, sf).withColumn("dp", F.col("close") - F.lag("close").over(Window.partitionBy("g").orderBy("bar"))).withColumn("z", F.col("dp") / F.stddev_samp("dp").over(Window.partitionBy("g")))
    return d.filter("dp is not null").select("g", "bar", F.round(F.col("volume") * norm_cdf(F.col("z")), 6).alias("buy"))


@query(
    "vpin_buckets",
    f"""WITH {RANKED_SQL}, c AS (SELECT g, rn, size, CASE WHEN sign > 0 THEN size ELSE 0 END AS buy, sum(size) OVER (PARTITION BY g ORDER BY rn ROWS UNBOUNDED PRECEDING) AS hi FROM r), x AS (SELECT *, unnest(range((floor((hi - size) / 1000))::BIGINT, (ceil(hi / 1000))::BIGINT)) AS bucket FROM c),
        s AS (SELECT g, bucket, sum(greatest(least(hi, (bucket + 1) * 1000) - greatest(hi - size, bucket * 1000), 0)) AS vol, sum(greatest(least(hi, (bucket + 1) * 1000) - greatest(hi - size, bucket * 1000), 0) * buy / size) AS buy FROM x GROUP BY ALL),
        f AS (SELECT * FROM s WHERE vol >= 1000 - 1e-9), v AS (SELECT g, bucket, sum(abs(2 * buy - vol)) OVER w AS imb, sum(vol) OVER w AS tot, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY g ORDER BY bucket ROWS 4 PRECEDING))
        SELECT g, bucket, round(imb / tot, 9) AS vpin FROM v WHERE n = 5""",
)
def vpin_buckets(spark, sf):
    """Flow toxicity over the last five buckets of 1,000 units; trades are split across bucket borders in closed form."""
    w = Window.partitionBy("g").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    c = bars.numbered(trades(spark, sf), "g", TAPE_ORDER).withColumn("hi", F.sum("size").over(w)).withColumn("lo", F.col("hi") - F.col("size"))
    x = c.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / 1000), F.ceil(F.col("hi") / 1000) - 1)))
    part = F.greatest(F.least("hi", (F.col("bucket") + 1) * 1000) - F.greatest("lo", F.col("bucket") * 1000), F.lit(0.0))
    s = x.groupBy("g", "bucket").agg(F.sum(part).alias("vol"), F.sum(F.when(F.col("sign") > 0, part).otherwise(0.0)).alias("buy")).filter(F.col("vol") >= 1000 - 1e-9)
    five = Window.partitionBy("g").orderBy("bucket").rowsBetween(-4, 0)
    v = s.select("g", "bucket", (F.sum(F.abs(2 * F.col("buy") - F.col("vol"))).over(five) / F.sum("vol").over(five)).alias("vpin"), F.count(F.lit(1)).over(five).alias("n"))
    return v.filter("n = 5").select("g", "bucket", F.round("vpin", 9).alias("vpin"))


@query(
    "trailing_windows",
    f"""WITH {EVENTS_SQL}, w AS (SELECT event_id, g, ts, value, sum(value) OVER (PARTITION BY g ORDER BY ts RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS s2d, count(*) OVER (PARTITION BY g ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n7d,
        CASE WHEN count(*) OVER (PARTITION BY g ORDER BY event_id ROWS 9 PRECEDING) = 10 THEN avg(value * value) OVER (PARTITION BY g ORDER BY event_id ROWS 9 PRECEDING) END AS back10,
        CASE WHEN count(*) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10 THEN avg(value * value) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) END AS ahead10 FROM ev)
        SELECT event_id, round(s2d, 6) AS s2d, n7d, round(back10, 5) AS back10, round(ahead10, 5) AS ahead10 FROM w""",
)
def trailing_windows(spark, sf):
    """Trailing sums and counts by time, and mean squares over the last and next ten events."""
    e = events(spark, sf)
    by_ts, by_id = Window.partitionBy("g").orderBy("ts"), Window.partitionBy("g").orderBy("event_id")
    full = lambda w: F.when(F.count(F.lit(1)).over(w) == 10, F.avg(F.col("value") * F.col("value")).over(w))
    return e.select(
        "event_id", F.round(F.sum("value").over(by_ts.rangeBetween(-172800, 0)), 6).alias("s2d"), F.count(F.lit(1)).over(by_ts.rangeBetween(-604800, 0)).alias("n7d"),
        F.round(full(by_id.rowsBetween(-9, 0)), 5).alias("back10"), F.round(full(by_id.rowsBetween(1, 10)), 5).alias("ahead10"),
    )


@query(
    "seasonality_profile",
    f"""WITH {EVENTS_SQL}, p AS (SELECT ts // 86400 AS day, (ts % 86400) // 21600 AS cell, avg(value) AS m, count(*) AS n FROM ev GROUP BY ALL)
        SELECT day, round(max(CASE WHEN cell = 0 AND n >= 3 THEN m END), 6) AS c0, round(max(CASE WHEN cell = 1 AND n >= 3 THEN m END), 6) AS c1, round(max(CASE WHEN cell = 2 AND n >= 3 THEN m END), 6) AS c2, round(max(CASE WHEN cell = 3 AND n >= 3 THEN m END), 6) AS c3 FROM p GROUP BY day""",
)
def seasonality_profile(spark, sf):
    """Means by day and quarter of the day, pivoted; cells under three events are null."""
    e = events(spark, sf).select(F.floor(F.col("ts") / 86400).alias("day"), F.floor(F.col("ts") % 86400 / 21600).alias("cell"), "value")
    p = e.groupBy("day").pivot("cell", [0, 1, 2, 3]).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return p.select("day", *[F.round(F.when(F.col(f"{c}_n") >= 3, F.col(f"{c}_m")), 6).alias(f"c{c}") for c in range(4)])


@query(
    "variance_inflation",
    f"""WITH {EVENTS_SQL}, b AS (SELECT h, ts // (3600 * h) AS block, avg(value) AS m, count(*) AS n FROM ev, (VALUES (1), (6), (24), (72)) t(h) GROUP BY ALL), v AS (SELECT var_samp(value) AS v FROM ev),
        i AS (SELECT h, var_samp(m) * avg(n) / max(v) AS vif FROM b, v GROUP BY h) SELECT h AS hours, round(vif, 7) AS vif, h = (SELECT min(h) FROM i WHERE vif >= 0.95 * (SELECT max(vif) FROM i)) AS chosen FROM i""",
)
def variance_inflation(spark, sf):
    """Variance of block means against independence, by block length, and the shortest block near the greatest."""
    e = events(spark, sf).select("ts", "value")
    blocks = e.withColumn("hours", F.explode(F.array(*map(F.lit, (1, 6, 24, 72))))).groupBy("hours", F.floor(F.col("ts") / (3600 * F.col("hours"))).alias("block")).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    total = e.agg(F.var_samp("value").alias("v"))  # one row
    i = blocks.groupBy("hours").agg(F.var_samp("m").alias("vm"), F.avg("n").alias("n")).crossJoin(F.broadcast(total)).withColumn("vif", F.col("vm") * F.col("n") / F.col("v")).withColumn("one", F.lit(1))
    every = Window.partitionBy("one")
    near = i.withColumn("ok", F.col("vif") >= 0.95 * F.max("vif").over(every))
    return near.select("hours", F.round("vif", 7).alias("vif"), (F.col("hours") == F.min(F.when(F.col("ok"), F.col("hours"))).over(every)).alias("chosen"))


S = 6
COMBOS = list(combinations(range(S), S // 2))
COMBO_VALUES = ", ".join(f"({c}, {b}, {b in chosen})" for c, chosen in enumerate(COMBOS) for b in range(S))


@query(
    "pbo_cscv",
    f"""WITH {RET_SQL}, b AS (SELECT g, (day // 30) % {S} AS block, sum(r) AS s, sum(r * r) AS q, count(*) AS n FROM ret GROUP BY ALL), c(combo, block, ins) AS (VALUES {COMBO_VALUES}),
        h AS (SELECT combo, g, ins, sum(s) / sum(n) AS m, (sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1) AS v FROM b JOIN c USING (block) GROUP BY ALL), sr AS (SELECT combo, g, ins, CASE WHEN v > 0 THEN m / sqrt(v) ELSE 0 END AS sr FROM h),
        best AS (SELECT combo, arg_max(g, (sr, -g)) AS g FROM sr WHERE ins GROUP BY combo), rk AS (SELECT combo, g, rank() OVER (PARTITION BY combo ORDER BY sr) + (count(*) OVER (PARTITION BY combo, sr) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY combo) AS n FROM sr WHERE NOT ins)
        SELECT combo, g AS winner, round(ln((rk / (n + 1)) / (1 - rk / (n + 1))), 8) AS logit FROM best JOIN rk USING (combo, g)""",
)
def pbo_cscv(spark, sf):
    """Overfitting by symmetric cross-validation: the out-of-sample rank of each in-sample winner over all half splits."""
    r = returns(spark, sf)
    b = r.groupBy("g", (F.floor(F.col("day") / 30) % S).alias("block")).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count(F.lit(1)).alias("n"))
    c = F.broadcast(spark.createDataFrame([(i, k, k in chosen) for i, chosen in enumerate(COMBOS) for k in range(S)], "combo int, block long, ins boolean"))  # combinations times blocks
    h = b.join(c, "block").groupBy("combo", "g", "ins").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    v = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sr = h.select("combo", "g", "ins", F.when(v > 0, F.col("s") / F.col("n") / F.sqrt(F.when(v > 0, v))).otherwise(0.0).alias("sr"))
    best = sr.filter("ins").groupBy("combo").agg(F.max_by("g", F.struct("sr", -F.col("g"))).alias("g"))
    out = sr.filter("not ins").withColumn("rk", stats.average_rank(F.col("sr"), ["combo"])).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("combo")))
    w = F.col("rk") / (F.col("n") + 1)
    return best.join(out, ["combo", "g"]).select("combo", F.col("g").alias("winner"), F.round(F.ln(w / (1 - w)), 8).alias("logit"))


@query(
    "effective_trials",
    f"""WITH {RET_SQL}, m AS (SELECT g, day // 30 AS mo, sum(r) AS r FROM ret GROUP BY ALL), f AS (SELECT gs.g, ms.mo, coalesce(r, 0) AS r FROM (SELECT DISTINCT g FROM m) gs CROSS JOIN (SELECT DISTINCT mo FROM m) ms LEFT JOIN m ON m.g = gs.g AND m.mo = ms.mo),
        s AS (SELECT g FROM f GROUP BY g HAVING stddev_pop(r) > 1e-9), c AS (SELECT a.g AS a, b.g AS b, corr(a.r, b.r) AS c FROM f a JOIN f b USING (mo) WHERE a.g IN (FROM s) AND b.g IN (FROM s) GROUP BY ALL)
        SELECT round(sqrt(count(*)) * sqrt(count(*)) / sum(c * c), 7) AS effective, round(avg(c) FILTER (a < b), 8) AS mean_corr FROM c""",
)
def effective_trials(spark, sf):
    """Participation ratio and mean correlation of all suppliers' monthly profits; a month without trades earns nothing."""
    m = returns(spark, sf).groupBy("g", F.floor(F.col("day") / 30).alias("t")).agg(F.sum("r").alias("r"))
    return stats.participation(m, "g", "t", "r").select(F.round("effective", 7).alias("effective"), F.round("mean_corr", 8).alias("mean_corr"))


@query(
    "dependence_micro",
    f"""WITH {EVENTS_SQL}, l AS (SELECT *, lag(value) OVER w AS prev, ts - lag(ts) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY g ORDER BY event_id)) SELECT g, round(corr(value, prev), 8) AS lag1, round(stddev_pop(gap) / avg(gap), 8) AS gap_cv,
        round(sum(value * prev) / sum(prev * prev), 8) AS ou_phi, round(regr_slope(value, prev), 8) AS ar_slope, round(regr_intercept(value, prev), 6) AS ar_intercept FROM l WHERE prev IS NOT NULL GROUP BY g""",
)
def dependence_micro(spark, sf):
    """First autocorrelation, variation of gaps, and AR(1) fits with and without intercept."""
    w = Window.partitionBy("g").orderBy("event_id")
    e = events(spark, sf).withColumn("prev", F.lag("value").over(w)).withColumn("gap", F.col("ts") - F.lag("ts").over(w)).filter("prev is not null")
    v, p = F.col("value"), F.col("prev")
    return e.groupBy("g").agg(
        F.round(stats.safe_corr(v, p), 8).alias("lag1"), F.round(F.stddev_pop("gap") / F.avg("gap"), 8).alias("gap_cv"), F.round(F.sum(v * p) / F.sum(p * p), 8).alias("ou_phi"),
        F.round(F.regr_slope("value", "prev"), 8).alias("ar_slope"), F.round(F.regr_intercept("value", "prev"), 6).alias("ar_intercept"),
    )


@query(
    "wallet_concentration",
    """WITH w AS (SELECT l_suppkey AS g, l_orderkey % 50 AS wallet, sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS flow FROM lineitem GROUP BY ALL)
        SELECT g, round(max(q) / sum(q), 9) AS top_share, round(sum(q * q) / (sum(q) * sum(q)), 9) AS hhi, arg_max(flow, (q, -wallet)) AS top_flow FROM w GROUP BY g""",
)
def wallet_concentration(spark, sf):
    """Share, concentration and net flow of the busiest wallet of each supplier."""
    li = read(spark, sf, "lineitem")
    w = li.groupBy(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") % 50).alias("wallet")).agg(F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("flow"))
    return w.groupBy("g").agg(F.round(F.max("q") / F.sum("q"), 9).alias("top_share"), F.round(F.sum(F.col("q") * F.col("q")) / (F.sum("q") * F.sum("q")), 9).alias("hhi"), F.max_by("flow", F.struct("q", -F.col("wallet"))).alias("top_flow"))
