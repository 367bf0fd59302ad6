"""Queries over the scalar kits: fees, sizes, attribution, sensitivities, strategy risk, calendars, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight.functions import betting as bt
from tidelight.functions import pricing as pr
from tidelight.functions.distributions import norm_ppf, norm_ppf_sql
from tidelight.functions.maths import expected_abs_normal, norm_cdf, norm_cdf_sql
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, events, read

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
KEYS = ", ".join(KEY)
#: Rows with a price and a probability in (0, 1), a size, and an outcome.
BETS_SQL = f"""bets AS (SELECT {KEYS}, l_tax * 10 + 0.1 AS price, l_discount * 8 + 0.1 AS prob, l_quantity AS shares,
    CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS win, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS side FROM lineitem)"""


def bets(spark, sf):
    return read(spark, sf, "lineitem").select(
        *KEY,
        (F.col("l_tax") * 10 + 0.1).alias("price"),
        (F.col("l_discount") * 8 + 0.1).alias("prob"),
        F.col("l_quantity").alias("shares"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("win"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("side"),
    )


def out(df, keys, digits=9, **cols):
    return df.select(*keys, *[F.round(v, digits).alias(k) for k, v in cols.items()])


@query(
    "fees",
    f"""WITH {BETS_SQL} SELECT {KEYS}, round(shares * sqrt(greatest(price * (1 - price), 0)), 9) AS risk_usd,
        round(CASE WHEN shares * 0.07 * price * (1 - price) <= 0 THEN 0 ELSE greatest(round_even(shares * 0.07 * price * (1 - price), 5), 1e-5) END, 5) AS taker_fee,
        round(0.07 * price * (1 - price), 9) AS fee_per_share, round(0.2 * shares * 0.07 * price * (1 - price), 9) AS maker_rebate, round(price + 0.07 * price * (1 - price), 9) AS cost,
        round((1.07 - sqrt(1.07 * 1.07 - 0.28 * (price + 0.07 * price * (1 - price)))) / 0.14, 9) AS price_again,
        round(win - price - 0.07 * price * (1 - price), 9) AS binary_pnl, round(100 / (price + 0.07 * price * (1 - price)) * win - 100, 9) AS bet_pnl FROM bets""",
)
def fees(spark, sf):
    """Risk dollars, taker and maker fees, all-in cost and its inverse, and the profit of a binary bet."""
    p, q, cost = F.col("price"), F.col("shares"), bt.cost_of(F.col("price"))
    return out(
        bets(spark, sf), KEY, risk_usd=bt.risk_usd(q, p), taker_fee=bt.taker_fee(q, p), fee_per_share=bt.fee_per_share(p), maker_rebate=bt.maker_rebate(q, p), cost=cost,
        price_again=bt.price_from_cost(cost), binary_pnl=bt.binary_pnl(F.col("win"), p), bet_pnl=bt.bet_pnl(F.lit(100.0), p, F.col("win"))[2],
    )


Z1, Z2 = "((prob - 0.5) / sqrt(prob * (1 - prob)))", "((prob - price) / sqrt(prob * (1 - prob)))"


@query(
    "bet_sizes",
    f"""WITH {BETS_SQL} SELECT {KEYS}, round(side * (2 * {norm_cdf_sql(Z1)} - 1), 9) AS from_prob, round(least(greatest(2 * {norm_cdf_sql(Z2)} - 1, 0), 1), 9) AS against_price,
        round(CASE WHEN price < 1 THEN greatest((prob - price) / (1 - price), 0) ELSE 0 END, 9) AS kelly,
        round(least(greatest(round_even((prob - price) / 0.2, 0) * 0.2, -1), 1), 9) AS discrete, round((prob - price) / sqrt(0.1 + (prob - price) * (prob - price)), 9) AS sigmoid,
        round(sign(prob - price) * pow(abs(prob - price), 2), 9) AS power, trunc((prob - price) / sqrt(0.1 + (prob - price) * (prob - price)) * 100)::INT AS target,
        round(prob - 0.3 * sqrt(0.1 / (1 - 0.3 * 0.3)), 9) AS inverse_price, round(prob * prob * (1 / 0.09 - 1), 9) AS width FROM bets""",
)
def bet_sizes(spark, sf):
    """Sizes from probabilities, against prices, by Kelly, discretised, and by the dynamic forms with their inverses."""
    p, a, w = F.col("prob"), F.col("price"), F.lit(0.1)
    df = bets(spark, sf).withColumn("target", bt.target_position(w, p, a, 100))
    return out(
        df, [*KEY, "target"], from_prob=bt.size_from_prob(p, 2, F.col("side")), against_price=bt.size_vs_price(p, a), kelly=bt.kelly(p, a), discrete=bt.discrete_size(p - a, 0.2),
        sigmoid=bt.dynamic_size(w, p - a), power=bt.dynamic_size(F.lit(2.0), p - a, "power"), inverse_price=bt.inverse_price(p, w, F.lit(0.3)), width=bt.calibrate(p, F.lit(0.3)),
    )


@query(
    "limit_price",
    f"""WITH {BETS_SQL}, t AS (SELECT *, trunc((prob - price) / sqrt(0.1 + (prob - price) * (prob - price)) * 20)::INT AS target FROM bets),
        u AS (SELECT {KEYS}, target, prob, unnest(CASE WHEN target > 2 THEN range(3, target + 1) WHEN target < 2 THEN range(target, 2) ELSE [] END) AS j FROM t)
        SELECT {KEYS}, target, round(avg(prob - j / 20.0 * sqrt(0.1 / (1 - (j / 20.0) * (j / 20.0)))), 9) AS limit_price FROM u GROUP BY ALL""",
)
def limit_price(spark, sf):
    """Breakeven limit for moving from 2 units to the target position."""
    p, w = F.col("prob"), F.lit(0.1)
    df = bets(spark, sf).withColumn("target", bt.target_position(w, p, F.col("price"), 20)).filter("target <> 2")
    return out(df, [*KEY, "target"], limit_price=bt.limit_price(F.col("target"), F.lit(2), p, w, 20))


@query(
    "pq_attribution",
    f"""WITH {BETS_SQL}, f AS (SELECT {KEYS}, shares, CASE WHEN side = 1 THEN win ELSE 1 - win END AS y, price, 0.07 * price * (1 - price) AS fee,
        CASE WHEN side = 1 THEN prob ELSE 1 - prob END AS p, CASE WHEN side = 1 THEN 0.5 ELSE 1 - 0.5 END AS q FROM bets)
        SELECT {KEYS}, round((y - p) * shares, 9) AS luck, round((p - q) * shares, 9) AS model_edge, round((q - price) * shares, 9) AS market_mispricing, round(-fee * shares, 9) AS cost,
        round((y - price - fee) * shares, 9) AS total FROM f""",
)
def pq_attribution(spark, sf):
    """Profit of each fill in dollars, split into luck, model edge, mispricing and cost; the Down side is flipped."""
    up = F.col("side") == 1
    flip = lambda c: F.when(up, c).otherwise(1 - c)
    parts = bt.pq_decomposition(flip(F.col("win")), F.col("price"), bt.fee_per_share(F.col("price")), flip(F.col("prob")), F.lit(0.5))
    return out(bets(spark, sf), KEY, **{k: v * F.col("shares") for k, v in parts.items()})


@query(
    "pair_arbitrage",
    f"""WITH {EVENTS_SQL}, b AS (SELECT g, ts // 86400 AS day, max(CASE WHEN kind = 'view' THEN value END) / 500 AS bu, min(CASE WHEN kind = 'click' THEN value END) / 500 AS au,
        max(CASE WHEN kind = 'signup' THEN value END) / 500 AS bd, min(CASE WHEN kind = 'error' THEN value END) / 500 AS ad, min(k) AS size FROM ev GROUP BY 1, 2)
        SELECT g, day, round(1 - au - ad - 0.07 * au * (1 - au) - 0.07 * ad * (1 - ad), 9) AS buy_edge, round(bu + bd - 1 - 0.07 * bu * (1 - bu) - 0.07 * bd * (1 - bd), 9) AS sell_edge,
        CASE WHEN au IS NULL OR ad IS NULL THEN 0 ELSE size END AS buy_size FROM b""",
)
def pair_arbitrage(spark, sf):
    """Edges of buying or selling both sides at the best prices of two books; a missing leg gives null."""
    side = lambda k, f: f(F.when(F.col("kind") == k, F.col("value"))) / 500
    b = events(spark, sf).groupBy("g", F.floor(F.col("ts") / 86400).alias("day")).agg(
        side("view", F.max).alias("bu"), side("click", F.min).alias("au"), side("signup", F.max).alias("bd"), side("error", F.min).alias("ad"), F.min("k").alias("size")
    )
    au, ad, bu, bd = (F.col(c) for c in ("au", "ad", "bu", "bd"))
    buy = 1 - au - ad - bt.fee_per_share(au) - bt.fee_per_share(ad)
    sell = bu + bd - 1 - bt.fee_per_share(bu) - bt.fee_per_share(bd)
    return b.select("g", "day", F.round(buy, 9).alias("buy_edge"), F.round(sell, 9).alias("sell_edge"), F.when(au.isNull() | ad.isNull(), 0).otherwise(F.col("size")).alias("buy_size"))


STATE_SQL = f"""{EVENTS_SQL}, s AS (SELECT event_id, (us // 1000000) % 300 AS t, (value - 250) / 50000 AS m, 1e-4 * (1 + k / 100.0) AS sigma, 40000 + value AS s FROM ev),
    u AS (SELECT *, CASE WHEN 300 - t >= 60 THEN 300 - t - 60 + 61 * 121 / 360.0 WHEN 300 - t > 0 THEN (300 - t) * (301 - t) * (601 - 2 * t) / 21600.0 ELSE 0 END AS units,
        CASE WHEN 299 - t >= 60 THEN 299 - t - 60 + 61 * 121 / 360.0 WHEN 299 - t > 0 THEN (299 - t) * (300 - t) * (599 - 2 * t) / 21600.0 ELSE 0 END AS units1,
        least(greatest((300 - t) / 60.0, 0), 1) AS a FROM s),
    z AS (SELECT *, sqrt(sigma * sigma * units + 1e-4 * 1e-4) AS sd, sqrt(sigma * sigma * units1 + 1e-4 * 1e-4) AS sd1 FROM u),
    d AS (SELECT *, m / sd AS d, m / sd1 AS d1, exp(-(m / sd) * (m / sd) / 2) / sqrt(2 * pi()) AS pdf FROM z)"""


@query(
    "fair_greeks",
    f"""WITH {STATE_SQL} SELECT event_id, round(units, 6) AS variance_units, round(CASE WHEN 300 - t >= 60 THEN 300 - t - 60 + 30.5 ELSE (300 - t) * (301 - t) / 120.0 END, 6) AS drift_units,
        round({norm_cdf_sql("d")}, 9) AS fair, round(pdf * a / sd, 4) AS delta_log, round(pdf * a / sd / s, 8) AS delta_usd, round(-d * pdf * a * a / (sd * sd), 0) AS gamma_log,
        round((-d * pdf * a * a / (sd * sd) - pdf * a / sd) / (s * s), 8) AS gamma_usd, round(-d * pdf * sigma * units / (sd * sd), 2) AS vega, round(-d * pdf * 1e-4 / (sd * sd), 2) AS basis_sens,
        round({norm_cdf_sql("d1")} - {norm_cdf_sql("d")}, 9) AS theta FROM d""",
)
def fair_greeks(spark, sf):
    """Fair price of an averaged binary at an event's second, and its sensitivities."""
    t = F.floor(F.col("us") / 1000000) % 300
    s = events(spark, sf).select("event_id", t.alias("t"), ((F.col("value") - 250) / 50000).alias("m"), (1e-4 * (1 + F.col("k") / 100)).alias("sigma"), (40000 + F.col("value")).alias("s"))
    m, sigma, t = F.col("m"), F.col("sigma"), F.col("t")
    g = pr.greeks(m, sigma, t, F.col("s"), 1e-4)
    digits = {"delta_log": 4, "delta_usd": 8, "gamma_log": 0, "gamma_usd": 8, "vega": 2, "basis_sens": 2, "theta": 9}
    u = pr.variance_units(t)
    return s.select(
        "event_id", F.round(u, 6).alias("variance_units"), F.round(pr.drift_units(t), 6).alias("drift_units"), F.round(pr.probability(m, sigma, u, 1e-4), 9).alias("fair"),
        *[F.round(g[k], n).alias(k) for k, n in digits.items()],
    )


UNITS_SQL = "CASE WHEN 300 - t >= 60 THEN 300 - t - 60 + 61 * 121 / 360.0 WHEN 300 - t > 0 THEN (300 - t) * (301 - t) * (601 - 2 * t) / 21600.0 ELSE 0 END"


@query(
    "implied_sigma",
    f"""WITH {EVENTS_SQL}, e AS (SELECT event_id, floor(us / 1000000)::BIGINT % 300 AS t, (value - 250) / 50000 AS m, k / 101.0::DOUBLE AS p FROM ev), x AS (SELECT *, {norm_ppf_sql("p")} AS z, {UNITS_SQL} AS u FROM e)
        SELECT event_id, round(CASE WHEN z <> 0 AND sign(m) = sign(z) AND u > 0 AND (m / z) * (m / z) - 1e-8 >= 0 THEN sqrt((m / z) * (m / z) - 1e-8) / sqrt(u) END, 9) AS implied_sigma, round(z * sqrt(1e-8 * u + 1e-8) - m, 9) AS implied_mean_shift FROM x""",
)
def implied_sigma(spark, sf):
    """The volatility and the shift of the mean that a market price implies; both invert the normal distribution."""
    t = F.floor(F.col("us") / 1000000) % 300
    s = events(spark, sf).select("event_id", pr.variance_units(t).alias("u"), ((F.col("value") - 250) / 50000).alias("m"), norm_ppf(F.col("k") / 101.0).alias("z"))
    z, m, u = F.col("z"), F.col("m"), F.col("u")
    ratio = F.try_divide(m, z)
    variance = ratio * ratio - 1e-8
    ok = (z != 0) & (F.signum(m) == F.signum(z)) & (u > 0) & (variance >= 0)
    shift = z * F.sqrt(1e-8 * u + 1e-8) - m
    return s.select("event_id", F.round(F.when(ok, F.sqrt(F.when(ok, variance)) / F.sqrt(F.when(ok, u))), 9).alias("implied_sigma"), F.round(shift, 9).alias("implied_mean_shift"))


@query(
    "strategy_risk_formulas",
    f"""WITH {BETS_SQL}, x AS (SELECT {KEYS}, prob, 250 + shares AS n, price AS up, -prob / 2 AS down FROM bets), y AS (SELECT *,
        (n + 4) * (up - down) * (up - down) AS qa, (2 * n * down - 4 * (up - down)) * (up - down) AS qb, n * down * down AS qc, (up - down) * prob + down AS mean FROM x)
        SELECT {KEYS}, round((2 * prob - 1) * sqrt(n) / (2 * sqrt(prob * (1 - prob))), 9) AS symmetric, round(mean * sqrt(n) / ((up - down) * sqrt(prob * (1 - prob))), 9) AS asymmetric,
        round((-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), 9) AS implied_precision,
        round(CASE WHEN sign(mean) = 1 THEN 4 * (up - down) * (up - down) * prob * (1 - prob) / (mean * mean) END, 3) AS implied_frequency FROM y""",
)
def strategy_risk_formulas(spark, sf):
    """Sharpe ratios of symmetric and asymmetric bets, and the precision and frequency that a target implies."""
    x = bets(spark, sf).select(*KEY, "prob", (250 + F.col("shares")).alias("n"), F.col("price").alias("up"), (-F.col("prob") / 2).alias("down"))
    p, n, up, down = (F.col(c) for c in ("prob", "n", "up", "down"))
    return x.select(
        *KEY, F.round(bt.sharpe_symmetric(p, n), 9).alias("symmetric"), F.round(bt.sharpe_asymmetric(p, n, up, down), 9).alias("asymmetric"),
        F.round(bt.implied_precision(down, up, n, 2.0), 9).alias("implied_precision"), F.round(bt.implied_frequency(down, up, p, 2.0), 3).alias("implied_frequency"),
    )


@query(
    "ensemble_formulas",
    """SELECT p_partkey, round(p_retailprice * p_retailprice * (0.3 + 0.7 / p_size), 6) AS bagged_variance, round(0.6 / (0.1 * 0.1), 9) AS estimators,
        round(1 - (SELECT sum(exp(lgamma(p_size + 1.0) - lgamma(j + 1.0) - lgamma(p_size - j + 1.0) + j * ln(0.6) + (p_size - j) * ln(0.4))) FROM unnest(range(0, p_size // 2 + 1)) AS t(j)), 9) AS accuracy,
        round(-ln(2) / ln(p_size / 51.0), 9) AS half_life, round(pow(2, -1.0 / p_size), 9) AS phi, round(0.5 * ln(2 * pi() * exp(1) * p_size * p_size), 9) AS entropy,
        round(p_size::DOUBLE, 6) AS sigma_again, round(-0.5 * ln(1 - (p_size / 51.0) * (p_size / 51.0)), 9) AS mutual FROM part""",
)
def ensemble_formulas(spark, sf):
    """Variance and accuracy of averaged estimators, half-lives, and Gaussian entropies."""
    size = F.col("p_size")
    return out(
        read(spark, sf, "part"), ["p_partkey"], bagged_variance=bt.bagged_variance(F.col("p_retailprice"), F.lit(0.3), size), estimators=bt.estimators_for_accuracy(F.lit(0.6)),
        accuracy=bt.bagging_accuracy(size, F.lit(0.6)), half_life=bt.half_life(size / 51), phi=bt.phi_from_half_life(size), entropy=bt.gaussian_entropy(size),
        sigma_again=bt.entropy_implied_sigma(bt.gaussian_entropy(size)), mutual=bt.gaussian_mutual_information(size / 51),
    ).withColumn("bagged_variance", F.round("bagged_variance", 6)).withColumn("sigma_again", F.round("sigma_again", 6))


@query(
    "calendar_parts",
    f"""WITH {EVENTS_SQL}, x AS (SELECT event_id, ts FROM ev) SELECT event_id, ((ts + 28800) // 3600) % 24 AS local_hour, (ts + 28800) // 86400 AS local_day,
        ((ts // 86400) + 3) % 7 AS weekday, (ts // 86400 + 3) // 7 AS iso_week, ts - ts % 300 AS window_start, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_name,
        strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, (ts % 300) BETWEEN 0 AND 299 AS in_window FROM x""",
)
def calendar_parts(spark, sf):
    """Hour, day, weekday and week at an offset, the five-minute window, and UTC text of a second."""
    ts = F.col("ts")
    t = F.timestamp_seconds(ts)
    return events(spark, sf).select(
        "event_id", F.pmod(F.floor((ts + 28800) / 3600), F.lit(24)).alias("local_hour"), F.floor((ts + 28800) / 86400).alias("local_day"), F.pmod(F.floor(ts / 86400) + 3, F.lit(7)).alias("weekday"),
        F.floor((F.floor(ts / 86400) + 3) / 7).alias("iso_week"), (ts - ts % 300).alias("window_start"), F.date_format(t, "yyyy-MM-dd").alias("day_name"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), (ts % 300).between(0, 299).alias("in_window"),
    )


@query(
    "round_lots",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, abs(l_quantity - round_even(l_quantity, 0)) < 1e-6 AND l_quantity % 10 < 1e-6 AS round_size,
        abs(l_extendedprice / l_quantity * 0.1 - round_even(l_extendedprice / l_quantity * 0.1, 0)) < 1e-6 AS round_price, concat_ws('|', l_orderkey, l_returnflag, l_linestatus) AS wallet,
        sha256(concat_ws('|', l_orderkey, l_returnflag)) AS digest FROM lineitem""",
)
def round_lots(spark, sf):
    """Round-lot predicates within a tolerance, a composite key and its digest."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity") * 0.1
    return read(spark, sf, "lineitem").select(
        *KEY, ((F.abs(q - F.bround(q)) < 1e-6) & (q % 10 < 1e-6)).alias("round_size"), (F.abs(p - F.bround(p)) < 1e-6).alias("round_price"),
        F.concat_ws("|", "l_orderkey", "l_returnflag", "l_linestatus").alias("wallet"), F.sha2(F.concat_ws("|", "l_orderkey", "l_returnflag"), 256).alias("digest"),
    )


@query(
    "exact_ticks",
    """SELECT event_id, (value::DECIMAL(18, 4) * 10000)::BIGINT AS ticks, round_even(value::DECIMAL(18, 4) * 100, 0)::BIGINT AS cents, value = value::DECIMAL(18, 2)::DOUBLE AS is_cent FROM events""",
)
def exact_ticks(spark, sf):
    """Prices as integer ticks, exact in decimals."""
    v = F.col("value").cast("decimal(18,4)")
    return read(spark, sf, "events").select("event_id", (v * 10000).cast("long").alias("ticks"), F.bround(v * 100).cast("long").alias("cents"), (F.col("value") == F.col("value").cast("decimal(18,2)").cast("double")).alias("is_cent"))


@query(
    "settlement_rules",
    """WITH r AS (SELECT doc_id, regexp_extract(text, '([0-9]+)', 1) AS n FROM documents) SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' THEN 30 WHEN d.lang = 'en' THEN 60 ELSE 1 END AS rule,
        nullif(n, '') AS first_number, length(text) AS n_chars_again FROM documents d JOIN r USING (doc_id)""",
)
def settlement_rules(spark, sf):
    """A rule read from text: a pattern, else a flag, else a default."""
    return read(spark, sf, "documents").select(
        "doc_id", F.when(F.lower("text").contains("license"), 30).when(F.col("lang") == "en", 60).otherwise(1).alias("rule"),
        F.expr("nullif(regexp_extract(text, '([0-9]+)', 1), '')").alias("first_number"), F.length("text").cast("long").alias("n_chars_again"),
    )


@query("normal_moments", f"""SELECT p_partkey, round({norm_cdf_sql("((p_size - 25) / 10.0)")}, 9) AS cdf, round(CASE WHEN p_size = 0 THEN 0 ELSE p_size * sqrt(2 / pi()) * exp(-(10.0 / p_size) * (10.0 / p_size) / 2) + 10 * (2 * {norm_cdf_sql("(10.0 / p_size)")} - 1) END, 6) AS expected_abs FROM part""")
def normal_moments(spark, sf):
    """The normal distribution function and the mean absolute value of a normal variable."""
    s = F.col("p_size")
    return read(spark, sf, "part").select("p_partkey", F.round(norm_cdf((s - 25) / 10), 9).alias("cdf"), F.round(expected_abs_normal(F.lit(10.0), s.cast("double")), 6).alias("expected_abs"))


@query(
    "quote_features",
    f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, floor(value)::BIGINT AS bid, floor(value)::BIGINT + 1 + k % 3 AS ask, 1 + k AS bs, 1 + event_id % 7 AS az, event_id % 11 AS age FROM ev)
        SELECT event_id, CASE WHEN age > 8 THEN 'STALE' WHEN bid >= ask THEN 'CROSSED' ELSE 'OK' END AS status, ask - bid AS spread, round((bid + ask) / 2.0, 6) AS mid,
        round((bs - az) / (bs + az)::DOUBLE, 9) AS imbalance, round((bid * az + ask * bs) / (bs + az)::DOUBLE, 9) AS weighted_mid FROM q""",
)
def quote_features(spark, sf):
    """Spread, midpoint, imbalance and weighted midpoint of a quote, with its status."""
    e = events(spark, sf)
    bid = F.floor("value")
    q = e.select("event_id", bid.alias("bid"), (bid + 1 + F.col("k") % 3).alias("ask"), (1 + F.col("k")).alias("bs"), (1 + F.col("event_id") % 7).alias("az"), (F.col("event_id") % 11).alias("age"))
    bid, ask, bs, az = (F.col(c) for c in ("bid", "ask", "bs", "az"))
    return q.select(
        "event_id", F.when(F.col("age") > 8, "STALE").when(bid >= ask, "CROSSED").otherwise("OK").alias("status"), (ask - bid).alias("spread"), F.round((bid + ask) / 2, 6).alias("mid"),
        F.round((bs - az) / (bs + az), 9).alias("imbalance"), F.round((bid * az + ask * bs) / (bs + az), 9).alias("weighted_mid"),
    )


@query(
    "reservation_quotes",
    f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, value - 5e-2 * (k - 5) AS reserve, (k - 5) AS held FROM ev)
        SELECT event_id, round(floor((reserve - 4e-1) / 5e-1) * 5e-1, 6) AS bid, round(ceil((reserve + 4e-1) / 5e-1) * 5e-1, 6) AS ask, greatest(20 - held, 0) AS bid_units, greatest(20 + held, 0) AS ask_units FROM q""",
)
def reservation_quotes(spark, sf):
    """Quotes around an inventory-shifted price, floored and ceiled to ticks, within capacity."""
    held = F.col("k") - 5
    reserve = F.col("value") - 0.05 * held
    return events(spark, sf).select(
        "event_id", F.round(F.floor((reserve - 4e-1) / 5e-1) * 5e-1, 6).alias("bid"), F.round(F.ceil((reserve + 0.4) / 0.5) * 0.5, 6).alias("ask"),
        F.greatest(20 - held, F.lit(0)).alias("bid_units"), F.greatest(20 + held, F.lit(0)).alias("ask_units"),
    )
