"""Queries over factor panels, portfolios, order books and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.operators import asof
from tidelight.operators.stats import average_rank, safe_corr
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, events, read

#: Quarterly mean price of each supplier; available a month after the quarter's end, later for every ninth.
PANEL_SQL = """raw AS (SELECT l_suppkey AS asset, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS idx, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price FROM lineitem GROUP BY ALL),
    panel AS (SELECT asset, idx, price, idx + CASE WHEN (asset + idx) % 9 = 0 THEN 2 ELSE 1 END AS available FROM raw)"""
SIG_SQL = f"""{PANEL_SQL}, sig AS (SELECT d.asset, d.idx, a.price / b.price - 1 AS mom, n.price / d.price - 1 AS fwd FROM panel d JOIN panel a ON a.asset = d.asset AND a.idx = d.idx - 1 AND a.available <= d.idx
    JOIN panel b ON b.asset = d.asset AND b.idx = d.idx - 4 AND b.available <= d.idx LEFT JOIN panel n ON n.asset = d.asset AND n.idx = d.idx + 1)"""


def panel(spark, sf):
    li = read(spark, sf, "lineitem")
    idx = F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1
    raw = li.groupBy(F.col("l_suppkey").alias("asset"), idx.alias("idx")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("price"))
    return raw.withColumn("available", F.col("idx") + F.when((F.col("asset") + F.col("idx")) % 9 == 0, 2).otherwise(1))


def signals(spark, sf):
    """Momentum over three quarters up to the last known one, and the next quarter's return; rows by calendar index, not offset."""
    w = Window.partitionBy("asset").orderBy("idx")
    at = lambda k, c: F.max(c).over(w.rangeBetween(k, k))  # one row a quarter
    j = panel(spark, sf).select("asset", "idx", "price", at(-1, "price").alias("a"), at(-1, "available").alias("a_at"), at(-4, "price").alias("b"), at(-4, "available").alias("b_at"), at(1, "price").alias("n"))
    known = j.filter((F.col("a_at") <= F.col("idx")) & (F.col("b_at") <= F.col("idx")))
    return known.select("asset", "idx", (F.col("a") / F.col("b") - 1).alias("mom"), (F.col("n") / F.col("price") - 1).alias("fwd"))


@query("factor_features", f"WITH {SIG_SQL} SELECT asset, idx, round(mom, 9) AS momentum, round(-mom, 9) AS reversal, round(fwd, 9) AS label FROM sig")
def factor_features(spark, sf):
    """Momentum and reversal known at the decision, with the label."""
    return signals(spark, sf).select("asset", "idx", F.round("mom", 9).alias("momentum"), F.round(-F.col("mom"), 9).alias("reversal"), F.round("fwd", 9).alias("label"))


RANK = "rank() OVER (PARTITION BY idx ORDER BY {0}) + (count(*) OVER (PARTITION BY idx, {0}) - 1) / 2.0"


@query("rank_ic", f"WITH {SIG_SQL}, r AS (SELECT idx, {RANK.format('mom')} AS a, {RANK.format('fwd')} AS b FROM sig WHERE fwd IS NOT NULL) SELECT idx, count(*) AS n, round(corr(a, b), 8) AS ic FROM r GROUP BY idx HAVING count(*) >= 3")
def rank_ic(spark, sf):
    """Cross-sectional Spearman correlation of factor and label at each date."""
    s = signals(spark, sf).filter("fwd is not null").withColumn("a", average_rank(F.col("mom"), ["idx"])).withColumn("b", average_rank(F.col("fwd"), ["idx"]))
    return s.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.round(safe_corr(F.col("a"), F.col("b")), 8).alias("ic")).filter("n >= 3")


W_SQL = f"""{SIG_SQL}, r AS (SELECT *, {RANK.format('mom')} AS rk FROM sig WHERE fwd IS NOT NULL), c AS (SELECT *, rk - avg(rk) OVER (PARTITION BY idx) AS x FROM r), wt AS (SELECT asset, idx, fwd, x / nullif(sum(abs(x)) OVER (PARTITION BY idx), 0) AS w FROM c)"""


def weights(spark, sf):
    """Centred average ranks, scaled to an absolute sum of one."""
    s = signals(spark, sf).filter("fwd is not null").withColumn("rk", average_rank(F.col("mom"), ["idx"]))
    w = Window.partitionBy("idx")
    c = s.withColumn("x", F.col("rk") - F.avg("rk").over(w))
    return c.select("asset", "idx", "fwd", F.try_divide("x", F.sum(F.abs("x")).over(w)).alias("w"))


@query("factor_weights", f"WITH {W_SQL} SELECT asset, idx, round(w, 9) AS weight FROM wt")
def factor_weights(spark, sf):
    return weights(spark, sf).select("asset", "idx", F.round("w", 9).alias("weight"))


@query("factor_sleeve", f"WITH {W_SQL} SELECT idx, round(sum(w * fwd), 9) AS gross, round(sum(abs(w) * (2 + fwd)), 9) AS turnover, round(sum(w * fwd) - 0.001 * sum(abs(w) * (2 + fwd)), 9) AS net FROM wt GROUP BY idx")
def factor_sleeve(spark, sf):
    """One-period profit of each date's weights, with costs of ten basis points on both legs."""
    gross, turn = F.sum(F.col("w") * F.col("fwd")), F.sum(F.abs("w") * (2 + F.col("fwd")))
    return weights(spark, sf).groupBy("idx").agg(F.round(gross, 9).alias("gross"), F.round(turn, 9).alias("turnover"), F.round(gross - 0.001 * turn, 9).alias("net"))


@query(
    "rebalanced_book",
    f"""WITH {W_SQL}, l AS (SELECT *, lag(w * (1 + fwd)) OVER (PARTITION BY asset ORDER BY idx) AS held, lag(idx) OVER (PARTITION BY asset ORDER BY idx) AS pidx FROM wt)
        SELECT idx, round(sum(abs(w - CASE WHEN pidx = idx - 1 THEN held ELSE 0 END)), 9) AS traded FROM l GROUP BY idx""",
)
def rebalanced_book(spark, sf):
    """Notional traded to move from the drifted holdings of the last date to the new weights."""
    w = Window.partitionBy("asset").orderBy("idx")
    x = weights(spark, sf).withColumn("held", F.lag(F.col("w") * (1 + F.col("fwd"))).over(w)).withColumn("pidx", F.lag("idx").over(w))
    held = F.when(F.col("pidx") == F.col("idx") - 1, F.col("held")).otherwise(0.0)
    return x.groupBy("idx").agg(F.round(F.sum(F.abs(F.col("w") - held)), 9).alias("traded"))


@query(
    "factor_select",
    f"""WITH {SIG_SQL}, r AS (SELECT idx, f, {RANK.format('x').replace('PARTITION BY idx', 'PARTITION BY idx, f')} AS a, rank() OVER (PARTITION BY idx, f ORDER BY fwd) + (count(*) OVER (PARTITION BY idx, f, fwd) - 1) / 2.0 AS b
            FROM (SELECT idx, fwd, unnest([1, 2]) AS f, unnest([mom, -mom]) AS x FROM sig WHERE fwd IS NOT NULL)), ic AS (SELECT f, idx, corr(a, b) AS ic FROM r GROUP BY f, idx HAVING count(*) >= 3),
        s AS (SELECT f, CASE WHEN idx < 7990 THEN 'validation' ELSE 'test' END AS part, avg(ic) AS ic, count(*) AS n FROM ic GROUP BY ALL), best AS (SELECT arg_max(f, (ic, -f)) AS f FROM s WHERE part = 'validation')
        SELECT CASE f WHEN 1 THEN 'momentum' ELSE 'reversal' END AS factor, part, n, round(ic, 8) AS ic FROM s WHERE f = (SELECT f FROM best)""",
)
def factor_select(spark, sf):
    """The factor of best mean rank correlation on validation dates, and its test result."""
    s = signals(spark, sf).filter("fwd is not null").select("idx", "fwd", F.explode(F.array(F.struct(F.lit(1).alias("f"), F.col("mom").alias("x")), F.struct(F.lit(2).alias("f"), (-F.col("mom")).alias("x")))).alias("s")).select("idx", "fwd", "s.*")
    r = s.withColumn("a", average_rank(F.col("x"), ["idx", "f"])).withColumn("b", average_rank(F.col("fwd"), ["idx", "f"]))
    ic = r.groupBy("f", "idx").agg(safe_corr(F.col("a"), F.col("b")).alias("ic"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    part = F.when(F.col("idx") < 7990, "validation").otherwise("test")
    split = ic.groupBy("f", part.alias("part")).agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n"))
    best = split.filter("part = 'validation'").agg(F.max_by("f", F.struct("ic", -F.col("f"))).alias("f"))  # one row
    return split.join(F.broadcast(best), "f").select(F.when(F.col("f") == 1, "momentum").otherwise("reversal").alias("factor"), "part", "n", F.round("ic", 8).alias("ic"))


@query(
    "lagged_momentum",
    f"""WITH {PANEL_SQL}, x AS (SELECT asset, idx, price, sign(price / lag(price, 2) OVER w - 1) AS s, lead(price) OVER w AS fill, lead(price, 2) OVER w AS leave, lead(idx, 2) OVER w AS out_idx FROM panel WINDOW w AS (PARTITION BY asset ORDER BY idx)),
        y AS (SELECT *, abs(s - coalesce(lag(s) OVER (PARTITION BY asset ORDER BY idx), 0)) AS turn FROM x WHERE s IS NOT NULL), z AS (SELECT out_idx, s * (leave / fill - 1) AS gross, turn FROM y WHERE leave IS NOT NULL)
        SELECT out_idx, round(avg(gross), 9) AS gross, round(avg(turn), 9) AS turnover, round(avg(gross - 0.0005 * turn), 9) AS net FROM z GROUP BY out_idx""",
)
def lagged_momentum(spark, sf):
    """Signal at one quarter, filled at the next, left at the one after; equal weights at each exit."""
    w = Window.partitionBy("asset").orderBy("idx")
    x = panel(spark, sf).select(
        "asset", "idx", F.signum(F.col("price") / F.lag("price", 2).over(w) - 1).alias("s"), F.lead("price").over(w).alias("fill"), F.lead("price", 2).over(w).alias("leave"), F.lead("idx", 2).over(w).alias("out_idx")
    ).filter("s is not null")
    y = x.withColumn("turn", F.abs(F.col("s") - F.coalesce(F.lag("s").over(w), F.lit(0.0)))).filter("leave is not null").withColumn("gross", F.col("s") * (F.col("leave") / F.col("fill") - 1))
    return y.groupBy("out_idx").agg(F.round(F.avg("gross"), 9).alias("gross"), F.round(F.avg("turn"), 9).alias("turnover"), F.round(F.avg(F.col("gross") - 0.0005 * F.col("turn")), 9).alias("net"))


@query(
    "equal_weight_hold",
    f"""WITH {PANEL_SQL}, g AS (SELECT asset, unnest(range(a, z + 1)) AS idx FROM (SELECT min(idx) AS a, max(idx) AS z FROM panel), (SELECT DISTINCT asset FROM panel)),
        f AS (SELECT g.asset, g.idx, last_value(price IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.idx ROWS UNBOUNDED PRECEDING) AS p, price IS NULL AS filled FROM g LEFT JOIN panel USING (asset, idx)),
        s AS (SELECT *, first_value(p IGNORE NULLS) OVER (PARTITION BY asset ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p0 FROM f)
        SELECT idx, round(avg(coalesce(p / p0, 1)), 8) AS value, sum(filled::INT)::BIGINT AS filled FROM s GROUP BY idx""",
)
def equal_weight_hold(spark, sf):
    """Value of an equal-weight holding; missing prices carry the last one."""
    p = panel(spark, sf)
    ends = p.agg(F.min("idx").alias("a"), F.max("idx").alias("z"))  # one row
    grid = p.select("asset").distinct().crossJoin(F.broadcast(ends)).select("asset", F.explode(F.sequence("a", "z")).alias("idx"))
    w = Window.partitionBy("asset").orderBy("idx")
    f = grid.join(p, ["asset", "idx"], "left").withColumn("p", F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("p0", F.first("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return f.groupBy("idx").agg(F.round(F.avg(F.coalesce(F.col("p") / F.col("p0"), F.lit(1.0))), 8).alias("value"), F.sum(F.col("price").isNull().cast("long")).alias("filled"))


BOOK_SQL = f"""{EVENTS_SQL}, d AS (SELECT event_id, ts, ts // 86400 AS day, CASE WHEN kind IN ('purchase', 'view') THEN 'bid' ELSE 'ask' END AS side, k AS tick, CASE WHEN event_id % 5 = 0 THEN 0 ELSE floor(value)::BIGINT END AS size FROM ev)"""


def deltas(spark, sf):
    """Replacement deltas of price levels, by day."""
    side = F.when(F.col("kind").isin("purchase", "view"), "bid").otherwise("ask")
    return events(spark, sf).select("event_id", "ts", F.floor(F.col("ts") / 86400).alias("day"), side.alias("side"), F.col("k").alias("tick"), F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.floor("value")).alias("size"))


@query("book_reconstruct", f"WITH {BOOK_SQL}, l AS (SELECT day, q, side, tick, arg_max(size, event_id) AS size FROM d, (VALUES (21600), (43200), (86400)) t(q) WHERE ts < day * 86400 + q GROUP BY ALL) SELECT day, q, side, tick, size FROM l WHERE size <> 0")
def book_reconstruct(spark, sf):
    """Levels of a day's book at three query times: the last size of each level, empty ones left out."""
    d = deltas(spark, sf).withColumn("q", F.explode(F.array(*map(F.lit, (21600, 43200, 86400))))).filter(F.col("ts") < F.col("day") * 86400 + F.col("q"))
    return d.groupBy("day", "q", "side", "tick").agg(F.max_by("size", "event_id").alias("size")).filter("size <> 0")


@query(
    "book_deltas",
    f"WITH {BOOK_SQL} SELECT event_id, size - coalesce(lag(size) OVER (PARTITION BY day, side, tick ORDER BY event_id), 0) AS change FROM d",
)
def book_deltas(spark, sf):
    """Change of size at each level against its previous size that day."""
    w = Window.partitionBy("day", "side", "tick").orderBy("event_id")
    return deltas(spark, sf).select("event_id", (F.col("size") - F.coalesce(F.lag("size").over(w), F.lit(0))).alias("change"))


LEDGER_SQL = f"""{EVENTS_SQL}, q AS (SELECT g, us, event_id, value AS mark FROM ev WHERE kind = 'view'), f AS (SELECT g, us, event_id, CASE WHEN kind = 'purchase' THEN 1 ELSE -1 END * (1 + k % 5) AS units, value AS price, 1e-2 * (1 + k % 5) AS fee FROM ev WHERE kind IN ('purchase', 'click'))"""


def ledger(spark, sf):
    e = events(spark, sf)
    units = F.when(F.col("kind") == "purchase", 1).otherwise(-1) * (1 + F.col("k") % 5)
    fills = e.filter(F.col("kind").isin("purchase", "click")).select("g", "us", "event_id", units.alias("units"), F.col("value").alias("price"), (0.01 * (1 + F.col("k") % 5)).alias("fee"))
    return fills, e.filter("kind = 'view'").select("g", F.col("us").alias("q_us"), F.col("event_id").alias("q_id"), F.col("value").alias("mark"))


@query(
    "ledger_equity",
    f"""WITH {LEDGER_SQL}, r AS (SELECT *, sum(-units * price - fee) OVER w AS cash, sum(units) OVER w AS position, sum(fee) OVER w AS fees FROM f WINDOW w AS (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        SELECT r.event_id, round(cash, 6) AS cash, position::BIGINT AS position, round(fees, 6) AS fees, CASE WHEN q.us IS NULL THEN 'missing' WHEN r.us - q.us > 2 * 86400000000 THEN 'stale' ELSE 'fresh' END AS mark_state,
        round(cash + position * q.mark, 6) AS equity FROM r ASOF LEFT JOIN q ON q.g = r.g AND r.us >= q.us""",
)
def ledger_equity(spark, sf):
    """Running cash, position and fees of each account, marked at the last quote, with the mark's state."""
    fills, quotes = ledger(spark, sf)
    w = Window.partitionBy("g").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = fills.withColumn("cash", F.sum(-F.col("units") * F.col("price") - F.col("fee")).over(w)).withColumn("position", F.sum("units").over(w)).withColumn("fees", F.sum("fee").over(w))
    j = asof.asof_join(r, quotes, "g", "us", "q_us", ["mark"], order=["q_id"])
    age = F.col("us") - F.col("matched_time")
    return j.select(
        "event_id", F.round("cash", 6).alias("cash"), "position", F.round("fees", 6).alias("fees"),
        F.when(age.isNull(), "missing").when(age > 2 * 86400000000, "stale").otherwise("fresh").alias("mark_state"), F.round(F.col("cash") + F.col("position") * F.col("mark"), 6).alias("equity"),
    )


@query(
    "ledger_markouts",
    f"WITH {LEDGER_SQL} SELECT f.event_id, round(units * (q.mark - price), 6) AS markout FROM (SELECT *, us + 86400000000 AS due FROM f) f ASOF LEFT JOIN q ON q.g = f.g AND f.due >= q.us",
)
def ledger_markouts(spark, sf):
    """Profit of each fill at the quote a day later."""
    fills, quotes = ledger(spark, sf)
    j = asof.asof_join(fills.withColumn("due", F.col("us") + 86400000000), quotes, "g", "due", "q_us", ["mark"], order=["q_id"])
    return j.select("event_id", F.round(F.col("units") * (F.col("mark") - F.col("price")), 6).alias("markout"))


@query(
    "bet_timing",
    f"""WITH {LEDGER_SQL}, r AS (SELECT *, sum(units) OVER (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM f), l AS (SELECT *, lag(p) OVER w AS p0, row_number() OVER (PARTITION BY g ORDER BY event_id DESC) AS back FROM r WINDOW w AS (PARTITION BY g ORDER BY event_id))
        SELECT event_id, g FROM l WHERE p0 <> 0 AND (p = 0 OR sign(p) <> sign(p0)) OR back = 1""",
)
def bet_timing(spark, sf):
    """Times at which a bet ends: the position is flat or has turned; the last closes."""
    fills, _ = ledger(spark, sf)
    w = Window.partitionBy("g").orderBy("event_id")
    r = fills.withColumn("p", F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("p0", F.lag("p").over(w)).withColumn("back", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("event_id"))))
    ended = (F.col("p0") != 0) & ((F.col("p") == 0) | (F.signum("p") != F.signum("p0")))
    return r.filter(ended | (F.col("back") == 1)).select("event_id", "g")


@query(
    "window_legs",
    """SELECT l_suppkey AS g, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS up, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS down, round(sum(l_extendedprice), 2) AS cost, round(sum(l_extendedprice * l_tax), 4) AS fees,
        round(sum(l_extendedprice * (l_discount - l_tax)), 4) AS pnl FROM lineitem GROUP BY ALL""",
)
def window_legs(spark, sf):
    """Shares of each side, cost, fees and profit of each window."""
    up = F.col("l_returnflag") == "R"
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(
        F.sum(F.when(up, q).otherwise(0.0)).alias("up"), F.sum(F.when(up, 0.0).otherwise(q)).alias("down"), F.round(F.sum(p), 2).alias("cost"), F.round(F.sum(p * F.col("l_tax")), 4).alias("fees"),
        F.round(F.sum(p * (F.col("l_discount") - F.col("l_tax"))), 4).alias("pnl"),
    )


@query(
    "config_matrix",
    """SELECT year(l_shipdate) AS period, round(sum(l_quantity * (l_tax - 0.04)) FILTER (l_returnflag = 'A'), 6) AS a, round(sum(l_quantity * (l_tax - 0.04)) FILTER (l_returnflag = 'N'), 6) AS n, round(sum(l_quantity * (l_tax - 0.04)) FILTER (l_returnflag = 'R'), 6) AS r FROM lineitem GROUP BY ALL""",
)
def config_matrix(spark, sf):
    """Profit by period and configuration, pivoted."""
    pnl = F.col("l_quantity") * (F.col("l_tax") - 0.04)
    p = read(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("period")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(pnl))
    return p.select("period", *[F.round(c, 6).alias(c.lower()) for c in ("A", "N", "R")])


@query(
    "summary_rollup",
    """SELECT coalesce(l_returnflag, 'all') AS rule, coalesce(l_linestatus, 'all') AS fold, count(*) AS bets, count(DISTINCT l_suppkey) AS windows, round(sum(l_quantity * (l_tax - 0.04)), 4) AS pnl FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def summary_rollup(spark, sf):
    """Results by rule, by rule and fold, and over all."""
    r = read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("bets"), F.count_distinct("l_suppkey").alias("windows"), F.round(F.sum(F.col("l_quantity") * (F.col("l_tax") - 0.04)), 4).alias("pnl"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("rule"), F.coalesce("l_linestatus", F.lit("all")).alias("fold"), "bets", "windows", "pnl")


@query(
    "dq_violations_prices",
    """WITH o AS (SELECT o_custkey AS asset, o_orderdate AS t, o_orderkey AS id, o_totalprice AS price, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS same FROM orders)
        SELECT id, 'PRICE_RANGE' AS code FROM o WHERE price < 1000 OR price > 400000 UNION ALL SELECT id, 'DUPLICATE_TIME' FROM o WHERE same > 1 UNION ALL SELECT id, 'PRICE_JUMP' FROM o WHERE abs(price / prev - 1) > 50""",
)
def dq_violations_prices(spark, sf):
    """Rows that break a rule of a price series, each with a code."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf, "orders").select("*", F.lag("o_totalprice").over(w).alias("prev"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderdate")).alias("same"))
    p = F.col("o_totalprice")
    rules = {"PRICE_RANGE": (p < 1000) | (p > 400000), "DUPLICATE_TIME": F.col("same") > 1, "PRICE_JUMP": F.abs(p / F.col("prev") - 1) > 50}
    codes = F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(codes).alias("code"))


@query(
    "quote_forecast_eval",
    f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, g, value, lag(value) OVER w AS naive, lead(value) OVER w AS future, row_number() OVER w AS rn, count(*) OVER (PARTITION BY g) AS n FROM ev WINDOW w AS (PARTITION BY g ORDER BY event_id)),
        s AS (SELECT *, CASE WHEN rn <= 0.6 * n THEN 'train' WHEN rn <= 0.8 * n THEN 'validation' ELSE 'test' END AS split, CASE WHEN future IS NULL THEN 'NO_FUTURE' WHEN naive IS NULL THEN 'NO_PAST' ELSE 'OK' END AS reason FROM q)
        SELECT split, reason, count(*) AS n, round(avg(abs(future - value)), 6) AS mae, round(avg(pow(future - value, 2)), 4) AS mse FROM s GROUP BY ALL""",
)
def quote_forecast_eval(spark, sf):
    """Errors of a no-change forecast by chronological split, with counts of what is left out and why."""
    w = Window.partitionBy("g").orderBy("event_id")
    q = events(spark, sf).select("value", F.lag("value").over(w).alias("naive"), F.lead("value").over(w).alias("future"), F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
    split = F.when(F.col("rn") <= 0.6 * F.col("n"), "train").when(F.col("rn") <= 0.8 * F.col("n"), "validation").otherwise("test")
    reason = F.when(F.col("future").isNull(), "NO_FUTURE").when(F.col("naive").isNull(), "NO_PAST").otherwise("OK")
    err = F.col("future") - F.col("value")
    return q.groupBy(split.alias("split"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(err)), 6).alias("mae"), F.round(F.avg(err * err), 4).alias("mse"))


@query(
    "equity_path",
    """WITH o AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice / 200000 - 0.9 AS r FROM orders) SELECT g, id, round(CASE WHEN min(r) OVER w <= -1 THEN 0 ELSE exp(sum(ln(greatest(1 + r, 1e-12))) OVER w) END, 8) AS equity FROM o WINDOW w AS (PARTITION BY g ORDER BY id ROWS UNBOUNDED PRECEDING)""",
)
def equity_path(spark, sf):
    """Compounded value of each account; once ruined it stays at zero."""
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 200000 - 0.9).alias("r"))
    return o.select("g", "id", F.round(F.when(F.min("r").over(w) <= -1, 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).over(w))), 8).alias("equity"))
