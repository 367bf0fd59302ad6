"""Queries of selection bias, dependent means, resampling tests, profiles and unit roots."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.functions.distributions import norm_ppf_sql, t_cdf_sql, uniform_sql
from tidelight.functions.maths import norm_cdf_sql
from tidelight.operators import evaluation as ev
from tidelight.operators import sequences as sq
from tidelight.operators import stats
from tidelight.plans.registry import query
from tidelight.plans.sequence_queries import DAILY_SQL, daily
from tidelight.plans.stat_queries import MOM_SQL, RET_SQL, exact_returns, returns
from tidelight.sources.tables import EVENTS_SQL, events, read

STAR = f"((1 - {ev.EULER_GAMMA}) * {norm_ppf_sql('(1 - 1 / trials)')} + {ev.EULER_GAMMA} * {norm_ppf_sql(f'(1 - 1 / (trials * {math.e}))')})"


def summary(spark, sf):
    return stats.summary(returns(spark, sf), "g", "r")


def rounded(table, **digits):
    """Columns rounded to some digits; None leaves one as it is."""
    return table.select(*[F.col(c) if d is None else F.round(c, d).alias(c) for c, d in digits.items()])


Z_STAR = "((sharpe - sr_star) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe))"


@query(
    "deflated_sharpe",
    f"""WITH {MOM_SQL}, l AS (SELECT count(*)::DOUBLE AS trials, sqrt(var_samp(sharpe)) AS sd FROM z), s2 AS (SELECT sd * {STAR} AS sr_star FROM l), d AS (SELECT g, sr_star, {Z_STAR} AS x FROM z, s2)
        SELECT g, round(sr_star, 9) AS sr_star, round({norm_cdf_sql("x")}, 8) AS dsr FROM d""",
)
def deflated_sharpe(spark, sf):
    """Each supplier's Sharpe ratio against the best that luck gives among all of them."""
    return rounded(ev.deflated(summary(spark, sf), "g"), g=None, sr_star=9, dsr=8)


@query(
    "selection_dsr",
    f"""WITH {MOM_SQL}, l AS (SELECT count(*)::DOUBLE AS trials, var_samp(CASE WHEN n >= 30 THEN sharpe * sqrt(n - 1) END) AS v FROM z WHERE n >= 3), b AS (SELECT * FROM z WHERE n >= 3 ORDER BY sharpe DESC, g LIMIT 1),
        d AS (SELECT g, n, sharpe, skew, kurtosis, sqrt(v / (n - 1)) * {STAR} AS sr_star FROM b, l), e AS (SELECT g, sr_star, {Z_STAR} AS x FROM d) SELECT g AS winner, round(sr_star, 9) AS sr_star, round({norm_cdf_sql("x")}, 8) AS dsr FROM e""",
)
def selection_dsr(spark, sf):
    """The selected supplier's Sharpe ratio, deflated by all that were tried."""
    return rounded(ev.selection(summary(spark, sf), "g"), winner=None, sr_star=9, dsr=8)


@query(
    "windows_needed",
    f"""WITH {MOM_SQL}, q AS (SELECT {norm_ppf_sql("0.95::DOUBLE")} + {norm_ppf_sql("0.8::DOUBLE")} AS q) SELECT g, round(CASE WHEN sharpe > 0 THEN 1 + greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 0) * pow(q / sharpe, 2) END, 3) AS needed FROM z, q""",
)
def windows_needed(spark, sf):
    """Days that a test of each supplier's Sharpe ratio would need."""
    s = stats.summary(exact_returns(spark, sf), "g", "r")  # a small mean's noise is large here
    return s.select("g", F.round(ev.windows_needed(F.col("sharpe"), F.col("skew"), F.col("kurtosis")), 3).alias("needed"))


HOURS = 168
DEPENDENT_SQL = f"""WITH {RET_SQL}, x AS (SELECT g, day * 86400 AS t, r FROM ret), gp AS (SELECT g, t - lag(t) OVER (PARTITION BY g ORDER BY t) AS gap FROM (SELECT DISTINCT g, t FROM x)),
    st AS (SELECT g, coalesce(quantile_cont(gap, 0.5), 1) AS step FROM gp GROUP BY g), ba AS (SELECT g, count(*) AS n, avg(r) AS mean, min(t) AS t0, max(t) - min(t) AS len FROM x GROUP BY g HAVING count(*) >= 3),
    b2 AS (SELECT g, n, mean, t0, step, len + step AS span, least(greatest(4, floor((len + step) / (8 * {HOURS} * 3600.0))), n - 1)::BIGINT AS df FROM ba JOIN st USING (g)),
    ea AS (SELECT g, n, mean, span, df, (t - t0 + step / 2) / span AS u, r - mean AS d, unnest(generate_series(1, df)) AS j FROM x JOIN b2 USING (g)),
    la AS (SELECT g, n, mean, span, df, j, sum(sqrt(2.0 / n) * cos(pi() * j * u) * d) AS lam FROM ea GROUP BY ALL),
    lr AS (SELECT g, n, mean, df, avg(lam * lam) AS lrv, avg(1 / (1 + pow(pi() * j * {min(HOURS, 60) * 3600 / math.log(2)!r} / span, 2))) AS bias FROM la GROUP BY ALL),
    te AS (SELECT *, sqrt(lrv / bias / n) AS se, mean / sqrt(lrv / bias / n) AS t FROM lr)
    SELECT g, n, round(se, 9) AS se, round(t, 7) AS t, df, round(bias, 9) AS bias, round({t_cdf_sql("t", "df")}, 8) AS p FROM te"""


@query("dependent_mean_test", DEPENDENT_SQL)
def dependent_mean_test(spark, sf):
    """Whether each supplier's mean daily profit is below 0, given dependence over a week."""
    r = returns(spark, sf).select("g", (F.col("day") * 86400).cast("double").alias("t"), "r")
    return rounded(ev.dependent_mean(r, "g", "t", "r", HOURS), g=None, n=None, se=9, t=7, df=None, bias=9, p=8)


@query("vif_mean_test", f"WITH {RET_SQL}, m AS (SELECT g, count(r) AS n, avg(r) AS mean, sqrt(1.5 * var_samp(r) / count(r)) AS se FROM ret GROUP BY g HAVING count(r) >= 3), z AS (SELECT *, mean / se AS t, 24::BIGINT AS df FROM m) SELECT g, n, round(se, 9) AS se, round(t, 7) AS t, round({t_cdf_sql('t', 'df')}, 8) AS p FROM z")
def vif_mean_test(spark, sf):
    """The same with a variance inflation and degrees of freedom that were measured before."""
    return rounded(ev.vif_mean(returns(spark, sf), "g", "r", 1.5, 24), g=None, n=None, se=9, t=7, p=8)


@query(
    "batch_means",
    f"""WITH {RET_SQL}, b AS (SELECT g, floor(day / 28)::BIGINT AS k, sum(r) AS s, count(*) AS w FROM ret GROUP BY ALL), m AS (SELECT g, sum(s) / sum(w) AS mean, sum(w) AS n, count(*) AS blocks FROM b GROUP BY g HAVING count(*) >= 2),
        v AS (SELECT g, mean, blocks, blocks / (blocks - 1.0) * sum(pow(s - w * mean, 2)) / n / n AS v FROM b JOIN m USING (g) GROUP BY g, mean, blocks, n), t AS (SELECT *, mean / sqrt(v) AS t, blocks - 1 AS df FROM v) SELECT g, blocks, round(t, 7) AS t, round({t_cdf_sql("t", "df")}, 8) AS p FROM t""",
)
def batch_means(spark, sf):
    """The same from sums over blocks of 28 days."""
    return rounded(ev.batch_means(returns(spark, sf), "g", "day", "r", 28), g=None, blocks=None, t=7, p=8)


LEGS_SQL = """legs AS (SELECT l_suppkey AS g, concat_ws('-', l_orderkey, l_linenumber, l_partkey, date_part('epoch', l_shipdate)::BIGINT) AS id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS up, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS down,
    l_quantity * (0.3 + 4 * l_discount) AS cost, l_quantity * l_tax / 20 AS fees, l_quantity * (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) - l_quantity * (0.3 + 4 * l_discount) - l_quantity * l_tax / 20 AS pnl FROM lineitem)"""


def legs(spark, sf):
    """Line items as positions on two outcomes: ``g, id, up, down, cost, fees, pnl``."""
    li, q = read(spark, sf, "lineitem"), F.col("l_quantity")
    cost, fees = q * (0.3 + 4 * F.col("l_discount")), q * F.col("l_tax") / 20
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")))
    returned = F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_suppkey").alias("g"), ident.alias("id"), F.when(returned, 0.0).otherwise(q).alias("up"), F.when(returned, q).otherwise(0.0).alias("down"),
        cost.alias("cost"), fees.alias("fees"), (q * F.when(F.col("l_linestatus") == "F", 1).otherwise(0) - cost - fees).alias("pnl"),
    )


ZERO = "CASE WHEN abs(up - down) > 1e-9 THEN least(greatest((cost + fees - down) / (up - down), 0), 1) END"


@query("zero_edge_chance", f"WITH {LEGS_SQL} SELECT id, round({ZERO}, 9) AS p_up FROM legs")
def zero_edge_chance(spark, sf):
    """The chance of the first outcome at which each position breaks even."""
    return legs(spark, sf).select("id", F.round(ev.zero_edge_up(F.col("up"), F.col("down"), F.col("cost"), F.col("fees")), 9).alias("p_up"))


DRAWS = 40
STAR_OF = f"(1 - {ev.EULER_GAMMA}) * {norm_ppf_sql('(1 - 1 / 20e0)')} + {ev.EULER_GAMMA} * {norm_ppf_sql(f'(1 - 1 / (20 * {math.e}))')}"


@query(
    "outcome_luck",
    f"""WITH {LEGS_SQL}, own AS (SELECT g, count(*) AS k, avg(pnl / cost) AS mean, stddev_samp(pnl / cost) AS spread FROM legs WHERE cost > 0 GROUP BY g HAVING count(*) >= 3 AND stddev_samp(pnl / cost) > 0),
        z AS (SELECT *, {ZERO} AS p_up FROM legs WHERE cost > 0), dr AS (SELECT g, b, CASE WHEN p_up IS NULL THEN 0 ELSE (CASE WHEN {uniform_sql("'o'", "b", "id")} < p_up THEN up ELSE down END - cost - fees) / cost END AS r FROM z, range({DRAWS}) t(b)),
        a AS (SELECT g, b, round(avg(r), 12) AS m, round(stddev_samp(r), 12) AS sd, avg(r) / nullif(stddev_samp(r), 0) AS sr, count(*) AS n FROM dr GROUP BY ALL),
        s AS (SELECT g, k, mean, spread, (1 + count(*) FILTER (CASE WHEN sd > 0 THEN m / sd * sqrt(n) WHEN m = 0 THEN 0 ELSE sign(m) * 1e300 END >= mean / spread * sqrt(k) - 1e-9 * greatest(1, abs(mean / spread * sqrt(k))))) / {DRAWS + 1}.0 AS p, avg(sr) AS mu, stddev_samp(sr) AS null_sd FROM a JOIN own USING (g) GROUP BY ALL),
        h AS (SELECT *, mu + null_sd * ({STAR_OF}) AS sr_star FROM s), dd AS (SELECT g, avg(CASE WHEN a.sr - mu + sr_star < mean / spread THEN 1.0 ELSE 0 END) AS dsr FROM a JOIN h USING (g) GROUP BY g)
        SELECT g, round(p, 9) AS p, round(mean / spread, 9) AS sharpe, round(null_sd, 9) AS null_sd, round(sr_star, 9) AS sr_star, round(dsr, 9) AS dsr FROM h JOIN dd USING (g)""",
)
def outcome_luck(spark, sf):
    """Each supplier's t among outcomes redrawn at break-even chances, and the best of twenty that luck gives."""
    out = ev.outcome_test(legs(spark, sf), "g", ["id"], DRAWS, 20)
    return rounded(out, g=None, p=9, sharpe=9, null_sd=9, sr_star=9, dsr=9)


MONTH_RET_SQL = f"{RET_SQL}, mr AS (SELECT g, day // 30 AS mo, sum(r) AS r FROM ret GROUP BY ALL)"


def monthly_returns(spark, sf):
    return returns(spark, sf).groupBy("g", F.floor(F.col("day") / 30).alias("mo")).agg(F.sum("r").alias("r"))


@query(
    "bootstrap_t_ci",
    f"""WITH {MONTH_RET_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mo) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM mr), ba AS (SELECT g, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM mr GROUP BY g HAVING count(*) >= 3 AND stddev_samp(r) > 0),
        pk AS (SELECT g, b, floor({uniform_sql("'t'", "g", "b", "i")} * n)::BIGINT AS i FROM nu, range({DRAWS}) t(b)), dr AS (SELECT pk.g, b, avg(r) AS mb, stddev_samp(r) AS sb FROM pk JOIN nu ON nu.g = pk.g AND nu.i = pk.i GROUP BY ALL),
        tb AS (SELECT g, n, m, sd, CASE WHEN round(sb, 12) > 0 THEN round(mb - m, 12) / round(sb, 12) * sqrt(n) WHEN round(mb - m, 12) = 0 THEN 0 ELSE sign(mb - m) * 1e300 END AS tb FROM dr JOIN ba USING (g))
        SELECT g, round(m - quantile_cont(tb, 0.975) * sd / sqrt(n), 7) AS lo, round(m - quantile_cont(tb, 0.025) * sd / sqrt(n), 7) AS hi, round((1 + count(*) FILTER (tb >= m / sd * sqrt(n) - 1e-9)) / {DRAWS + 1}.0, 9) AS p FROM tb GROUP BY g, n, m, sd""",
)
def bootstrap_t_ci(spark, sf):
    """Percentile-t intervals of mean monthly profits, and the share of centred resamples beyond them."""
    return rounded(ev.bootstrap_t(monthly_returns(spark, sf), "g", ["mo"], "r", DRAWS), g=None, lo=7, hi=7, p=9)


@query(
    "cluster_bootstrap_p",
    f"""WITH {EVENTS_SQL}, s AS (SELECT g, sum(value - 250) AS s, count(value) AS c, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM ev GROUP BY g), pk AS (SELECT b, floor({uniform_sql("'c'", "0", "b", "i")} * n)::BIGINT AS i FROM s, range({DRAWS}) t(b)),
        d AS (SELECT b, sum(s) / sum(c) AS m FROM pk JOIN s USING (i) GROUP BY b), e AS (SELECT (SELECT sum(s) / sum(c) FROM s) AS estimate, stddev_samp(m) AS se FROM d), z AS (SELECT *, -abs(estimate) / se AS x FROM e) SELECT round(estimate, 7) AS estimate, round(se, 7) AS se, round(2 * {norm_cdf_sql("x")}, 8) AS p FROM z""",
)
def cluster_bootstrap_p(spark, sf):
    """Whether the mean event value differs from 250, by resampling whole users."""
    e = events(spark, sf).select("g", (F.col("value") - 250).alias("x"))
    return rounded(ev.cluster_bootstrap(e, "g", "x", DRAWS), estimate=7, se=7, p=8)


LAGS = 3


def _rho(k: int) -> str:
    return f"pow((p{k} - mu * t{k} + n{k} * mu * mu) / n{k} / var, 2) * n{k}"


@query(
    "ljung_box_signflip",
    f"""WITH {EVENTS_SQL}, c AS (SELECT g, event_id, value - avg(value) OVER () AS d FROM ev), f AS (SELECT g, event_id, b, d * CASE WHEN b = 0 THEN 1 WHEN {uniform_sql("'s'", "b", "event_id")} < 0.5 THEN -1 ELSE 1 END AS s FROM c, range({DRAWS + 1}) t(b)),
        l AS (SELECT b, s, {", ".join(f"lag(s, {k}) OVER w AS l{k}" for k in range(1, LAGS + 1))} FROM f WINDOW w AS (PARTITION BY b, g ORDER BY event_id)),
        a AS (SELECT b, avg(s) AS mu, var_pop(s) AS var, {", ".join(f"count(l{k}) AS n{k}, sum(s * l{k}) AS p{k}, sum(s + l{k}) AS t{k}" for k in range(1, LAGS + 1))} FROM l GROUP BY b), q AS (SELECT b, {" + ".join(_rho(k) for k in range(1, LAGS + 1))} AS q FROM a)
        SELECT round(max(q) FILTER (b = 0), 7) AS q, round((1 + count(*) FILTER (b > 0 AND q >= (SELECT q FROM q WHERE b = 0) * (1 - 1e-12))) / {DRAWS + 1}.0, 9) AS p FROM q""",
)
def ljung_box_signflip(spark, sf):
    """Serial correlation of a user's event values, against random signs."""
    return rounded(ev.sign_flips(events(spark, sf).select("g", "event_id", "value"), "g", ["event_id"], "value", LAGS, DRAWS), q=7, p=9)


@query("within_group_pairs", f"WITH {EVENTS_SQL}, l AS (SELECT g, value, lag(value, 2) OVER (PARTITION BY g ORDER BY event_id) AS past FROM ev) SELECT g, count(*) AS pairs, round(sum(value * past), 5) AS products FROM l WHERE past IS NOT NULL GROUP BY g")
def within_group_pairs(spark, sf):
    """Pairs two events apart, never across users."""
    w = Window.partitionBy("g").orderBy("event_id")
    pairs = events(spark, sf).withColumn("past", F.lag("value", 2).over(w)).filter("past is not null")
    return pairs.groupBy("g").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.col("value") * F.col("past")), 5).alias("products"))


CELLS_SQL = """c0 AS (SELECT floor(epoch(o_orderdate) / 604800)::BIGINT AS week, floor(epoch(o_orderdate) / 86400)::BIGINT % 7 AS cell, ln(sum(o_totalprice)) AS y, ln(1 + count(*)) AS x FROM orders GROUP BY ALL),
    c AS (SELECT * FROM c0 WHERE week IN (SELECT week FROM c0 GROUP BY week HAVING count(*) = 7))"""


def cells(spark, sf):
    """Whole weeks of orders by weekday: ``week, cell, y`` (log of the total), ``x`` (log of the count)."""
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    c = read(spark, sf, "orders").groupBy(F.floor(t / 604800).alias("week"), (F.floor(t / 86400) % 7).alias("cell")).agg(F.ln(F.sum("o_totalprice")).alias("y"), F.ln(1 + F.count(F.lit(1))).alias("x"))
    return c.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("week"))).filter("_k = 7").drop("_k")


@query(
    "adjusted_profile",
    f"""WITH {CELLS_SQL}, d AS (SELECT week, cell, y - avg(y) OVER (PARTITION BY week) AS ey, x - avg(x) OVER (PARTITION BY week) AS ex FROM c), b AS (SELECT sum(ex * ey) / sum(ex * ex) AS beta FROM d), m AS (SELECT cell, beta, avg(ey) AS raw, avg(ey - beta * ex) AS rest FROM d, b GROUP BY ALL)
        SELECT round(beta, 9) AS beta, round(1 - var_samp(rest) / var_samp(raw), 8) AS share FROM m GROUP BY beta""",
)
def adjusted_profile(spark, sf):
    """How much of the weekday profile of order totals their counts explain."""
    return rounded(ev.adjusted_profile(cells(spark, sf), "week", "cell", "y", "x"), beta=9, share=8)


BLOCK, LONG_DRAWS = 4, 60
BLOCKS_SQL = f"""nw AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM c)), sl AS (SELECT b, i AS place, (floor({uniform_sql("'b'", "b", f"(i // {BLOCK})::BIGINT")} * n)::BIGINT + i % {BLOCK}) % n AS i FROM nw, range({LONG_DRAWS}) t(b)),
    bd AS (SELECT b, place, week FROM sl JOIN nw USING (i))"""


@query("level_ci", f"WITH {CELLS_SQL}, {BLOCKS_SQL}, m AS (SELECT b, cell, avg(y) AS m FROM bd JOIN c USING (week) GROUP BY ALL), s AS (SELECT cell, stddev_samp(m) AS se FROM m GROUP BY cell) SELECT cell, round(avg(y), 9) AS mean, round(any_value(se), 9) AS se, count(*) AS rows FROM c JOIN s USING (cell) GROUP BY cell")
def level_ci(spark, sf):
    """Weekday means, with errors from circular blocks of four weeks."""
    return rounded(ev.level_ci(cells(spark, sf), "week", "cell", "y", BLOCK, LONG_DRAWS), cell=None, mean=9, se=9, rows=None)


@query(
    "profile_test",
    f"""WITH {CELLS_SQL}, {BLOCKS_SQL}, e AS (SELECT week, cell, y - avg(y) OVER (PARTITION BY week) AS e FROM c), e2 AS (SELECT *, e - avg(e) OVER (PARTITION BY cell) AS z FROM e), own AS (SELECT sum(q) AS stat FROM (SELECT avg(e) * avg(e) * count(*) / var_samp(e) AS q FROM e2 GROUP BY cell)),
        qb AS (SELECT b, sum(q) AS q FROM (SELECT b, cell, avg(z) * avg(z) * count(*) / nullif(var_samp(z), 0) AS q FROM bd JOIN e2 USING (week) GROUP BY b, cell) GROUP BY b) SELECT round(stat, 7) AS stat, round((1 + count(*) FILTER (q >= stat)) / {LONG_DRAWS + 1}.0, 9) AS p FROM qb, own GROUP BY stat""",
)
def profile_test(spark, sf):
    """Whether weekdays differ within weeks."""
    return rounded(ev.profile_test(cells(spark, sf), "week", "cell", "y", BLOCK, LONG_DRAWS), stat=7, p=9)


@query("path_mean_variance", f"WITH {MONTH_RET_SQL}, y AS (SELECT g, avg(r) AS y FROM mr GROUP BY g), a AS (SELECT count(y) AS paths, avg(y) AS mean, var_samp(y) AS v FROM y) SELECT paths, round(mean, 9) AS mean, round(v * (1 + (paths - 1) * 0.1) / paths, 9) AS variance_of_mean, round(v / (v * (1 + (paths - 1) * 0.1) / paths), 7) AS effective_paths FROM a")
def path_mean_variance(spark, sf):
    """Variance of the mean of suppliers' profits if they correlate by a tenth."""
    y = monthly_returns(spark, sf).groupBy("g").agg(F.avg("r").alias("y"))
    return rounded(ev.path_mean_variance(y, "y", F.lit(0.1)), paths=None, mean=9, variance_of_mean=9, effective_paths=7)


def _surface(level: float, regression: str) -> str:
    b = ev.ADF_CRITICAL[regression][level]
    return f"round({b[0]} + {b[1]} / n + {b[2]} / (n * n) + {b[3]} / (n * n * n), 8)"


@query(
    "adf_levels",
    f"""WITH e AS (SELECT event_id, (value - 400) / 40 AS t, 20e0 + event_id % 500 AS n FROM events), p AS (SELECT *, CASE WHEN t <= {ev.ADF_STAR} THEN {" + ".join(f"({c}) * pow(t, {i})" for i, c in enumerate(ev.ADF_SMALL))} ELSE {" + ".join(f"({c}) * pow(t, {i})" for i, c in enumerate(ev.ADF_LARGE))} END AS x FROM e)
        SELECT event_id, round(CASE WHEN t > {ev.ADF_MAX} THEN 1 WHEN t < {ev.ADF_MIN} THEN 0 ELSE {norm_cdf_sql("x")} END, 8) AS p, {_surface(0.05, "c")} AS critical, {_surface(0.01, "ct")} AS critical_trend FROM p""",
)
def adf_levels(spark, sf):
    """P-values of Dickey-Fuller statistics, and critical values by the number of rows."""
    e = events(spark, sf).select("event_id", ((F.col("value") - 400) / 40).alias("t"), (20.0 + F.col("event_id") % 500).alias("n"))
    return e.select("event_id", F.round(ev.adf_pvalue(F.col("t")), 8).alias("p"), F.round(ev.adf_critical(F.col("n")), 8).alias("critical"), F.round(ev.adf_critical(F.col("n"), 0.01, "ct"), 8).alias("critical_trend"))


@query("rare_labels", "WITH c AS (SELECT l_linenumber % 7 * 10 + l_orderkey % 3 AS label, count(*) AS n FROM lineitem GROUP BY ALL), l AS (SELECT *, n / sum(n) OVER w <= 0.05 AND count(*) OVER w >= 3 AS goes FROM c WINDOW w AS (ORDER BY n, label ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), f AS (SELECT *, min(goes::INT) OVER (ORDER BY n, label ROWS UNBOUNDED PRECEDING) AS f FROM l) SELECT label, n FROM f WHERE f = 1")
def rare_labels(spark, sf):
    """Labels that are dropped, the rarest first, until each has its share."""
    li = read(spark, sf, "lineitem").select((F.col("l_linenumber") % 7 * 10 + F.col("l_orderkey") % 3).alias("label"))
    return ev.rare_labels(li, "label", 0.05)


EXPANDING = 0.4


@query(
    "fracdiff_expanding",
    f"""WITH {DAILY_SQL}, n AS (SELECT g, day, v, row_number() OVER (PARTITION BY g ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY g) AS len FROM daily), k AS (SELECT unnest(range(0, (SELECT max(len) FROM n))) AS k),
        w AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE product((k - 1 - {EXPANDING}) / greatest(k, 1)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / ((-1 - {EXPANDING}) / 1) END AS w FROM k),
        cu AS (SELECT k, w, sum(abs(w)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM w), sk AS (SELECT g, count(*) FILTER (1 - c / (SELECT c FROM cu c2 WHERE c2.k = len - 1) > 0.2) AS skip FROM (SELECT DISTINCT g, len FROM n) JOIN cu ON k < len GROUP BY g)
        SELECT a.g, a.day, round(sum(cu.w * b.v), 5) AS diff FROM n a JOIN sk USING (g) JOIN n b ON a.g = b.g AND b.i <= a.i JOIN cu ON cu.k = a.i - b.i WHERE a.i >= skip GROUP BY a.g, a.day""",
)
def fracdiff_expanding(spark, sf):
    """Fractional differences over an expanding window, from where the weight that is missing is small."""
    out = sq.per_series(daily(spark, sf), "g", "day", "v", "i long, diff double", lambda x: sq.frac_diff_expanding(x, EXPANDING, 0.2))
    days = daily(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("day")) - 1)
    return out.join(days.select("g", "i", "day"), ["g", "i"]).select("g", "day", F.round("diff", 5).alias("diff"))


SHARES_SQL = "s AS (SELECT l_suppkey AS g, l_linenumber AS k, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), p AS (SELECT g, q / sum(q) OVER (PARTITION BY g) AS p FROM s)"


@query(
    "diversity",
    f"""WITH {SHARES_SQL} SELECT g, round(exp(sum(p * ln(p))), 9) AS geometric, round(sqrt(sum(p * p * p)), 9) AS quadratic, round(1 / exp(sum(p * ln(p))), 7) AS number_1, round(1 / sum(p * p), 7) AS number_2, round(1 / sqrt(sum(p * p * p)), 7) AS number_3,
        round(1 - exp(-sum(p * ln(p))) / count(*), 9) AS concentration FROM p GROUP BY g""",
)
def diversity(spark, sf):
    """Power means and effective numbers of each supplier's line shares, and their concentration."""
    s = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    s = s.withColumn("p", F.col("q") / F.sum("q").over(Window.partitionBy("g")))
    p = F.col("p")
    return s.groupBy("g").agg(
        F.round(stats.power_mean(p, p, 0), 9).alias("geometric"), F.round(stats.power_mean(p, p, 2), 9).alias("quadratic"), F.round(stats.effective_number(p, 1), 7).alias("number_1"),
        F.round(stats.effective_number(p, 2), 7).alias("number_2"), F.round(stats.effective_number(p, 3), 7).alias("number_3"), F.round(stats.entropy_concentration(p), 9).alias("concentration"),
    )


@query(
    "ou_fits",
    f"""WITH {EVENTS_SQL}, l AS (SELECT g, value - 250 AS y, lag(value) OVER (PARTITION BY g ORDER BY event_id) - 250 AS x FROM ev), k AS (SELECT * FROM l WHERE x IS NOT NULL), f AS (SELECT g, count(*) AS n, sum(x * y) / sum(x * x) AS phi, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM k GROUP BY g)
        SELECT g, n, round(phi, 8) AS phi, round(sqrt((yy - phi * xy) / (n - 1)), 6) AS sigma, round(sqrt((yy - phi * xy) / (n - 1)) / sqrt(xx), 8) AS phi_se, round(CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END, 6) AS half_life, round(slope, 8) AS slope, round(icept / (1 - slope), 5) AS mean, round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 8) AS slope_se FROM f""",
)
def ou_fits(spark, sf):
    """Mean-reverting fits of each user's event values, through a known mean and with a constant."""
    w = Window.partitionBy("g").orderBy("event_id")
    k = events(spark, sf).select("g", "event_id", (F.col("value") - 250).alias("y")).withColumn("x", F.lag("y").over(w)).filter("x is not null")
    x, y = F.col("x"), F.col("y")
    f = k.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icept"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"))
    f = f.withColumn("phi", F.col("xy") / F.col("xx")).withColumn("sigma", F.sqrt((F.col("yy") - F.col("phi") * F.col("xy")) / (F.col("n") - 1))).withColumn("phi_se", F.col("sigma") / F.sqrt("xx"))
    f = f.withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -math.log(2) / F.ln("phi"))).withColumn("mean", F.col("icept") / (1 - F.col("slope")))
    f = f.withColumn("slope_se", F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx")))
    return rounded(f, g=None, n=None, phi=8, sigma=6, phi_se=8, half_life=6, slope=8, mean=5, slope_se=8)
