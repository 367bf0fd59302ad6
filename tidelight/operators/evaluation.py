"""Selection bias, dependent means and resampling tests, all as aggregations; resamples are drawn by hashes of (draw, place)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.functions.betting import prob_z
from tidelight.functions.distributions import norm_ppf, t_cdf, uniform
from tidelight.functions.maths import bound, norm_cdf

# Fixed value: the Euler-Mascheroni constant.
EULER_GAMMA = 0.5772156649015329


def expected_max_sharpe(trials: Column, variance: Column) -> Column:
    """The greatest Sharpe ratio expected of so many trials without skill; 0 of a single one."""
    n = F.greatest(trials.cast("double"), F.lit(2.0))
    most = (1 - EULER_GAMMA) * norm_ppf(1 - 1 / n) + EULER_GAMMA * norm_ppf(1 - 1 / (n * math.e))
    return F.when(trials < 2, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))) * most)


def deflated(summary: DataFrame, group: str) -> DataFrame:
    """``group, sr_star, dsr``: each trial's probability to beat the best luck of all trials; ``summary``: ``sharpe, n, skew, kurtosis`` of each."""
    luck = summary.filter("sharpe is not null").agg(F.count(F.lit(1)).alias("trials"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("variance"))
    luck = luck.select(expected_max_sharpe(F.col("trials"), F.col("variance")).alias("sr_star"))
    both = summary.crossJoin(F.broadcast(luck))  # one row
    z = prob_z(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurtosis"), F.col("sr_star"))
    return both.select(group, "sr_star", bound(z, norm_cdf).alias("dsr"))


def selection(summary: DataFrame, group: str, least: int = 30) -> DataFrame:
    """``winner, sr_star, dsr`` of the trial with the greatest Sharpe ratio. Trials of all sizes count; their spread is that of ``sharpe * sqrt(n - 1)`` over those with ``least`` returns."""
    z = F.when(F.col("n") >= least, F.col("sharpe") * F.sqrt(F.col("n") - 1))
    best = F.max_by(F.struct(group, "sharpe", "n", "skew", "kurtosis"), F.struct("sharpe", F.negate(F.col(group))))
    one = summary.filter("sharpe is not null and n >= 3").agg(best.alias("b"), F.var_samp(z).alias("v"), F.count(F.lit(1)).alias("trials"))
    star = expected_max_sharpe(F.col("trials"), F.col("v") / (F.col("b.n") - 1))
    s = one.withColumn("sr_star", star)
    z = prob_z(F.col("b.sharpe"), F.col("b.n"), F.col("b.skew"), F.col("b.kurtosis"), F.col("sr_star"))
    return s.select(F.col(f"b.{group}").alias("winner"), "sr_star", bound(z, norm_cdf).alias("dsr"))


def windows_needed(sharpe: Column, skew: Column, kurtosis: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Returns that a test of this Sharpe ratio needs for its power; null where it is not positive."""
    variance = F.greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, F.lit(0.0))
    z = norm_ppf(F.lit(1 - alpha)) + norm_ppf(F.lit(power))
    return F.when(sharpe > 0, 1 + variance * (z / F.when(sharpe > 0, sharpe)) * (z / F.when(sharpe > 0, sharpe)))


def dependent_mean(df: DataFrame, group: str, t: str, x: str, hours: float, blocks: int = 8, least: int = 4, most_hours: float = 60) -> DataFrame:
    """Student test of a dependent series' mean, the variance from equally weighted cosine projections.

    There is a projection for every ``blocks`` dependence lengths, ``least`` at least;
    their sum is corrected for what they miss of a latent first-order process.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(t).isNotNull())
    gaps = rows.select(group, t).distinct().withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(group).orderBy(t)))
    step = gaps.groupBy(group).agg(F.coalesce(F.percentile("gap", 0.5), F.lit(1.0)).alias("step"))
    base = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(t).alias("t0"), F.max(t).alias("t9")).join(step, group).filter("n >= 3")
    base = base.withColumn("span", F.col("t9") - F.col("t0") + F.col("step"))
    terms = F.least(F.greatest(F.lit(least), F.floor(F.col("span") / (blocks * hours * 3600))), F.col("n") - 1).cast("long")
    base = base.withColumn("df", terms)
    u = (F.col(t) - F.col("t0") + F.col("step") / 2) / F.col("span")
    each = rows.join(base, group).select(group, "n", "mean", "span", "df", u.alias("u"), (F.col(x) - F.col("mean")).alias("d"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("df"))).alias("j"))
    lam = each.groupBy(group, "n", "mean", "span", "df", "j").agg((F.sqrt(2 / F.col("n")) * F.sum(F.cos(F.pi() * F.col("j") * F.col("u")) * F.col("d"))).alias("lam"))
    tau = min(hours, most_hours) * 3600 / math.log(2)
    share = F.pi() * F.col("j") * tau / F.col("span")
    out = lam.groupBy(group, "n", "mean", "df").agg(F.avg(F.col("lam") * F.col("lam")).alias("lrv"), F.avg(1 / (1 + share * share)).alias("bias"))
    out = out.withColumn("se", F.sqrt(F.col("lrv") / F.col("bias") / F.col("n"))).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    return out.withColumn("p", t_cdf(F.col("t"), F.col("df"))).select(group, "n", "mean", "se", "t", "df", "bias", "p")


def vif_mean(df: DataFrame, group: str, x: str, vif: float, degrees: int) -> DataFrame:
    """Student test of the mean with a variance inflation measured elsewhere."""
    a = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("v")).filter("n >= 3")
    a = a.withColumn("se", F.sqrt(max(vif, 1.0) * F.col("v") / F.col("n"))).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    return a.withColumn("p", t_cdf(F.col("t"), F.lit(degrees))).select(group, "n", "mean", "se", "t", "p")


def batch_means(df: DataFrame, group: str, t: str, x: str, width: float, origin: float = 0) -> DataFrame:
    """Student test of the mean from blocks of time: the cluster variance of their sums, one degree of freedom less than blocks."""
    b = df.filter(F.col(x).isNotNull()).groupBy(group, F.floor((F.col(t) - origin) / width).alias("block")).agg(F.sum(x).alias("s"), F.count(F.lit(1)).alias("w"))
    m = b.groupBy(group).agg((F.sum("s") / F.sum("w")).alias("mean"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("blocks"))
    d = F.col("s") - F.col("w") * F.col("mean")
    v = b.join(m, group).groupBy(group, "mean", "n", "blocks").agg(F.sum(d * d).alias("ss")).filter("blocks >= 2")
    v = v.withColumn("variance", F.col("blocks") / (F.col("blocks") - 1) * F.col("ss") / F.col("n") / F.col("n"))
    v = v.withColumn("t", F.when(F.col("variance") > 0, F.col("mean") / F.sqrt("variance")))
    return v.withColumn("p", t_cdf(F.col("t"), F.col("blocks") - 1)).select(group, "blocks", "mean", "t", "p")


def zero_edge_up(up: Column, down: Column, cost: Column, fees: Column) -> Column:
    """The chance of the first outcome at which a position breaks even, in [0, 1]; null where both outcomes pay the same."""
    gap = up - down
    return F.when(F.abs(gap) > 1e-9, F.least(F.greatest((cost + fees - down) / F.when(F.abs(gap) > 1e-9, gap), F.lit(0.0)), F.lit(1.0)))


def repeated(df: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times, numbered ``b`` from 0: the resamples, a parameter."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def resampled(df: DataFrame, group: str, order: list[str], columns: list[str], n_draws: int, seed: str) -> DataFrame:
    """Rows of each group drawn with replacement, as many as it has, ``n_draws`` times: ``group, b`` and the columns of the rows drawn.

    Each place of each draw is a row that joins the row it picked by its number.
    """
    w = Window.partitionBy(group)
    numbered = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    slots = repeated(numbered.select(group, F.col("_i").alias("slot"), F.col("_n")), n_draws)
    picks = slots.select(group, "b", F.floor(uniform(F.lit(seed), group, "b", "slot") * F.col("_n")).cast("int").alias("_i"))
    return picks.join(numbered.select(group, "_i", *columns), [group, "_i"]).drop("_i")


def t_statistic(n: Column, mean: Column, sd: Column) -> Column:
    """``sqrt(n) * mean / sd``; infinite where only the spread is 0, and 0 where the mean is 0 too."""
    return F.when(sd > 0, mean / F.when(sd > 0, sd) * F.sqrt(n)).when(mean == 0, 0.0).otherwise(F.signum(mean) * F.lit(float("inf")))


def bootstrap_t(df: DataFrame, group: str, order: list[str], x: str, n_draws: int, level: float = 0.95, seed: str = "t") -> DataFrame:
    """Percentile-t interval ``lo, hi`` of each group's mean, and the share ``p`` of centred resamples with as great a t."""
    base = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd")).filter("n >= 3 and sd > 0")
    drawn = resampled(df, group, order, [x], n_draws, seed).groupBy(group, "b").agg(F.avg(x).alias("mb"), F.stddev_samp(x).alias("sb"))
    j = drawn.join(base, group).withColumn("tb", t_statistic(F.col("n"), F.round(F.col("mb") - F.col("m"), 12), F.round("sb", 12)))
    t = F.col("m") / F.col("sd") * F.sqrt("n")
    out = j.groupBy(group, "n", "m", "sd").agg(F.percentile("tb", (1 - level) / 2).alias("low"), F.percentile("tb", (1 + level) / 2).alias("high"), ((1 + F.sum(F.when(F.col("tb") >= t - 1e-9, 1).otherwise(0))) / (n_draws + 1)).alias("p"))
    se = F.col("sd") / F.sqrt("n")
    return out.select(group, (F.col("m") - F.col("high") * se).alias("lo"), (F.col("m") - F.col("low") * se).alias("hi"), "p")


def cluster_bootstrap(df: DataFrame, group: str, x: str, n_draws: int, seed: str = "c") -> DataFrame:
    """``estimate, se, p`` of the overall mean by resampling whole groups, which keeps the dependence inside them."""
    sums = df.groupBy(group).agg(F.sum(x).alias("s"), F.count(x).alias("c")).withColumn("_all", F.lit(0))
    drawn = resampled(sums, "_all", [group], ["s", "c"], n_draws, seed).groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"))
    se = drawn.agg(F.stddev_samp("m").alias("se"))
    out = sums.agg((F.sum("s") / F.sum("c")).alias("estimate")).crossJoin(se)  # one row each
    return out.withColumn("p", F.when(F.col("se") > 0, bound(-F.abs(F.col("estimate")) / F.col("se"), norm_cdf) * 2))


def sign_flips(df: DataFrame, group: str, order: list[str], x: str, lags: int, n_draws: int, seed: str = "s") -> DataFrame:
    """``q, p``: the Box-Pierce statistic of pairs within groups, against that of values with random signs."""
    mean = df.agg(F.avg(x).alias("_m"))
    centred = df.crossJoin(F.broadcast(mean)).withColumn("_d", F.col(x) - F.col("_m"))  # one row
    key = [group, *order]
    flipped = repeated(centred, n_draws + 1).withColumn("_s", F.when(F.col("b") == 0, 1.0).when(uniform(F.lit(seed), "b", *order) < 0.5, -1.0).otherwise(1.0) * F.col("_d"))
    w = Window.partitionBy("b", group).orderBy(*order)
    pairs = flipped.select("b", *key, "_s", *[F.lag("_s", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = [F.avg("_s").alias("mu"), F.var_pop("_s").alias("var")]
    for k in range(1, lags + 1):
        both = F.col(f"_l{k}").isNotNull()
        sums += [F.count(f"_l{k}").alias(f"n{k}"), F.sum(F.col("_s") * F.col(f"_l{k}")).alias(f"p{k}"), F.sum(F.when(both, F.col("_s") + F.col(f"_l{k}"))).alias(f"t{k}")]
    a = pairs.groupBy("b").agg(*sums)
    rho = lambda k: (F.col(f"p{k}") - F.col("mu") * F.col(f"t{k}") + F.col(f"n{k}") * F.col("mu") * F.col("mu")) / F.col(f"n{k}") / F.col("var")
    q = sum((F.col(f"n{k}") * rho(k) * rho(k) for k in range(1, lags + 1)), F.lit(0.0))
    stat = a.select("b", q.alias("q"))
    own = F.max(F.when(F.col("b") == 0, F.col("q")))
    one = F.broadcast(stat.filter("b = 0").select(F.col("q").alias("q0")))
    hits = F.sum(F.when((F.col("b") > 0) & (F.col("q") >= F.col("q0") * (1 - 1e-12)), 1).otherwise(0))
    return stat.crossJoin(one).agg(own.alias("q"), ((1 + hits) / (n_draws + 1)).alias("p"))  # one row


def outcome_draws(legs: DataFrame, group: str, order: list[str], n_draws: int, seed: str = "o") -> DataFrame:
    """``group, b, m, sd, n``: mean and spread of each group's returns with every window's outcome redrawn at its zero-edge chance.

    ``legs``: ``up, down, cost, fees`` a window; a window without risk returns 0.
    """
    p = zero_edge_up(F.col("up"), F.col("down"), F.col("cost"), F.col("fees"))
    rows = repeated(legs.filter("cost > 0").withColumn("p_up", p), n_draws)
    paid = F.when(uniform(F.lit(seed), "b", *order) < F.col("p_up"), F.col("up")).otherwise(F.col("down"))
    r = F.when(F.col("p_up").isNull(), 0.0).otherwise((paid - F.col("cost") - F.col("fees")) / F.col("cost"))
    return rows.withColumn("r", r).groupBy(group, "b").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.count(F.lit(1)).alias("n"))


def outcome_test(legs: DataFrame, group: str, order: list[str], n_draws: int, trials: int, seed: str = "o") -> DataFrame:
    """``p`` of each group's t among redrawn outcomes; ``sr_star``, the best Sharpe ratio that ``trials`` reach by luck; ``dsr`` against it."""
    own = legs.filter("cost > 0").withColumn("r", F.col("pnl") / F.col("cost")).groupBy(group).agg(F.count("r").alias("k"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("spread")).filter("k >= 3 and spread > 0")
    drawn = outcome_draws(legs, group, order, n_draws, seed).join(own, group).withColumn("null_sr", F.when(F.col("sd") > 0, F.col("m") / F.col("sd")))
    t, tb = F.col("mean") / F.col("spread") * F.sqrt("k"), t_statistic(F.col("n"), F.round("m", 12), F.round("sd", 12))
    some = drawn.groupBy(group, "k", "mean", "spread").agg(((1 + F.sum(F.when(tb >= t - 1e-9 * F.greatest(F.lit(1.0), F.abs(t)), 1).otherwise(0))) / (n_draws + 1)).alias("p"), F.avg("null_sr").alias("mu"), F.stddev_samp("null_sr").alias("null_sd"))
    some = some.withColumn("sr_star", F.col("mu") + expected_max_sharpe(F.lit(trials), F.col("null_sd") * F.col("null_sd")))
    below = drawn.join(some.select(group, "mu", "sr_star"), group).groupBy(group).agg(F.avg((F.col("null_sr") - F.col("mu") + F.col("sr_star") < F.col("mean") / F.col("spread")).cast("double")).alias("dsr"))
    return some.join(below, group).select(group, "p", (F.col("mean") / F.col("spread")).alias("sharpe"), "null_sd", "sr_star", "dsr")


def within_beta(cells: DataFrame, row: str, y: str, x: str) -> DataFrame:
    """``beta``: the pooled slope of ``y`` on ``x``, both less their row's mean."""
    w = Window.partitionBy(row)
    c = cells.withColumn("_y", F.col(y) - F.avg(y).over(w)).withColumn("_x", F.col(x) - F.avg(x).over(w))
    return c.agg(F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x"))).alias("beta"))


def adjusted_profile(cells: DataFrame, row: str, cell: str, y: str, x: str) -> DataFrame:
    """``beta`` and ``share``: how much of the variance of cell means (within rows) the other variable explains."""
    w = Window.partitionBy(row)
    b = F.broadcast(within_beta(cells, row, y, x))
    c = cells.withColumn("_y", F.col(y) - F.avg(y).over(w)).withColumn("_x", F.col(x) - F.avg(x).over(w)).crossJoin(b)  # one row
    means = c.groupBy(cell, "beta").agg(F.avg("_y").alias("raw"), F.avg(F.col("_y") - F.col("beta") * F.col("_x")).alias("rest"))
    return means.groupBy("beta").agg((1 - F.try_divide(F.var_samp("rest"), F.var_samp("raw"))).alias("share"))


def block_draws(rows: DataFrame, row: str, length: int, n_draws: int, seed: str = "b") -> DataFrame:
    """``b, place, row``: rows in circular blocks of ``length`` with random starts, as many as there are, ``n_draws`` times. Rows are periods in order."""
    numbered = rows.select(row).distinct().withColumn("_all", F.lit(0))
    w = Window.partitionBy("_all")
    numbered = numbered.withColumn("_i", F.row_number().over(w.orderBy(row)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    block = F.floor(F.col("_i") / length)
    start = F.floor(uniform(F.lit(seed), "b", block.cast("long")) * F.col("_n"))
    at = F.pmod(start + F.col("_i") % length, F.col("_n")).cast("int")
    slots = repeated(numbered, n_draws).select("b", F.col("_i").alias("place"), at.alias("_i"))
    return slots.join(numbered.select("_i", row), "_i").select("b", "place", row)


def level_ci(cells: DataFrame, row: str, cell: str, x: str, length: int, n_draws: int, seed: str = "b") -> DataFrame:
    """``cell, mean, se, blocks``: means of cells over rows, their spread over block resamples."""
    drawn = block_draws(cells, row, length, n_draws, seed).join(cells, row).groupBy("b", cell).agg(F.avg(x).alias("m")).groupBy(cell).agg(F.stddev_samp("m").alias("se"))
    mean = cells.groupBy(cell).agg(F.avg(x).alias("mean"), F.count(x).alias("rows"))
    return mean.join(drawn, cell).select(cell, "mean", "se", "rows")


def profile_test(cells: DataFrame, row: str, cell: str, x: str, length: int, n_draws: int, seed: str = "b") -> DataFrame:
    """``stat, p``: how unequal cell means are within rows, against centred block resamples. Rows are complete."""
    e = cells.withColumn("_e", F.col(x) - F.avg(x).over(Window.partitionBy(row)))
    e = e.withColumn("_c", F.col("_e") - F.avg("_e").over(Window.partitionBy(cell)))

    def stat(df: DataFrame, keys: list[str], v: str) -> DataFrame:
        a = df.groupBy(*keys, cell).agg(F.avg(v).alias("m"), F.var_samp(v).alias("v"), F.count(F.lit(1)).alias("k"))
        return a.groupBy(*keys).agg(F.sum(F.try_divide(F.col("m") * F.col("m") * F.col("k"), F.col("v"))).alias("q"))

    own = F.broadcast(stat(e.withColumn("_one", F.lit(0)), ["_one"], "_e").select(F.col("q").alias("stat")))
    drawn = stat(block_draws(cells, row, length, n_draws, seed).join(e.select(row, cell, "_c"), row), ["b"], "_c")
    return drawn.crossJoin(own).groupBy("stat").agg(((1 + F.sum(F.when(F.col("q") >= F.col("stat"), 1).otherwise(0))) / (n_draws + 1)).alias("p"))  # one row


def path_mean_variance(df: DataFrame, y: str, rho: Column) -> DataFrame:
    """Variance of the mean of paths that correlate by ``rho`` on average, and the number of independent ones as precise."""
    a = df.agg(F.count(y).alias("paths"), F.avg(y).alias("mean"), F.var_samp(y).alias("variance"), F.first(rho).alias("rho"))
    a = a.withColumn("variance_of_mean", F.col("variance") * (1 + (F.col("paths") - 1) * F.col("rho")) / F.col("paths"))
    return a.withColumn("effective_paths", F.try_divide(F.col("variance"), F.col("variance_of_mean")))


# MacKinnon's (2010) response surface of critical values with a constant, and with a trend (one variable).
ADF_CRITICAL = {
    "c": {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)},
    "ct": {0.01: (-3.95877, -9.0531, -28.428, -134.155), 0.05: (-3.41049, -4.3904, -9.036, -45.374), 0.10: (-3.12705, -2.5856, -3.925, -22.380)},
}
# MacKinnon's (1994) approximation of p-values with a constant: bounds, and polynomials below and above the middle one.
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_critical(n: Column, level: float = 0.05, regression: str = "c") -> Column:
    b = ADF_CRITICAL[regression][level]
    return b[0] + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n)


def adf_pvalue(t: Column) -> Column:
    """Approximate p-value of a Dickey-Fuller statistic with a constant."""
    poly = lambda c: sum((k * F.pow(t, F.lit(float(i))) for i, k in enumerate(c)), F.lit(0.0))
    z = F.when(t <= ADF_STAR, poly(ADF_SMALL)).otherwise(poly(ADF_LARGE))
    return F.when(t > ADF_MAX, 1.0).when(t < ADF_MIN, 0.0).otherwise(bound(z, norm_cdf))


def rare_labels(df: DataFrame, label: str, share: float = 0.05) -> DataFrame:
    """Labels that go when the rarest is dropped again and again while its share is at most ``share`` and three are left.

    The order of dropping is that of the counts, so one pass over the labels decides.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    up = Window.partitionBy("_all").orderBy("n", label)
    left = F.sum("n").over(up.rowsBetween(0, Window.unboundedFollowing))
    more = F.count(F.lit(1)).over(up.rowsBetween(0, Window.unboundedFollowing))
    c = counts.withColumn("_goes", ((F.col("n") / left <= share) & (more >= 3)).cast("int"))
    return c.withColumn("_goes", F.min("_goes").over(up.rowsBetween(Window.unboundedPreceding, 0))).filter("_goes = 1").select(label, "n")
