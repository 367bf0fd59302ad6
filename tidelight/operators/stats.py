"""Moments, ratios, serial dependence, drawdowns and multiple-testing corrections, group by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.functions.betting import prob_z
from tidelight.functions.maths import bound, norm_cdf


def summary(df: DataFrame, group: str, ret: str) -> DataFrame:
    """n, mean, sd, Sharpe, skew, kurtosis (population), PSR, log growth, hit rate, CVaR and Jarque-Bera of each group.

    The mean of decimal returns is that of their exact sum, in whatever order they come.
    """
    mean = F.avg(ret)
    if df.schema[ret].dataType.typeName() == "decimal":
        df = df.withColumn("_exact", F.col(ret)).withColumn(ret, F.col(ret).cast("double"))
        mean = F.sum("_exact").cast("double") / F.count(ret)
    m = df.groupBy(group).agg(F.avg(ret).alias("_m"))
    d = F.col(ret) - F.col("_m")
    a = df.join(m, group).groupBy(group).agg(
        F.count(ret).alias("n"), mean.alias("mean"), F.stddev_samp(ret).alias("sd"), F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"),
        F.avg(F.ln(1 + F.col(ret))).alias("log_growth"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )
    skew, kurt, sharpe = F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))), F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")), F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd"))
    out = a.withColumn("skew", skew).withColumn("kurtosis", kurt).withColumn("sharpe", sharpe)
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4)
    return out.withColumn("psr", bound(prob_z(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurtosis")), norm_cdf)).withColumn("jarque_bera", jb).drop("m2", "m3", "m4")


def cvar(df: DataFrame, group: str, ret: str, order: list[str], level: float) -> DataFrame:
    """Mean of the worst ``ceil(level * n)`` returns."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(ret, *order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("_r") <= F.ceil(level * F.col("_n"))).groupBy(group).agg(F.avg(ret).alias("cvar"))


def lag_products(df: DataFrame, group: str, order: list[str], x: str, lags: int) -> DataFrame:
    """``group, n, var, lag, c``: mean-removed lag products within groups, one window pass for all lags."""
    every = Window.partitionBy(group)
    w = every.orderBy(*order)
    d = df.withColumn("_d", F.col(x) - F.avg(x).over(every))
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("_d") * F.lag("_d", k).over(w)).alias("p")) for k in range(lags + 1)])
    return d.select(group, pairs.alias("_a")).select(group, F.explode("_a").alias("_p")).select(group, "_p.*").groupBy(group, "lag").agg(F.sum("p").alias("c"), F.count("p").alias("pairs"))


def ljung_box(df: DataFrame, group: str, order: list[str], x: str, lags: int) -> DataFrame:
    """``q`` of Ljung-Box, ``bp`` of Box-Pierce with within-group pairs, ``rho1``, and Newey-West ``t`` with Bartlett weights."""
    p = lag_products(df, group, order, x, lags)
    base = p.filter("lag = 0").select(group, F.col("c").alias("_v"), F.col("pairs").alias("n"))
    j = p.filter("lag > 0").join(base, group)
    rho = F.try_divide(F.col("c"), F.col("_v"))
    weight = 1 - F.col("lag") / (lags + 1)
    agg = j.groupBy(group, "n", "_v").agg(
        F.sum(rho * rho / (F.col("n") - F.col("lag"))).alias("_q"), F.sum(F.pow(F.try_divide(F.col("c") / F.col("pairs"), F.col("_v") / F.col("n")), F.lit(2.0)) * F.col("pairs")).alias("bp"),
        F.max(F.when(F.col("lag") == 1, rho)).alias("rho1"), F.sum(2 * weight * F.col("c")).alias("_hac"),
    )
    mean = df.groupBy(group).agg(F.avg(x).alias("_m"))
    long_run = (F.col("_v") + F.col("_hac")) / F.col("n")
    return agg.join(mean, group).select(group, "n", (F.col("n") * (F.col("n") + 2) * F.col("_q")).alias("q"), "bp", "rho1", F.when(long_run > 0, F.col("_m") / F.sqrt(F.when(long_run > 0, long_run) / F.col("n"))).alias("nw_t"))


def holm(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """``holm`` and ``bh``: step-down and false-discovery adjusted p-values over the whole (small) family; null p-values stay out."""
    known = df.filter(F.col(p).isNotNull()).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one")
    up = w.orderBy(p, *order)
    ranked = known.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(w))
    run = up.rowsBetween(Window.unboundedPreceding, 0)
    back = w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("holm", F.least(F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(run), F.lit(1.0)))
    return out.withColumn("bh", F.least(F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back), F.lit(1.0))).drop("_one", "_r", "_m")


def drawdowns(df: DataFrame, group: str, order: str, pnl: str) -> DataFrame:
    """Marks are told apart to nine digits. One row for each high-water mark that is left: ``start`` (its time), ``depth`` below it, and ``under`` until the next mark (null: never)."""
    w = Window.partitionBy(group).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("_eq", F.round(F.sum(pnl).over(run), 9)).withColumn("_high", F.max("_eq").over(run))
    marks = e.groupBy(group, "_high").agg(F.min(order).alias("start"), F.min("_eq").alias("_low"))
    nxt = F.lead("start").over(Window.partitionBy(group).orderBy("_high"))
    return marks.withColumn("under", nxt - F.col("start")).withColumn("depth", F.col("_high") - F.col("_low")).filter("depth > 0").select(group, "start", "depth", "under")


def concentration(df: DataFrame, group: str, ret: str) -> DataFrame:
    """HHI of gains and of losses, from 0 (even) to 1 (one bet); null for two bets or fewer."""

    def hhi(cond: Column) -> Column:
        x = F.when(cond, F.col(ret))
        n, share = F.count(x), F.try_divide(F.sum(x * x), F.sum(x) * F.sum(x))
        return F.when(n > 2, (share - 1 / n) / (1 - 1 / n))

    return df.groupBy(group).agg(hhi(F.col(ret) > 0).alias("hhi_gains"), hhi(F.col(ret) < 0).alias("hhi_losses"))


def average_rank(x: Column, by: list[str]) -> Column:
    """One-based rank within ``by``; ties share the mean of their places. One sort gives both parts."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def safe_corr(a: Column, b: Column) -> Column:
    """Correlation from sums; null where a side has no spread."""
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    vx, vy = F.avg(x * x) - F.avg(x) * F.avg(x), F.avg(y * y) - F.avg(y) * F.avg(y)
    return F.when((n >= 2) & (vx > 1e-14) & (vy > 1e-14), cov / F.sqrt(F.when(vx > 0, vx)) / F.sqrt(F.when(vy > 0, vy)))


def runs(df: DataFrame, group: str, order: list[str], sign: str) -> DataFrame:
    """Rows with ``run``: the length so far of the run of equal non-zero signs."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("_new", F.when(F.lag(sign).over(w).isNull() | (F.col(sign) != F.lag(sign).over(w)), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(group, "_island").orderBy(*order))
    return marked.withColumn("run", F.when(F.col(sign) == 0, 0).otherwise(n)).drop("_new", "_island")


def power_mean(x: Column, p: Column, q: float) -> Column:
    """Weighted power mean as an aggregate; the geometric mean at 0, the least and greatest at the infinities. Weights sum to 1."""
    if q == float("-inf"):
        return F.min(F.when(p > 0, x))
    if q == float("inf"):
        return F.max(F.when(p > 0, x))
    if q == 0:
        return F.exp(F.sum(F.when(p > 0, p * F.ln(x))))
    return F.pow(F.sum(F.when(p > 0, p * F.pow(x, F.lit(float(q))))), F.lit(1.0 / q))


def effective_number(p: Column, q: float) -> Column:
    """How many equal shares are as diverse; at 1 the exponential of the entropy."""
    return 1 / power_mean(p, p, q - 1)


def entropy_concentration(p: Column) -> Column:
    """0 for equal shares, near 1 for a single one."""
    return 1 - F.exp(F.sum(F.when(p > 0, -p * F.ln(p)))) / F.count(p)


def participation(df: DataFrame, series: str, t: str, x: str) -> DataFrame:
    """``effective, mean_corr``: how many independent series are as diverse (n * n over the squared correlations), and their mean correlation.

    A place in time where a series has no row counts as 0. Correlations of all pairs
    come from the products of places in time, so the work grows with the series and not
    with their pairs; places in time are bounded.
    """
    times = sorted(r[0] for r in df.select(t).distinct().collect())
    place = {k: i for i, k in enumerate(times)}

    def products(batches):
        """Sums over this task's series: of products of places, of each place, and their number (at place -1)."""
        total, gram, n = np.zeros(len(times)), np.zeros((len(times), len(times))), 0
        for batch in batches:
            for row in batch.column(0).to_pylist():
                v = np.zeros(len(times))
                for point in row:
                    v[place[point[t]]] += point[x]
                v -= v.mean()
                size = float(v @ v)
                if size > 1e-18:
                    v /= np.sqrt(size)  # of length 1: correlations are dot products
                    total, gram, n = total + v, gram + np.outer(v, v), n + 1
        i, j = np.indices(gram.shape).reshape(2, -1)
        columns = [np.r_[i, np.arange(len(times)), -1], np.r_[j, np.full(len(times), -1), -1], np.r_[gram.ravel(), total, n]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.float64())], ["i", "j", "v"])

    rows = df.groupBy(series).agg(F.collect_list(F.struct(t, x)).alias("row")).select("row").mapInArrow(products, "i long, j long, v double")
    sums = rows.groupBy("i", "j").agg(F.sum("v").alias("v"))
    square = F.col("v") * F.col("v")
    one = sums.agg(F.sum(F.when(F.col("j") >= 0, square)).alias("gg"), F.sum(F.when((F.col("j") < 0) & (F.col("i") >= 0), square)).alias("ss"), F.max(F.when(F.col("i") < 0, F.col("v"))).alias("n"))
    return one.select(F.try_divide(F.col("n") * F.col("n"), F.col("gg")).alias("effective"), F.try_divide(F.col("ss") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_corr"))
