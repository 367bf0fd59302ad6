"""Strategies, risk limits, fair prices, simulations, portfolios and learning bars against hand-worked cases and brute force."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.functions import distributions as dist
from tidelight.operators import bars, evaluation, execution, fair, montecarlo, portfolio, sequences, strategies
from tidelight.operators.strategies import Book, Limits, Market, Order, RiskManaged, run_account, run_window
from tidelight.plans import trading_queries


def quote(t, **kw):
    return {"t": t, "fair": 0.6, "sigma": 1e-4, "ask": 0.5, "bid": 0.48, "ask_age": 1.0, "bid_age": 1.0, "imb": 0.0, "imb_age": 1.0} | kw


def trade(ts, p, sign=1, shares=100.0):
    return {"ts": ts, "sign": sign, "p_up": p, "shares": shares}


def test_quantiles_and_student(spark):
    ps = [1e-6, 0.01, 0.3, 0.5, 0.77, 0.999]
    d = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double")
    got = [r[0] for r in d.select(dist.norm_ppf(F.col("p"))).collect()]
    assert got[:-2] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-9) and got[-2:] == [None, None]
    d = spark.createDataFrame([(1.3, 1), (-2.0, 2), (0.0, 5), (3.0, 3)], "t double, df long")
    got = [r[0] for r in d.select(dist.t_cdf(F.col("t"), F.col("df"))).collect()]
    assert got == pytest.approx([0.5 + math.atan(1.3) / math.pi, 0.5 - 1 / math.sqrt(6) / 1, 0.5, 0.9711656], abs=2e-3)


def test_taker_edges_and_sizes():
    s = strategies.ProbTaker()
    assert s.decide(quote(4), Book(), 1000) == [] and s.decide(quote(5, fair=0.53), Book(), 1000) == [] and s.decide(quote(5, ask_age=9.0, bid_age=9.0), Book(), 1000) == []
    (order,) = s.decide(quote(5), Book(), 1000)
    paid = 0.51 + 0.07 * 0.51 * 0.49
    assert (order.side, order.limit) == ("up", 0.51) and order.shares * paid == pytest.approx(min(50, 0.25 * (0.6 - paid) / (1 - paid) * 1000))
    held = Book(fills=[(1.0, Order("down", 10, 0.5), 10, 0.5, 0.1)])
    assert s.decide(quote(9), held, 1000) == []


def test_other_strategies():
    flow = strategies.FlowTaker()
    assert flow.decide(quote(9, imb=0.4), Book(), 1) == [] and flow.decide(quote(9, imb=0.6, imb_age=4.0), Book(), 1) == []
    assert [o.side for o in flow.decide(quote(9, imb=0.6), Book(), 1)] == ["up"] and flow.decide(quote(9, imb=-0.9), Book(), 1) == []
    maker = strategies.FairMaker()
    assert [(o.side, o.limit, o.maker) for o in maker.decide(quote(10, ask=0.61, bid=0.59), Book(), 1)] == [("up", 0.57, True), ("down", 0.37, True)]
    assert [o.side for o in maker.decide(quote(10, ask=0.55, bid=0.5), Book(), 1)] == ["down"] and maker.decide(quote(11), Book(), 1) == []
    early = strategies.OpenFairTaker()
    assert [o.side for o in early.decide(quote(3, fair=0.7), Book(), 1)] == ["up"] and early.decide(quote(3, fair=0.7), Book(live=[(9, Order("up", 1, 0.5))]), 1) == []
    end = strategies.EndgameMaker()
    assert [(o.side, o.limit) for o in end.decide(quote(275, fair=0.001), Book(), 1)] == [("down", 0.99)] and end.decide(quote(275, fair=0.9), Book(), 1) == []


def test_fills_share_prints_and_respect_time():
    market, used = Market(), [0.0] * 4
    prints = [trade(14.0, 0.5), trade(15.0, 0.5, shares=20), trade(16.0, 0.52), trade(18.5, 0.5, sign=-1)]
    taken = strategies.fill(Order("up", 30, 0.51, rests=3), 9, prints, used, market)
    assert [(f[0], f[2], f[3]) for f in taken] == [(15.0, 10.0, 0.5)]
    assert strategies.fill(Order("up", 30, 0.51, rests=3), 9, prints, used, market) == []
    rested = strategies.fill(Order("up", 30, 0.51, True, 5), 9, prints, used, Market(rebate=0.2))
    assert [(f[0], f[2], f[3]) for f in rested] == [(18.5, 30.0, 0.51)] and rested[0][4] == pytest.approx(-0.2 * 30 * 0.07 * 0.51 * 0.49)


def test_risk_stops():
    always = type("Always", (), {"decide": lambda self, q, book, bankroll: [Order("up", 10, 0.5)]})()
    day = lambda n: n * 86400 - 8 * 3600
    r = RiskManaged(always, Limits(daily_loss=0.1))
    r.on_result(day(10), -150.0, 850.0)
    assert len(r.decide(quote(4), Book(), 850, day(10) + 300)) == 1  # not known before five seconds
    assert r.decide(quote(5), Book(), 850, day(10) + 300) == [] and r.vetoed == {"daily_loss": 1}
    assert len(r.decide(quote(5), Book(), 850, day(11))) == 1
    r = RiskManaged(always, Limits(drawdown=0.1, pause=1000.0, losses=2, cooldown=400.0))
    r.on_result(0, -50.0, 950.0)
    r.on_result(300, -60.0, 890.0)
    assert r.decide(quote(10), Book(), 890, 600) == [] and r.vetoed == {"drawdown": 1}
    assert r.paused_until == 1605 and r.resting_until == 1005 and len(r.decide(quote(6), Book(), 890, 1600)) == 1 and r.peak == 890
    r = RiskManaged(always, Limits(window_cost=0.005, spread=1.0))
    assert r.decide(quote(9, ask=0.5, bid=0.48), Book(), 1000) == [] and r.vetoed == {"spread": 1}
    (o,) = r.decide(quote(9, ask=0.5, bid=0.49), Book(), 1000)
    assert o.shares * o.unit == pytest.approx(5.0)


def test_accounts_compound_until_ruin(spark):
    windows = [{"start": 300 * k, "y": 0.0, "quotes": [quote(9)], "prints": [trade(16.0, 0.5, shares=1000.0)]} for k in range(40)]
    out = run_account(lambda: strategies.ProbTaker(most_stake=1e9, most_cost=1e9, most_share=0.5, kelly=5.0), windows, Market(bankroll=1000.0))
    assert all(b["bankroll"] == pytest.approx(a["bankroll"] + a["pnl"]) for a, b in zip(out, out[1:], strict=False)) and out[-1]["bankroll"] + out[-1]["pnl"] < 100 + 60
    assert sum(len(run_window(strategies.ProbTaker(), 0, w["quotes"], w["prints"], 1000, Market()).fills) for w in windows[:1]) == 1
    got = trading_queries.market_windows(spark, "/root/testdata/sf0.001")
    assert strategies.backtest(got, "g", strategies.ProbTaker).columns[:2] == ["g", "start"]
    assert strategies.backtest(got.filter("false"), "g", strategies.ProbTaker).count() == 0


def test_fair_stream_equals_windows(spark):
    r = random.Random(5)
    x, closes = 100.0, []
    for s in range(0, 700):
        x *= math.exp(r.gauss(0, 1e-3))
        closes.append(("a", s, x))
    d = spark.createDataFrame([c for c in closes if c[1] not in (500, 501)], "g string, sec long, close double")
    windows = spark.createDataFrame([("a", 200), ("a", 350), ("a", 520)], "g string, start long")
    inputs = fair.window_inputs(d, windows, "g", 2, 30.0, 100, 20)
    got = {(r["start"], r["t"]): r["fair"] for r in fair.fair_prices(inputs, 1.2, 1e-4, 1e-5).collect()}
    stream = fair.FairStream(30.0, 1.2, 1e-4, 2, 1e-5, 100)
    for start in (200, 350):
        stream.watch(start, 20)
    seen = 0
    for _, s, price in closes[:500]:
        stream.feed(s + 1, price)
        for start in (200, 350):
            t = s + 1 - start
            if 0 <= t < 100:
                assert stream.fair(start) == pytest.approx(got[start, t], abs=1e-9)
                seen += 1
    assert seen == 200 and all(got[520, t] is None for t in range(100))
    best = fair.fit_fair(inputs.filter("start < 500").withColumn("y", (F.col("t") % 2).cast("double")), 1e-5, rounds=2, points=3)
    assert set(best) == {"multiple", "basis", "log_loss"} and best["log_loss"] > 0


def test_simulations_repeat_and_match(spark):
    f = lambda rng: np.nanmax(sequences.bsadf(montecarlo.random_walk(rng, 40)))
    draws = [r["stat"] for r in montecarlo.simulated(spark, 30, f, 3).orderBy("draw").collect()]
    assert draws == [f(np.random.default_rng((3, d))) for d in range(30)]
    got = [r["critical"] for r in montecarlo.critical_values(montecarlo.simulated(spark, 30, f, 3)).orderBy("quantile").collect()]
    assert got == pytest.approx(np.quantile(draws, montecarlo.QUANTILES).tolist())
    y = np.cumsum(np.random.default_rng(1).standard_normal(30))
    z = montecarlo.wild_walk(y, np.random.default_rng(2))
    assert np.abs(np.diff(z)) == pytest.approx(np.abs(np.diff(y) - np.diff(y).mean())) and z[0] == y[0]


def test_portfolios(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((200, 4)) @ r.standard_normal((4, 4))
    d = spark.createDataFrame([(t, f"a{k}", float(x[t, k])) for t in range(200) for k in range(4)], "t int, asset string, x double")
    names, cov = portfolio.covariance(d, "t", "asset", "x")
    assert names == ["a0", "a1", "a2", "a3"] and np.allclose(cov, np.cov(x, rowvar=False))
    values, share = portfolio.component_risk(cov, np.full(4, 0.25))
    assert share.sum() == pytest.approx(1) and np.allclose(values, np.linalg.eigvalsh(cov))
    assert portfolio.concentration(np.full(4, 0.25)) == pytest.approx(0) and portfolio.concentration(np.array([1.0, 0, 0, 0])) == pytest.approx(0.75)
    w = portfolio.least_variance(cov)
    others = r.dirichlet(np.ones(4), 5000)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and w @ cov @ w <= np.einsum("ni,ij,nj->n", others, cov, others).min() + 1e-9
    assert portfolio.leading(np.array([4.0, 3, 2, 1]), 0.7) == 2
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    out, fit = portfolio.orthogonal_features(rows, ["a", "b", "c", "d"], 0.9)
    pcs = np.array([[row[f"pc{k + 1}"] for k in range(len(fit["eigenvalues"]))] for row in out.collect()])
    assert np.allclose(np.cov(pcs, rowvar=False, bias=True), np.diag(fit["eigenvalues"]), atol=1e-9) and fit["explained"] >= 0.9
    assert portfolio.weighted_tau(np.array([4.0, 3, 2, 1]), np.array([1, 2, 3, 4])) == pytest.approx(1) and portfolio.weighted_tau(np.array([1.0, 2, 3, 4]), np.array([1, 2, 3, 4])) == pytest.approx(-1)
    pnl, stake = r.normal(1, 2, 300), np.full(300, 10.0)
    size = portfolio.capacity(pnl, stake, 1e-4, 2.0, 52)
    net = size * pnl - 1e-4 * (size * stake) ** 2
    assert net.mean() / net.std(ddof=1) * math.sqrt(52) == pytest.approx(2.0) and portfolio.capacity(pnl, stake, 0.0, 2.0, 52) == math.inf and portfolio.capacity(pnl, stake, 1e-4, 99, 52) == 0


def test_learning_bars_equal_a_plain_loop():
    r = np.random.default_rng(7)
    v, b = r.integers(1, 50, 500).astype(float), np.where(r.random(500) < 0.6, 1, -1)
    rule = bars.Imbalance(20.0, mean=8.0, sd=28.0)
    length, m, m2, rate, n, theta, limit, bar, want = 20.0, 8.0, 28.0**2 + 64, 2 / 201, 0, 0.0, 0.0, 0, []
    for x in v * b:
        if n == 0:
            limit, theta = max(length * abs(m), math.sqrt(max(m2 - m * m, 0)) * math.sqrt(length)), 0.0
        want.append(bar)
        n, theta, m, m2 = n + 1, theta + x, m + rate * (x - m), m2 + rate * (x * x - m2)
        if abs(theta) >= limit:
            length, bar, n = rule.next_length(length, n), bar + 1, 0
    assert rule.assign(v, b, v * 0).tolist() == want and bar > 3


def test_match_entropy_equals_a_plain_search():
    r = random.Random(4)
    for n in (0, 1, 2, 9, 40, 61):
        text = [r.choice("abc") for _ in range(n)]
        total = 0.0
        for i in range(1, n // 2 + 1):
            best = 0
            for start in range(i):
                k = 0
                while k < i and i + k < n and text[start + k] == text[i + k]:
                    k += 1
                best = max(best, k)
            total += math.log2(i + 1) / (best + 1)
        got = sequences.kontoyiannis(text)
        assert math.isnan(got) if n < 2 else got == pytest.approx(total / (n // 2))


def test_sequential_bootstrap_follows_its_chances():
    t0, t1 = np.array([0, 0, 6]), np.array([4, 4, 9])
    counts = np.zeros(3)
    for seed in range(3000):
        first, second = sequences.sequential_bootstrap(t0, t1, 2, seed)
        if first == 0:
            counts[second] += 1
    assert counts / counts.sum() == pytest.approx([0.25, 0.25, 0.5], abs=0.04)


def test_zero_prices_give_null_returns(spark):
    from tidelight.operators import labels

    path = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 9.0), ("b", 1, 2.0), ("b", 2, 0.0)], "g string, pt long, price double")
    events = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0), ("b", 0, 1.0)], "g string, t long, p double")
    got = sorted(tuple(r) for r in labels.triple_barrier(events, path, "g", "t", "p", "pt", "price", 0.5, 0.5, 3).select("g", "t", "touch", "side").collect())
    assert got == [("a", 0, 3, 0), ("a", 1, 3, 0), ("b", 0, 1, 1)]


def test_evaluation_edges(spark):
    one = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, None)], "g string, t long, x double")
    assert evaluation.dependent_mean(one, "g", "t", "x", 1.0).count() == 0 and evaluation.vif_mean(one, "g", "x", 1.5, 4).count() == 0
    assert evaluation.batch_means(one, "g", "t", "x", 1).first()["t"] is None
    legs = spark.createDataFrame([(1.0, 1.0, 0.5, 0.0), (1.0, 0.0, 0.4, 0.1), (1.0, 0.0, 2.0, 0.0)], "up double, down double, cost double, fees double")
    assert [r[0] for r in legs.select(evaluation.zero_edge_up(*(F.col(c) for c in legs.columns))).collect()] == [None, 0.5, 1.0]
    labels = spark.createDataFrame([(k,) for k, n in {"a": 1, "b": 2, "c": 60, "d": 40}.items() for _ in range(n)], "k string")
    assert [r["k"] for r in evaluation.rare_labels(labels, "k", 0.05).orderBy("k").collect()] == ["a", "b"]
    held = spark.createDataFrame([(1, 9.0), (2, -8.0), (3, 4.0)], "t int, pnl double").withColumn("g", F.lit(1))
    assert execution.time_weighted_return(held, "g", ["t"], "pnl", 10.0, 2.0).first()["twrr"] == pytest.approx(1.5**0.5 - 1)
    assert execution.time_weighted_return(held, "g", ["t"], "pnl", -2.0, 2.0).first()["twrr"] == -1
