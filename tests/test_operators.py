"""Hand-worked and boundary cases of the operators."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.functions import betting, maths
from tidelight.operators import asof, bars, labels, sequences, spans, stats
from tidelight.plans import model_queries, sequence_queries
from tidelight.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tick_bars_drop_the_rest(spark):
    tape = spark.createDataFrame([(1, i, p, q, s) for i, (p, q, s) in enumerate([(0.5, 10.0, 1), (0.6, 20.0, 1), (0.4, 30.0, -1), (0.5, 5.0, -1), (0.7, 5.0, 1), (0.6, 10.0, 1), (0.9, 1.0, 1)])], "g int, ts int, price double, size double, sign int")
    got = bars.tick_bars(tape, "g", ["ts"], 3).orderBy("bar").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["n_ticks"]) for r in got] == [(0.5, 0.6, 0.4, 0.4, 3), (0.5, 0.7, 0.5, 0.6, 3)]
    assert got[0]["vwap"] == pytest.approx((5 + 12 + 12) / 60) and got[0]["volume_imbalance"] == 0.0 and got[1]["tick_imbalance"] == 1
    assert bars.tick_bars(tape.filter("false"), "g", ["ts"], 3).count() == 0


def test_size_bars_drop_their_overshoot():
    v = np.array([4.0, 4, 4, 1, 9, 10, 10])
    assert bars.Size(10.0).assign(v, v * 0 + 1, v * 0).tolist() == [0, 0, 0, 1, 1, 2, 3]


def test_adaptive_rules_close_bars():
    rng = np.random.default_rng(0)
    b = rng.choice([-1, 1], 400)
    v = rng.uniform(1, 5, 400)
    for rule in (bars.Imbalance(20.0, mean=0.1, sd=3.0), bars.Run(20.0, p_buy=0.5, v_buy=3.0, v_sell=3.0, v2=10.0)):
        out = rule.assign(v, b, np.zeros(400))
        assert (np.diff(out) >= 0).all() and out[-1] > 3


def test_norm_cdf_is_exact(spark):
    xs = [-8.0, -3.1, -0.2, 0.0, 0.7, 2.5, 7.2]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", maths.norm_cdf(F.col("x")).alias("p")).collect()
    n = statistics.NormalDist()
    assert all(math.isclose(r["p"], n.cdf(r["x"]), abs_tol=2e-16, rel_tol=1e-12) for r in got)


def test_fees(spark):
    r = spark.range(1).select(betting.taker_fee(F.lit(100.0), F.lit(0.5)).alias("a"), betting.taker_fee(F.lit(0.0001), F.lit(0.5)).alias("b"), betting.taker_fee(F.lit(10.0), F.lit(1.0)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (1.75, 1e-5, 0.0)


def test_asof_directions_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 0), (2, 5)], "g int, t int")
    right = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (1, 7, "c", 3), (3, 5, "z", 4)], "g int, rt int, v string, o int")
    back = asof.asof_join(left, right, "g", "t", "rt", ["v"], order=["o"])
    assert rows(back.fillna({"v": "-", "matched_time": -1}), "g", "t", "v", "matched_time") == [(1, 0, "-", -1), (1, 5, "b", 5), (1, 10, "c", 7), (2, 5, "-", -1)]
    strict = asof.asof_join(left, right, "g", "t", "rt", ["v"], strict=True, order=["o"])
    assert rows(strict.fillna({"v": "-"}), "g", "t", "v") == [(1, 0, "-"), (1, 5, "-"), (1, 10, "c"), (2, 5, "-")]
    ahead = asof.asof_join(left, right, "g", "t", "rt", ["v"], "forward", order=["o"])
    assert rows(ahead.fillna({"v": "-"}), "g", "t", "v") == [(1, 0, "a"), (1, 5, "a"), (1, 10, "-"), (2, 5, "-")]


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_buckets_change_nothing(spark, direction):
    r = np.random.default_rng(1)
    left = spark.createDataFrame([(int(g), int(t), i) for i, (g, t) in enumerate(zip(r.integers(0, 3, 200), r.integers(0, 1000, 200), strict=True))], "g int, t int, i int")
    right = spark.createDataFrame([(int(g), int(t), i) for i, (g, t) in enumerate(zip(r.integers(0, 3, 60), r.integers(0, 1000, 60), strict=True))], "g int, rt int, v int")
    one = asof.asof_join(left, right, "g", "t", "rt", ["v"], direction, order=["v"])
    many = asof.asof_join(left, right, "g", "t", "rt", ["v"], direction, order=["v"], bucket_seconds=37)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_merge_spans_touching(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 3, 4), (1, 9, 10), (2, 1, 2)], "g int, t0 int, t1 int")
    assert rows(asof.merge_spans(s, "g"), "g", "t0", "t1") == [(1, 0, 8), (1, 9, 10), (2, 1, 2)]


def test_uniqueness_by_hand(spark):
    s = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 1, 3), (1, "c", 5, 6)], "g int, id string, t0 int, t1 int")
    got = {r["id"]: r["uniqueness"] for r in spans.average_uniqueness(s, "g").collect()}
    assert got == {"a": 0.75, "b": 0.75, "c": 1.0}


def test_cusum_by_hand(spark):
    r = [None, 0.6, 0.6, -0.5, -0.8, 0.2, 1.2]
    assert labels.cusum_flags(r, 1.0) == [0, 0, 1, 0, -1, 0, 1]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(r)], "g int, i int, r double")
    assert [x["flag"] for x in labels.cusum_filter(d, "g", ["i"], "r", 1.0).orderBy("i").collect()] == labels.cusum_flags(r, 1.0)


def test_triple_barrier_takes_the_first(spark):
    path = spark.createDataFrame([(1, t, p) for t, p in [(1, 1.0), (2, 1.05), (3, 0.85), (4, 1.3), (9, 9.0)]], "g int, pt int, p double")
    e = spark.createDataFrame([(1, 1, 1.0)], "g int, t int, v double")
    r = labels.triple_barrier(e, path, "g", "t", "v", "pt", "p", 0.1, 0.1, 5).first()
    assert (r["touch"], r["side"]) == (3, -1)


def test_paths_cover_every_group_once():
    got = spans.backtest_paths(6, 2)
    assert len(got) == 30 and len({(p, g) for p, g, _ in got}) == 30


def test_holm_and_bh(spark):
    d = spark.createDataFrame([(0.01, "a"), (0.04, "b"), (0.03, "c"), (None, "d")], "p double, k string")
    got = {r["k"]: (round(r["holm"], 6), round(r["bh"], 6)) for r in stats.holm(d, "p", ["k"]).collect()}
    assert got == {"a": (0.03, 0.03), "c": (0.06, 0.04), "b": (0.06, 0.04)}


def test_sequences():
    assert sequences.lempel_ziv(list("aaaa")) < sequences.lempel_ziv(list("abcd")) == 1.0
    assert sequences.ffd_weights(1.0, 1e-5) == [1.0, -1.0]
    w = sequences.hierarchical_risk_parity(np.diag([1.0, 4.0, 9.0]))
    assert w.sum() == pytest.approx(1) and w[0] > w[1] > w[2]
    assert sequences.holding_period(np.array([0.0, 1, 3]), np.array([0.0, 2, 0])) == 2.0
    assert sequences.inverse_variance(np.diag([1.0, 1.0])).tolist() == [0.5, 0.5]
    draws = sequences.sequential_bootstrap(np.array([0, 0, 5]), np.array([4, 4, 9]), 200, 1)
    assert draws.count(2) > draws.count(0)


def test_martingale_tries_every_window(spark, sf):
    series = {}
    for r in sequence_queries.daily(spark, sf).orderBy("day").collect():
        series.setdefault(r["g"], []).append(r["v"])
    g = min(series)
    y = np.array(series[g])[:150]
    want = []
    for end in range(20, len(y) + 1):
        best = 0.0
        for start in range(end - 19):
            z = y[start:end]
            u = np.arange(1, len(z) + 1) / len(z)
            x = np.column_stack([np.ones(len(z)), u, u * u])
            beta, *_ = np.linalg.lstsq(x, z, rcond=None)
            best = max(best, abs(beta[2]) / math.sqrt(((z - x @ beta) ** 2).sum() / (len(z) - 3) * np.linalg.inv(x.T @ x)[2, 2]))
        want.append(best)
    got = {r["i"]: r["smt"] for r in model_queries.martingale_tests(spark, sf).filter(F.col("g") == g).collect()}
    assert [got[i] for i in range(19, len(y))] == pytest.approx(want, rel=1e-7)


def test_chow_takes_every_supplier(spark):
    sf = "/root/testdata/sf0.01"
    totals = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").collect():
        t = totals.setdefault(r[0], {}).setdefault(r[1].year * 12 + r[1].month, [0.0, 0.0])
        t[0] += float(r[2])
        t[1] += float(r[3])
    want = {}
    for g, months in totals.items():
        y = np.array([p / q / 100 for _, (p, q) in sorted(months.items())])
        x, d = y[:-1], np.diff(y)
        n, ts = len(d), []
        for k in range(int(n * 0.15), int(n * 0.85)):
            z = np.where(np.arange(n) >= k, x, 0.0)
            b = (z @ d) / (z @ z)
            ts.append(b / math.sqrt(((d - b * z) ** 2).sum() / (n - 1) / (z @ z)))
        want[g] = max(ts)
    got = {r["g"]: r["sdfc"] for r in sequence_queries.chow_dfc(spark, sf).collect()}
    assert len(want) > 30 and got == pytest.approx(want, abs=1e-7)  # the query rounds


def test_importance_takes_every_supplier(spark, sf):
    whole = [tuple(r) for r in tables.spans(spark, sf).select("g", "id").collect()]
    s, roles = model_queries.labelled(spark, sf)
    assert rows(s, "g", "id") == sorted(whole) and len({g for g, _ in whole}) > 1
    assert rows(roles.filter("role = 'test'"), "g", "id") == sorted(whole)
    assert rows(roles.select("g", "test_fold").distinct(), "g", "test_fold") == [(g, f) for g in sorted({g for g, _ in whole}) for f in range(3)]


def test_plans_have_no_nested_loop_and_windows_have_keys(spark, sf):
    from tidelight.plans.queries import QUERIES

    for name in ("bars_tick", "asof_last_print", "triple_barrier", "avg_uniqueness", "purged_kfold"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "SinglePartition" not in plan, name


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
