"""Overlapping label spans ``[t0, t1)``: concurrency, uniqueness, attribution, purged folds."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelight.sources.shared import materialize, release_shuffles


def segments(spans: DataFrame, group: str, value: str | None = None) -> DataFrame:
    """Elementary segments of a group's time: ``lo, hi``, spans open there (``c``), the sum of their ``value``, and spans by side."""
    v = F.col(value) if value else F.lit(0.0)
    edges = spans.select(F.col(group), F.col("t0").alias("lo"), F.lit(1).alias("d"), v.alias("v")).unionByName(spans.select(F.col(group), F.col("t1").alias("lo"), F.lit(-1).alias("d"), (-v).alias("v")))
    at = edges.groupBy(group, "lo").agg(F.sum("d").alias("d"), F.sum("v").alias("v"))
    w = Window.partitionBy(group).orderBy("lo")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return at.select(group, "lo", F.lead("lo").over(w).alias("hi"), F.sum("d").over(run).alias("c"), F.sum("v").over(run).alias("v"))


def average_uniqueness(spans: DataFrame, group: str) -> DataFrame:
    """Spans with ``uniqueness``: the mean of 1 / concurrency over the span, by prefix sums at its two ends."""
    seg = segments(spans, group)
    w = Window.partitionBy(group).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    before = seg.select(group, "lo", F.coalesce(F.sum(F.when(F.col("c") > 0, (F.col("hi") - F.col("lo")) / F.col("c")).otherwise(0.0)).over(w), F.lit(0.0)).alias("area"))
    a, b = before.withColumnsRenamed({"lo": "t0", "area": "_a"}), before.withColumnsRenamed({"lo": "t1", "area": "_b"})
    return spans.join(a, [group, "t0"]).join(b, [group, "t1"]).withColumn("uniqueness", (F.col("_b") - F.col("_a")) / (F.col("t1") - F.col("t0"))).drop("_a", "_b")


def grid_uniqueness(spans: DataFrame, group: str, key: str, step: int) -> DataFrame:
    """``group, key, uniqueness, units``: the mean of 1 / concurrency over the multiples of ``step`` that a span holds, and how many; spans that hold none are left out.

    Spans never become rows for each unit: concurrency is a running sum of their ends, one row
    for each place of the grid where it changes, and goes to the spans as one list for each
    group, which is bounded by the grid. Spans are written once and shuffled once, by group.
    """
    first, end = F.ceil(F.col("t0") / step), F.ceil(F.col("t1") / step)
    held = materialize(spans.select(group, key, first.cast("long").alias("a"), end.cast("long").alias("b")).filter("a < b"), "grid_spans")
    release_shuffles(held.sparkSession)
    edges = held.select(group, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    changes = edges.groupBy(group, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    run = changes.withColumn("c", F.sum("d").over(Window.partitionBy(group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    lists = run.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("_steps"))
    # of each change but the last: how far it lasts, as a share of one unit for each open span
    shares = F.transform(F.sequence(F.lit(1), F.size("_steps") - 1), lambda i: F.try_divide(F.get("_steps", i)["at"] - F.get("_steps", i - 1)["at"], F.get("_steps", i - 1)["c"]))
    places = lists.select(group, F.transform("_steps", lambda x: x["at"]).alias("_at"), shares.alias("_share"))
    lo, hi = F.array_position("_at", F.col("a")).cast("int"), F.array_position("_at", F.col("b")).cast("int")
    total = F.aggregate(F.slice("_share", lo, hi - lo), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    met = held.join(places, group).select(group, key, total.alias("_sum"), (F.col("b") - F.col("a")).alias("_n"))
    return met.groupBy(group, key).agg((F.sum("_sum") / F.sum("_n")).alias("uniqueness"), F.sum("_n").alias("units"))


def return_attribution(spans: DataFrame, group: str, returns: DataFrame) -> DataFrame:
    """Spans with ``weight``: |sum of return / concurrency over the span|, scaled to sum to the number of spans.

    ``returns``: ``group, u, r``, one for each unit of time.
    """
    seg = segments(spans, group)
    units = returns.select(group, F.col("u").alias("lo"), F.col("r"))
    w = Window.partitionBy(group).orderBy("lo", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    mixed = seg.select(group, "lo", F.col("c"), F.lit(None).cast("double").alias("r")).unionByName(units.select(group, "lo", F.lit(None).cast("bigint").alias("c"), "r"))
    open_ = mixed.withColumn("c", F.last("c", ignorenulls=True).over(w)).withColumn("share", F.when((F.col("c") > 0) & F.col("r").isNotNull(), F.col("r") / F.col("c")).otherwise(0.0))
    total = open_.withColumn("area", F.coalesce(F.sum("share").over(Window.partitionBy(group).orderBy("lo").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    before = total.filter("r is null").select(group, "lo", "area").distinct()
    a, b = before.withColumnsRenamed({"lo": "t0", "area": "_a"}), before.withColumnsRenamed({"lo": "t1", "area": "_b"})
    raw = spans.join(a, [group, "t0"]).join(b, [group, "t1"]).withColumn("_w", F.abs(F.col("_b") - F.col("_a"))).drop("_a", "_b")
    every = Window.partitionBy(group)
    return raw.withColumn("weight", F.try_divide(F.col("_w") * F.count(F.lit(1)).over(every), F.sum("_w").over(every))).drop("_w")


def time_decay(rows: DataFrame, group: str, order: list[str], uniqueness: str = "uniqueness", c: float = 0.5) -> DataFrame:
    """Rows with ``decay``: linear in cumulative uniqueness, 1 at the newest and ``c`` at the oldest (below 0: the oldest share gets none)."""
    w = Window.partitionBy(group).orderBy(*order)
    cum, last = F.sum(uniqueness).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(uniqueness).over(Window.partitionBy(group))
    slope = (1 - c) / last if c >= 0 else 1 / ((c + 1) * last)
    return rows.withColumn("decay", F.greatest(1 - slope * last + slope * cum, F.lit(0.0)))


def folds(spans: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """Rows with ``fold``: contiguous blocks of nearly equal size in the order of their start."""
    return spans.withColumn("fold", F.ntile(n).over(Window.partitionBy(group).orderBy(*order)) - 1)


def purged_kfold(spans: DataFrame, group: str, order: list[str], n: int, embargo: int = 0) -> DataFrame:
    """Every (row, test fold) with ``role``: test, train, or purged.

    Purged rows overlap the fold's envelope or start within the embargo after
    it. Envelopes are ``n`` rows a group.
    """
    rows = folds(spans, group, order, n)
    env = rows.groupBy(group, F.col("fold").alias("test_fold")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    pairs = rows.join(env, group)
    overlap = (F.col("t0") < F.col("hi")) & (F.col("t1") > F.col("lo"))
    late = (F.col("t0") >= F.col("hi")) & (F.col("t0") < F.col("hi") + embargo)
    role = F.when(F.col("fold") == F.col("test_fold"), "test").when(overlap | late, "purged").otherwise("train")
    return pairs.withColumn("role", role).drop("lo", "hi")


def purged_sets(spans: DataFrame, group: str, order: list[str], n: int, embargo: int = 0) -> DataFrame:
    """The roles of :func:`purged_kfold` as one row for each span: ``test`` (a list of its fold) and ``train`` (a bit for each fold), by one shuffle."""
    rows = folds(spans, group, order, n)
    every, train = Window.partitionBy(group), F.lit(0).cast("long")
    for k in range(n):
        lo, hi = F.min(F.when(F.col("fold") == k, F.col("t0"))).over(every), F.max(F.when(F.col("fold") == k, F.col("t1"))).over(every)
        free = ~((F.col("t0") < hi) & (F.col("t1") > lo) | (F.col("t0") >= hi) & (F.col("t0") < hi + embargo))
        train = train + F.when((F.col("fold") != k) & free, F.lit(1 << k)).otherwise(0)
    return rows.withColumn("test", F.array(F.col("fold"))).withColumn("train", train).drop("fold")


def purged_by_stretches(spans: DataFrame, group: str, day: str, n: int, embargo: int = 0) -> DataFrame:
    """Every (row, test fold) with ``role``, by folds of whole days and purging against merged stretches of test spans.

    A fold's stretches are disjoint and in order, so of those that start before a row
    ends the last reaches farthest: one as-of join finds it, and it alone decides.
    """
    from tidelight.operators.asof import asof_join, merge_spans

    days = spans.select(group, day).distinct().withColumn("fold", F.ntile(n).over(Window.partitionBy(group).orderBy(day)) - 1)
    rows = spans.join(days, [group, day])
    keyed = rows.withColumn("_k", F.struct(F.col(group).alias("g"), F.col("fold").alias("f")))
    stretch = merge_spans(keyed.select("_k", "t0", "t1"), "_k").select("_k", F.col("t0").alias("_lo"), F.col("t1").alias("_hi"))
    pairs = rows.join(days.select(group, F.col("fold").alias("test_fold")).distinct(), group)
    pairs = pairs.withColumn("_k", F.struct(F.col(group).alias("g"), F.col("test_fold").alias("f")))
    met = asof_join(pairs, stretch, "_k", "t1", "_lo", ["_hi"], strict=True)
    role = F.when(F.col("fold") == F.col("test_fold"), "test").when(F.col("_hi") + embargo > F.col("t0"), "purged").otherwise("train")
    return met.withColumn("role", role).drop("_k", "_hi", "matched_time")


def combinatorial_splits(n: int, k: int) -> list[tuple[int, tuple[int, ...]]]:
    """Numbered choices of ``k`` test groups among ``n``; a plan's parameter, not data."""
    return list(enumerate(combinations(range(n), k)))


def backtest_paths(n: int, k: int) -> list[tuple[int, int, int]]:
    """(path, group, split): the split that supplies a group to a path, in the order of splits."""
    seen, out = [0] * n, []
    for s, groups in combinatorial_splits(n, k):
        for g in groups:
            out.append((seen[g], g, s))
            seen[g] += 1
    return out
