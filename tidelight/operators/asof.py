"""Joins in time: as-of, forward as-of, interval overlap, and merging of spans.

As-of joins are one shuffle by the group key: both sides are put on one time
axis and the last value before each left row is carried forward. For a group too
large for one task, ``buckets`` cuts the axis into ranges; each range is carried
forward on its own and takes what it lacks from the last filled range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, group: str, left_time: str, right_time: str, values: list[str], direction: str = "backward", strict: bool = False, order: list[str] | None = None, bucket_seconds: int | None = None
) -> DataFrame:
    """``left`` with the right row nearest in time within its group, as ``values`` and ``matched_time``.

    Backward takes the last right row at or before the left time (before it, if
    ``strict``), forward the first at or after it. ``order`` breaks ties among
    right rows of one time; the last of them (backward) or first (forward) is
    taken. Left rows without a match get nulls.
    """
    back = direction == "backward"
    right_row = F.struct(F.col(right_time).alias("matched_time"), *values)
    ties = [F.col(c) for c in order or []]
    stack = left.select(F.col(group).alias("_g"), F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(right_row.alias("r")).schema["r"].dataType).alias("_right"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order or [])])
    other = right.select(F.col(group).alias("_g"), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(stack.schema["_left"].dataType).alias("_left"), right_row.alias("_right"), *[c.alias(f"_o{i}") for i, c in enumerate(ties)])
    both = stack.unionByName(other)
    tie = [F.col(f"_o{i}") for i in range(len(ties))]
    sort = [F.col("_t"), F.col("_side"), *tie] if back else [F.col("_t").desc(), F.col("_side"), *[c.desc() for c in tie]]
    if bucket_seconds is None:
        w = Window.partitionBy("_g").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null").select("_left.*", "_hit.*")
    both = both.withColumn("_b", F.floor(F.col("_t") / bucket_seconds))
    w = Window.partitionBy("_g", "_b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    edge = both.filter("_right is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("_g", "_b").orderBy(*[c.desc() for c in [F.col("_t"), F.col("_side"), *tie]] if back else [F.col("_t"), F.col("_side").desc(), *tie]))).filter("_rn = 1")
    marks = near.filter("_left is not null").select("_g", "_b").distinct().withColumn("_edge", F.lit(None).cast(both.schema["_right"].dataType)).unionByName(edge.select("_g", "_b", F.col("_right").alias("_edge")))
    marks = marks.groupBy("_g", "_b").agg(F.first("_edge", ignorenulls=True).alias("_edge"))
    over = Window.partitionBy("_g").orderBy(F.col("_b") if back else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_g", "_b", F.last("_edge", ignorenulls=True).over(over).alias("_before"))
    return near.filter("_left is not null").join(carried, ["_g", "_b"]).select("_left.*", F.coalesce("_hit", "_before").alias("_m")).select(*left.columns, "_m.*")


def range_join(left: DataFrame, right: DataFrame, group: str, lo: Column, hi: Column, at: str, width: int) -> DataFrame:
    """Pairs of a group with the right's ``at`` in the left's ``[lo, hi]``: an equi-join on time buckets of ``width``, then the exact test."""
    spread = left.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    dealt = right.withColumn("_b", F.floor(F.col(at) / width)).withColumnRenamed(group, "_rg")
    hit = spread.join(dealt, (spread[group] == dealt["_rg"]) & (spread["_b"] == dealt["_b"]) & (F.col(at) >= F.col("_lo")) & (F.col(at) <= F.col("_hi")))
    return hit.drop("_rg", "_b", "_lo", "_hi")


def merge_spans(spans: DataFrame, group: str, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Maximal stretches covered by a group's spans; spans that touch are merged."""
    w = Window.partitionBy(group).orderBy(t0, t1)
    reach = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_new", F.when(reach.isNull() | (F.col(t0) > reach), 1).otherwise(0))
    island = fresh.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, "_island").agg(F.min(t0).alias(t0), F.max(t1).alias(t1)).drop("_island")


def contiguous_runs(df: DataFrame, group: list[str], step: str) -> DataFrame:
    """Maximal runs of consecutive integers: ``lo``, ``hi`` (one past the last) and ``n``."""
    w = Window.partitionBy(*group).orderBy(step)
    return df.select(*group, step).distinct().withColumn("_key", F.col(step) - F.row_number().over(w)).groupBy(*group, "_key").agg(F.min(step).alias("lo"), (F.max(step) + 1).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_key")
