"""Simulated distributions of statistics: draws are numbered rows, each seeded by its number, so any executor makes the same ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUANTILES = (0.9, 0.95, 0.99)


def simulated(spark: SparkSession, n: int, statistic: Callable[[np.random.Generator], float], seed: int = 0) -> DataFrame:
    """``draw, stat``: the statistic of each of ``n`` generators."""

    def run(batches):
        for batch in batches:
            draws = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(statistic(np.random.default_rng((seed, d)))) for d in draws], pa.float64())], ["draw", "stat"])

    return spark.range(n, numPartitions=min(n, spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "draw").mapInArrow(run, "draw long, stat double")


def critical_values(draws: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``quantile, critical`` of the finite simulated statistics."""
    finite = draws.filter(~F.isnan("stat") & (F.abs("stat") < float("inf")))
    both = finite.agg(*[F.percentile("stat", q).alias(f"q{i}") for i, q in enumerate(quantiles)])
    return both.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("critical")) for i, q in enumerate(quantiles)])).alias("r")).select("r.*")


def random_walk(rng: np.random.Generator, n: int) -> np.ndarray:
    return np.cumsum(rng.standard_normal(n))


def wild_walk(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A path with the same centred steps, their signs drawn: a unit root that keeps the sample's changes in size."""
    steps = np.diff(y) - np.diff(y).mean()
    return y[0] + np.r_[0.0, np.cumsum(steps * rng.choice([-1.0, 1.0], len(steps)))]


def estimator_bias(spark: SparkSession, estimate: Callable[[np.ndarray], float], probabilities: list[float], length: int, n: int, seed: int = 0) -> DataFrame:
    """``mean, sd, bias`` of an entropy estimate (bits) over messages of independent symbols, against the true entropy."""
    p = np.asarray(probabilities, float)
    truth = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    draws = simulated(spark, n, lambda rng: estimate(rng.choice(len(p), length, p=p)), seed)
    return draws.agg(F.avg("stat").alias("mean"), F.stddev_samp("stat").alias("sd")).withColumn("bias", F.col("mean") - truth)
