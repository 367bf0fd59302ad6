"""Sources, sinks, streams and models on tiny inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.operators import models, sizing
from tidelight.sources import lake
from tidelight.streaming import jobs


def test_lake_later_piece_wins_and_consolidates(spark, tmp_path):
    path, scratch = f"file://{tmp_path}/lake", f"file://{tmp_path}/scratch"
    piece = lambda rows: spark.createDataFrame(rows, "k int, ts long, v string")
    lake.put(piece([(1, 0, "a"), (2, 90000, "b")]), path, "ts", 1)
    lake.put(piece([(1, 5, "c"), (3, 90001, "d")]), path, "ts", 2)
    want = {(1, "c"), (2, "b"), (3, "d")}
    assert {(r["k"], r["v"]) for r in lake.read_latest(spark, path, ["k"]).collect()} == want
    assert {r["k"] for r in lake.read_latest(spark, path, ["k"], ["1970-01-02"]).collect()} == {2, 3}
    lake.consolidate(spark, path, ["k"], scratch)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == want


def test_manifest_finds_changed_missing_and_unknown_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).repartition(3).write.parquet(f"file://{path}")
    now = lake.manifest(spark, f"file://{path}")
    known = spark.createDataFrame(now.collect(), now.schema)
    assert known.count() == 3 and lake.verify(spark, f"file://{path}", known).count() == 0
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.remove(f"{path}/{files[0]}")
    with open(f"{path}/{files[1]}", "ab") as f:
        f.write(b"x")
    os.remove(f"{path}/.{files[1]}.crc")  # else the local file system itself refuses the file
    with open(f"{path}/new.parquet", "wb") as f:
        f.write(b"y")
    assert sorted(r["code"] for r in lake.verify(spark, f"file://{path}", known).collect()) == ["CHANGED", "MISSING", "UNKNOWN"]


def test_ohlcv_rules(spark, tmp_path):
    folder = tmp_path / "asset=X"
    folder.mkdir()
    (folder / "x.csv").write_text("date,open,high,low,close,volume\n2024-01-01,1,3,1,2,5\n2024-01-02,1,1,1,2,5\n2024-01-03,1,3,1,2,5\n2024-01-03,1,3,1,2,5\nnope,1,3,1,2,5\n")
    bars, broken = lake.read_ohlcv(spark, f"file://{tmp_path}")
    assert bars.count() == 5
    assert sorted((r["date"], r["code"]) for r in broken.collect()) == [("2024-01-02", "PRICE_ORDER"), ("2024-01-03", "DUPLICATE_DATE"), ("2024-01-03", "DUPLICATE_DATE"), ("nope", "BAD_DATE")]


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("1700000000", 1700000000), ("1700000000123", 1700000000), ("1700000000123456", 1700000000), ("2023-11-14T22:13:20Z", 1700000000), ("2023-11-15T00:13:20+02:00", 1700000000), ("2023-11-14 22:13:20", None), ("x", None), ("", None), (None, None)],
)
def test_clocks(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "t string").select(lake.parse_clock(F.col("t"))).first()[0] == seconds


def test_stream_equals_batch(spark, sf):
    stream = jobs.run(jobs.time_bars(jobs.events_stream(spark, sf), "1 day"), "complete", "test-bars")
    batch = jobs.time_bars(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))


def test_least_squares_and_folds(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    d = spark.createDataFrame([(float(a), float(b), float(1 + 2 * a - 3 * b)) for a, b in x], "a double, b double, y double")
    beta = models.least_squares(d, "y", ["a", "b"])
    assert [round(beta[k], 6) for k in ("intercept", "a", "b")] == [1, 2, -3]


def test_sizing_by_hand():
    assert sizing.hold_to_expiry(np.array([1.0, 1.0, 3.0]), np.array([1, 1, -1])).tolist() == [1.0, 0.0, 0.0]
    assert sizing.fill_orders(np.array([1.0, 3.0, 1.0]), np.array([10.0, 10.0, 10.0]), 2.0, 7.0, 0.5).tolist() == [5.0, 0.0, 2.0]
    assert len(sizing.integer_partitions(6, 3)) == 28
    mesh = sizing.trading_rule_mesh(0.0, 0.5, 1.0, [1.0], [1.0], 50, 10, 3)
    assert len(mesh["sharpe"]) == 1
