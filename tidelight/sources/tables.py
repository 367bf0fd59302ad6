"""Test tables in the roles that the operators take: tapes, spans, panels, ledgers.

Timestamps without a zone are read as UTC. Every tape has a total order, so that
windows over it are the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The total order of a supplier's trades.
TAPE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> F.Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.unix_timestamp(F.col(column).cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a trade tape: group ``g`` (supplier), ``ts`` (seconds), ``price``, ``size``, ``sign``, and the order's tie-breakers."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("g"),
        epoch("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream: group ``g`` (user), ``event_id``, ``ts`` (seconds), ``kind``, ``value``, ``k`` (from the JSON)."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("g"),
        "event_id",
        epoch("ts").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label spans ``[t0, t1)`` in days of each supplier: ``g, id, t0, t1, size, side, ret``."""
    li, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    shipped, ordered = (F.floor(epoch(c) / 86400) for c in ("l_shipdate", "o_orderdate"))
    return joined.select(
        F.col("l_suppkey").alias("g"),
        F.format_string("%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", shipped).alias("id"),
        F.least(shipped, ordered).alias("t0"),
        (F.greatest(shipped, ordered) + 1).alias("t1"),
        F.round(F.col("l_discount") * 100).alias("size"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"),
        (F.col("l_tax") - F.lit(0.04)).alias("ret"),
    )


#: DuckDB views of the same roles, to build oracle SQL on.
TRADES_SQL = """trades AS (SELECT l_suppkey AS g, epoch(l_shipdate)::BIGINT AS ts, l_orderkey, l_linenumber, l_partkey,
    l_extendedprice / l_quantity AS price, l_quantity AS size, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM lineitem)"""
EVENTS_SQL = """ev AS (SELECT user_id AS g, event_id, floor(epoch(ts))::BIGINT AS ts, epoch_us(ts) AS us, event_type AS kind, value,
    (props->>'$.k')::BIGINT AS k FROM events)"""
SPANS_SQL = """spans AS (SELECT l_suppkey AS g, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', sd) AS id, least(sd, od) AS t0, greatest(sd, od) + 1 AS t1,
    round(l_discount * 100) AS size, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_tax - 0.04 AS ret
    FROM (SELECT *, floor(epoch(l_shipdate) / 86400)::BIGINT AS sd, floor(epoch(o_orderdate) / 86400)::BIGINT AS od
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
