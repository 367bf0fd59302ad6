"""Streaming queries over ``events``; each equals its batch twin, which the SQL states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight.plans.registry import query
from tidelight.streaming import jobs


def seconds(column: str):
    return F.unix_timestamp(column)


@query(
    "stream_bars",
    "SELECT user_id, floor(epoch(ts) / 86400)::BIGINT * 86400 AS start, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS n FROM events GROUP BY ALL",
)
def stream_bars(spark, sf):
    """Daily bars of each user from the stream."""
    out = jobs.run(jobs.time_bars(jobs.events_stream(spark, sf), "1 day"), "complete", "stream-bars")
    return out.select("user_id", seconds("w.start").alias("start"), "open", "high", "low", "close", "n")


@query(
    "stream_sliding",
    "WITH s AS (SELECT unnest([floor(epoch(ts) / 43200)::BIGINT * 43200, floor(epoch(ts) / 43200)::BIGINT * 43200 - 43200]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL",
)
def stream_sliding(spark, sf):
    """Counts and sums over days that slide by half a day."""
    out = jobs.run(jobs.sliding_counts(jobs.events_stream(spark, sf), "1 day", "12 hours"), "complete", "stream-sliding")
    return out.select(seconds("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""",
)
def stream_sessions(spark, sf):
    """Sessions that twelve idle hours end."""
    out = jobs.run(jobs.sessions(jobs.events_stream(spark, sf), "12 hours"), "complete", "stream-sessions")
    return out.select("user_id", seconds("w.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("stream_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(spark, sf):
    """Events once each, by id within the watermark."""
    out = jobs.run(jobs.deduplicated(jobs.events_stream(spark, sf), ["event_id"], "1 hour").select("event_id", "user_id"), "append", "stream-dedup")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query(
    "stream_book",
    "SELECT CASE WHEN event_type IN ('purchase', 'view') THEN 'bid' ELSE 'ask' END AS side, (props->>'$.k')::BIGINT AS tick, max(event_id) AS event_id, floor(arg_max(value, event_id))::BIGINT AS size FROM events GROUP BY ALL",
)
def stream_book(spark, sf):
    """The last size of each price level, kept as state."""
    out = jobs.run(jobs.book_levels(jobs.events_stream(spark, sf)), "update", "stream-book")
    return out.groupBy("side", "tick").agg(F.max("event_id").alias("event_id"), F.max_by("size", "event_id").alias("size"))
