"""Checks at the door: quotes, feeds, ledgers, state logs, orders and notes, each as rows with the reason why they are refused.

A check looks only at rows that share a key and at the row before in its order, so it
is a window or a join by that key; nothing stops at the first fault.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(**checks: Column) -> Column:
    """The name of the first check that is true, or null."""
    out = None
    for name, hit in checks.items():
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def quote_reasons(quotes: DataFrame) -> DataFrame:
    """Quotes (``instrument, event_ms, received_ms, available_ms, sequence, revision, bid_tick, ask_tick``) with ``reason``.

    Clocks must not run backwards, sides be positive and not crossed; one identity
    (sequence, revision) holds one content, a revision keeps its event's clock, and
    sequences follow the event clock.
    """
    content = F.xxhash64("event_ms", "received_ms", "available_ms", "bid_tick", "ask_tick")
    same = Window.partitionBy("instrument", "sequence", "revision")
    event = Window.partitionBy("instrument", "sequence")
    q = quotes.withColumn("_content", content)
    q = q.withColumn("_contents", F.min("_content").over(same) != F.max("_content").over(same)).withColumn("_clocks", F.min("event_ms").over(event) != F.max("event_ms").over(event))
    order = Window.partitionBy("instrument").orderBy("sequence").rangeBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("_latest", F.max("event_ms").over(order))
    reason = first_reason(
        clocks=(F.col("event_ms") > F.col("received_ms")) | (F.col("received_ms") > F.col("available_ms")), crossed=(F.col("bid_tick") <= 0) | (F.col("bid_tick") >= F.col("ask_tick")),
        identity=F.col("_contents"), revised_clock=F.col("_clocks"), sequence=F.col("_latest") > F.col("event_ms"),
    )
    return q.withColumn("reason", reason).drop("_content", "_contents", "_clocks", "_latest")


def feed_segments(records: DataFrame, archive: str, order: list[str], kind: str) -> DataFrame:
    """Feed records with ``segment`` (one more after each gap), ``status`` and ``late``.

    A segment waits for a snapshot (``book``) before its changes count; a record whose
    receipt is before an earlier one's is late.
    """
    w = Window.partitionBy(archive).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = records.withColumn("segment", F.sum((F.col(kind) == "gap").cast("int")).over(run))
    inside = Window.partitionBy(archive, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    based = F.max((F.col(kind) == "book").cast("int")).over(inside) == 1
    status = F.when(F.col(kind) == "gap", "GAP").when(based, "ACTIVE").otherwise("AWAITING_SNAPSHOT")
    past = F.max("received_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("status", status).withColumn("late", F.coalesce(F.col("received_ms") < past, F.lit(False)))


def flat_levels(snapshots: DataFrame, keys: list[str], bids: str, asks: str) -> DataFrame:
    """``keys, side, level, price, size`` of nested books; empty sides give no rows."""
    sides = F.array(F.struct(F.lit("bid").alias("side"), F.col(bids).alias("levels")), F.struct(F.lit("ask").alias("side"), F.col(asks).alias("levels")))
    each = snapshots.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", F.posexplode("s.levels").alias("level", "l"))
    return each.select(*keys, "side", "level", "l.price", "l.size")


def ledger_reasons(events: DataFrame, ledger: str, line: str) -> DataFrame:
    """Ledger events (``timestamp, sequence, kind, fill_id``) with ``reason``: order must be strict by (timestamp, sequence), fills must not repeat."""
    key = F.struct("timestamp", "sequence")
    w = Window.partitionBy(ledger).orderBy(line)
    again = F.row_number().over(Window.partitionBy(ledger, "fill_id").orderBy(line)) > 1
    reason = first_reason(order=key <= F.lag(key).over(w), repeated_fill=(F.col("kind") == "fill") & F.col("fill_id").isNotNull() & again)
    return events.withColumn("reason", reason)


def replayed(log: DataFrame, run: str, allowed: list[tuple[str | None, str]], state: str, sequence: str, digest: str, previous: str) -> DataFrame:
    """A log's records with ``reason``: sequences without gaps from 0, each naming the digest before, each a legal transition.

    ``allowed``: pairs of a state (None before the first) and the one that may follow; a parameter.
    """
    w = Window.partitionBy(run).orderBy(sequence)
    before = F.lag(state).over(w)
    legal = F.lit(False)
    for a, b in allowed:
        legal = legal | ((before.isNull() if a is None else before == a) & (F.col(state) == b))
    reason = first_reason(sequence=F.col(sequence) != F.row_number().over(w) - 1, chain=~F.col(previous).eqNullSafe(F.lag(digest).over(w)), transition=~F.coalesce(legal, F.lit(False)))
    return log.withColumn("reason", reason)


def order_refusals(orders: DataFrame, live: DataFrame, account: str, tick: int, lot: int) -> DataFrame:
    """Orders (``side, price, units, capacity, horizon``) with ``reason``: horizon, lots, capacity, ticks, or crossing a live order of the own account.

    Of the live orders only the best price of each side matters, one row an account.
    """
    best = live.groupBy(account).agg(F.min(F.when(F.col("side") == "sell", F.col("price"))).alias("_ask"), F.max(F.when(F.col("side") == "buy", F.col("price"))).alias("_bid"))
    o = orders.join(best, account, "left")
    crosses = ((F.col("side") == "buy") & (F.col("price") >= F.col("_ask"))) | ((F.col("side") == "sell") & (F.col("price") <= F.col("_bid")))
    reason = first_reason(
        side=~F.col("side").isin("buy", "sell"), horizon=F.col("horizon") == 0, lot=(F.col("units") < 1) | (F.col("units") % lot != 0), capacity=F.col("units") > F.col("capacity"),
        tick=(F.col("price") <= 0) | (F.col("price") % tick != 0), crosses=F.coalesce(crosses, F.lit(False)),
    )
    return o.withColumn("reason", reason).drop("_ask", "_bid")


def note_sources(records: DataFrame, sources: DataFrame, key: str, digest: str, text: str) -> DataFrame:
    """Records with ``status``: whether their source still has the digest that was stored with them."""
    s = sources.select(F.col(key), F.sha2(F.col(text), 256).alias("_now"))
    status = F.when(F.col("_now").isNull(), "SOURCE_MISSING").when(F.col("_now") != F.col(digest), "SOURCE_CHANGED").otherwise("CURRENT")
    return records.join(s, key, "left").withColumn("status", status).drop("_now")


def linear_parts(n: int, parts: int) -> list[int]:
    """Bounds of equal parts of ``n`` things."""
    parts = max(1, min(parts, n))
    return [-(-n * k // parts) for k in range(parts + 1)]


def triangular_parts(n: int, parts: int, upper: bool = False) -> list[int]:
    """Bounds of rows that cut a triangle of ``n`` rows into parts of equal area; ``upper``: the first rows are the longest.

    The area above row r is r (r + 1) / 2, so the k-th bound is its inverse at k parts.
    """
    parts = max(1, min(parts, n))
    bounds = [round((math.sqrt(1 + 4 * n * (n + 1) * k / parts) - 1) / 2) for k in range(parts + 1)]
    return [n - x for x in bounds[::-1]] if upper else bounds






def permuted_outcomes(windows: DataFrame, key: str, outcome: str, rank: Column) -> DataFrame:
    """``key`` and ``shuffled``: another window's outcome, by the order of ``rank``; a control without any link.

    One window over all windows' keys, as a permutation needs; rows are a key and an outcome.
    """
    w = Window.partitionBy(F.lit(0))
    a = windows.select(key, outcome).withColumn("_i", F.row_number().over(w.orderBy(key)))
    b = windows.select(F.row_number().over(w.orderBy(rank, key)).alias("_i"), F.col(outcome).alias("shuffled"))
    return a.join(b, "_i").select(key, outcome, "shuffled")
