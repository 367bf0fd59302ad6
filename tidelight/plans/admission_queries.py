"""Queries of checks at the door, nested books, partitions, controls and synthetic features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.functions import betting as bt
from tidelight.functions.distributions import norm_ppf, norm_ppf_sql, uniform, uniform_sql
from tidelight.operators import admission as ad
from tidelight.operators import spans as sp
from tidelight.operators.evaluation import resampled
from tidelight.plans.evaluation_queries import rounded
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, SPANS_SQL, events, read, spans

QUOTES_SQL = f"""{EVENTS_SQL}, q AS (SELECT event_id, g AS instrument, ts * 1000 - CASE WHEN k % 17 = 0 THEN 90000000 ELSE 0 END AS event_ms, ts * 1000 + k AS received_ms, ts * 1000 + k + CASE WHEN k % 13 = 0 THEN -1 ELSE 5 END AS available_ms, event_id - CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS sequence, 0 AS revision, k AS bid_tick, 50 + floor(value / 10)::BIGINT AS ask_tick FROM ev)"""


@query(
    "quote_admission",
    f"""WITH {QUOTES_SQL}, w AS (SELECT *, count(DISTINCT concat_ws(',', event_ms, received_ms, available_ms, bid_tick, ask_tick)) OVER (PARTITION BY instrument, sequence, revision) > 1 AS contents, min(event_ms) OVER (PARTITION BY instrument, sequence) <> max(event_ms) OVER (PARTITION BY instrument, sequence) AS clk,
        max(event_ms) OVER (PARTITION BY instrument ORDER BY sequence RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM q)
        SELECT event_id, CASE WHEN event_ms > received_ms OR received_ms > available_ms THEN 'clocks' WHEN bid_tick <= 0 OR bid_tick >= ask_tick THEN 'crossed' WHEN contents THEN 'identity' WHEN clk THEN 'revised_clock' WHEN latest > event_ms THEN 'sequence' END AS reason FROM w""",
)
def quote_admission(spark, sf):
    """Events as quotes: why each would be refused."""
    ms, k = F.col("ts") * 1000, F.col("k")
    q = events(spark, sf).select(
        "event_id", F.col("g").alias("instrument"), (ms - F.when(k % 17 == 0, 90000000).otherwise(0)).alias("event_ms"), (ms + k).alias("received_ms"), (ms + k + F.when(k % 13 == 0, -1).otherwise(5)).alias("available_ms"),
        (F.col("event_id") - F.when(k % 11 == 0, 1).otherwise(0)).alias("sequence"), F.lit(0).alias("revision"), k.alias("bid_tick"), (50 + F.floor(F.col("value") / 10)).alias("ask_tick"),
    )
    return ad.quote_reasons(q).select("event_id", "reason")


@query(
    "feed_admission",
    f"""WITH {EVENTS_SQL}, f AS (SELECT event_id, g, ts * 1000 - CASE WHEN k % 19 = 0 THEN 50000000 ELSE 0 END AS received_ms, CASE kind WHEN 'error' THEN 'gap' WHEN 'signup' THEN 'book' ELSE 'change' END AS kind FROM ev), s AS (SELECT *, sum((kind = 'gap')::INT) OVER w AS segment, max(received_ms) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM f WINDOW w AS (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, segment::BIGINT AS segment, CASE WHEN kind = 'gap' THEN 'GAP' WHEN max((kind = 'book')::INT) OVER (PARTITION BY g, segment ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 'ACTIVE' ELSE 'AWAITING_SNAPSHOT' END AS status, coalesce(received_ms < past, false) AS late FROM s""",
)
def feed_admission(spark, sf):
    """Users' events as feeds: segments between gaps, whether each has its snapshot yet, and late receipts."""
    kind = F.when(F.col("kind") == "error", "gap").when(F.col("kind") == "signup", "book").otherwise("change")
    f = events(spark, sf).select("event_id", "g", (F.col("ts") * 1000 - F.when(F.col("k") % 19 == 0, 50000000).otherwise(0)).alias("received_ms"), kind.alias("kind"))
    return ad.feed_segments(f, "g", ["event_id"], "kind").select("event_id", "segment", "status", "late")


@query(
    "nested_books",
    f"""WITH {EVENTS_SQL}, s AS (SELECT g, ts // 86400 AS day, CASE WHEN kind IN ('purchase', 'view') THEN 'bid' ELSE 'ask' END AS side, k AS price, floor(value)::BIGINT AS size, event_id FROM ev) SELECT g, day, side, row_number() OVER (PARTITION BY g, day, side ORDER BY price, size, event_id) - 1 AS level, price, size FROM s""",
)
def nested_books(spark, sf):
    """Books kept as nested arrays, a row a user and day, made flat."""
    level = F.struct(F.col("k").alias("price"), F.floor("value").alias("size"), "event_id")
    bid = F.col("kind").isin("purchase", "view")
    s = events(spark, sf).groupBy("g", F.floor(F.col("ts") / 86400).alias("day")).agg(F.sort_array(F.collect_list(F.when(bid, level))).alias("bids"), F.sort_array(F.collect_list(F.when(~bid, level))).alias("asks"))
    return ad.flat_levels(s, ["g", "day"], "bids", "asks")


@query(
    "ledger_admission",
    f"""WITH {EVENTS_SQL}, l AS (SELECT g, event_id AS line, ts - CASE WHEN k % 23 = 0 THEN 100000 ELSE 0 END AS timestamp, 0 AS sequence, CASE kind WHEN 'purchase' THEN 'fill' ELSE 'quote' END AS kind, k AS fill_id FROM ev), p AS (SELECT *, lag(timestamp) OVER (PARTITION BY g ORDER BY line) AS past, row_number() OVER (PARTITION BY g, fill_id ORDER BY line) AS again FROM l)
        SELECT line, CASE WHEN timestamp <= past THEN 'order' WHEN kind = 'fill' AND again > 1 THEN 'repeated_fill' END AS reason FROM p""",
)
def ledger_admission(spark, sf):
    """Users' events as ledgers: lines out of order, and fills that repeat an id."""
    k = F.col("k")
    ledger = events(spark, sf).select("g", F.col("event_id").alias("line"), (F.col("ts") - F.when(k % 23 == 0, 100000).otherwise(0)).alias("timestamp"), F.lit(0).alias("sequence"), F.when(F.col("kind") == "purchase", "fill").otherwise("quote").alias("kind"), k.alias("fill_id"))
    return ad.ledger_reasons(ledger, "g", "line").select("line", "reason")


ALLOWED = [(None, "view"), (None, "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("view", "signup")]
LEGAL = " OR ".join(f"({'before IS NULL' if a is None else f'before = {a!r}'} AND kind = {b!r})" for a, b in ALLOWED)


@query(
    "state_replay",
    f"""WITH {EVENTS_SQL}, l AS (SELECT g, event_id, kind, row_number() OVER w - 1 + CASE WHEN k = 100 THEN 1 ELSE 0 END AS seq, sha256(concat_ws('|', event_id, kind)) AS digest FROM ev WINDOW w AS (PARTITION BY g ORDER BY event_id)), p AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN 'x' ELSE lag(digest) OVER (PARTITION BY g ORDER BY seq, event_id) END AS previous, lag(kind) OVER (PARTITION BY g ORDER BY seq, event_id) AS before, lag(digest) OVER (PARTITION BY g ORDER BY seq, event_id) AS was, row_number() OVER (PARTITION BY g ORDER BY seq, event_id) - 1 AS want FROM l)
        SELECT event_id, CASE WHEN seq <> want THEN 'sequence' WHEN previous IS DISTINCT FROM was THEN 'chain' WHEN NOT coalesce(({LEGAL}), false) THEN 'transition' END AS reason FROM p""",
)
def state_replay(spark, sf):
    """Users' events as state logs: gaps in the sequence, broken chains and illegal transitions."""
    w = Window.partitionBy("g").orderBy("event_id")
    log = events(spark, sf).select("g", "event_id", "kind", (F.row_number().over(w) - 1 + F.when(F.col("k") == 100, 1).otherwise(0)).alias("n"), F.sha2(F.concat_ws("|", F.col("event_id"), F.col("kind")), 256).alias("digest"))
    log = log.withColumn("seq", F.struct("n", "event_id"))
    previous = F.when(F.col("event_id") % 29 == 0, "x").otherwise(F.lag("digest").over(Window.partitionBy("g").orderBy("seq")))
    out = ad.replayed(log.withColumn("previous", previous).withColumn("at", F.col("n")), "g", ALLOWED, "kind", "at", "digest", "previous")
    return out.select("event_id", "reason")


@query(
    "order_validation",
    f"""WITH {EVENTS_SQL}, o AS (SELECT event_id, g, CASE WHEN kind IN ('click', 'view') THEN 'buy' ELSE 'sell' END AS side, floor(value)::BIGINT AS price, k AS units, 80 AS capacity, event_id % 31 AS horizon, kind = 'error' AS live FROM ev), b AS (SELECT g, min(CASE WHEN side = 'sell' THEN price END) AS ask, max(CASE WHEN side = 'buy' THEN price END) AS bid FROM o WHERE live GROUP BY g)
        SELECT event_id, CASE WHEN horizon = 0 THEN 'horizon' WHEN units < 1 OR units % 2 <> 0 THEN 'lot' WHEN units > capacity THEN 'capacity' WHEN price <= 0 OR price % 3 <> 0 THEN 'tick' WHEN side = 'buy' AND price >= ask OR side = 'sell' AND price <= bid THEN 'crosses' END AS reason FROM o LEFT JOIN b USING (g) WHERE NOT live""",
)
def order_validation(spark, sf):
    """Orders that a venue would refuse, some since they cross the account's own."""
    o = events(spark, sf).select(
        "event_id", "g", F.when(F.col("kind").isin("click", "view"), "buy").otherwise("sell").alias("side"), F.floor("value").alias("price"), F.col("k").alias("units"), F.lit(80).alias("capacity"), (F.col("event_id") % 31).alias("horizon"), (F.col("kind") == "error").alias("live")
    )
    return ad.order_refusals(o.filter("not live"), o.filter("live"), "g", 3, 2).select("event_id", "reason")


@query("note_eligibility", "WITH r AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS digest FROM documents) SELECT r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'SOURCE_MISSING' WHEN sha256(d.text) <> digest THEN 'SOURCE_CHANGED' ELSE 'CURRENT' END AS status FROM r LEFT JOIN (SELECT * FROM documents WHERE n_chars > 100) d USING (doc_id)")
def note_eligibility(spark, sf):
    """Stored notes whose source is missing or has changed since."""
    d = read(spark, sf, "documents")
    records = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return ad.note_sources(records, d.filter("n_chars > 100"), "doc_id", "digest", "text").select("doc_id", "status")


PARTS = [(n, m, u) for n in (1, 7, 100, 1000) for m in (1, 3, 8) for u in (False, True)]


@query(
    "work_partitions",
    f"""WITH p(n, parts, upper_rows) AS (VALUES {", ".join(f"({n}, {m}, {u})" for n, m, u in PARTS)}), e AS (SELECT n, parts, upper_rows, least(parts, n) AS m, unnest(range(0, least(parts, n) + 1)) AS k FROM p)
        SELECT n, parts, upper_rows, k, ceil(n * k / m::DOUBLE)::BIGINT AS linear, CASE WHEN upper_rows THEN n - round_even((sqrt(1 + 4 * n * (n + 1) * (m - k) / m::DOUBLE) - 1) / 2, 0) ELSE round_even((sqrt(1 + 4 * n * (n + 1) * k / m::DOUBLE) - 1) / 2, 0) END::BIGINT AS triangular FROM e""",
)
def work_partitions(spark, sf):
    """Bounds of equal parts, of a list and of a triangle's rows."""
    rows = [(n, m, u, k, a, b) for n, m, u in PARTS for k, (a, b) in enumerate(zip(ad.linear_parts(n, m), ad.triangular_parts(n, m, u), strict=True))]
    return spark.createDataFrame(rows, "n int, parts int, upper_rows boolean, k long, linear long, triangular long")


@query("permuted_outcomes", f"WITH w AS (SELECT o_orderkey AS w, o_orderstatus = 'F' AS up FROM orders), a AS (SELECT *, row_number() OVER (ORDER BY w) AS i FROM w), b AS (SELECT row_number() OVER (ORDER BY {uniform_sql("'p'", 'w')}, w) AS i, up AS shuffled FROM w) SELECT w, up, shuffled FROM a JOIN b USING (i)")
def permuted_outcomes(spark, sf):
    """A control: each order's outcome replaced by that of another."""
    w = read(spark, sf, "orders").select(F.col("o_orderkey").alias("w"), (F.col("o_orderstatus") == "F").alias("up"))
    return ad.permuted_outcomes(w, "w", "up", uniform(F.lit("p"), "w"))


def _normal(name: str) -> str:
    return norm_ppf_sql(f"(({uniform_sql(repr(name), 'event_id')} * 0.999998) + 1e-6)")


@query("synthetic_features", f"WITH z AS (SELECT event_id, {_normal('i0')} AS i0, {_normal('i1')} AS i1, {_normal('n0')} AS n0, {_normal('e')} AS e FROM events) SELECT event_id, round(i0, 9) AS i0, round(i1, 9) AS i1, round(i1 + 0.1 * e, 9) AS r0, round(n0, 9) AS n0, (i0 + i1 > 0)::INT AS y FROM z")
def synthetic_features(spark, sf):
    """Informative, redundant and noise features and their label, drawn by hashes."""
    z = events(spark, sf).select("event_id", *[norm_ppf(uniform(F.lit(n), "event_id") * 0.999998 + 1e-6).alias(n) for n in ("i0", "i1", "n0", "e")])
    return z.select("event_id", F.round("i0", 9).alias("i0"), F.round("i1", 9).alias("i1"), F.round(F.col("i1") + 0.1 * F.col("e"), 9).alias("r0"), F.round("n0", 9).alias("n0"), (F.col("i0") + F.col("i1") > 0).cast("int").alias("y"))


KINDS = ("click", "error", "purchase", "signup", "view")


@query("wide_closes", f"WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type AS a, arg_max(value, event_id) AS c FROM events GROUP BY ALL), w AS (SELECT day, {', '.join(f'max(CASE WHEN a = {k!r} THEN c END) AS {k}' for k in KINDS)} FROM d GROUP BY day) SELECT day, {', '.join(f'{k}, round(lead({k}) OVER (ORDER BY day) / {k} - 1, 9) AS {k}_next' for k in KINDS)} FROM w")
def wide_closes(spark, sf):
    """Last values by day and kind as a wide table, with each one's change to the next day. Days are a bounded axis."""
    e = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", list(KINDS)).agg(F.max_by("value", "event_id"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    return e.select("day", *[c for k in KINDS for c in (F.col(k), F.round(F.try_divide(F.lead(k).over(w), F.col(k)) - 1, 9).alias(f"{k}_next"))])


@query("desk_formulas", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(ln(p / (1 - p)) - ln(q / (1 - q)), 9) AS deviation, round(least(1.0, 0.25 + 0.75 * sqrt(greatest(l_quantity - 10, 0) / 30)), 9) AS ramp FROM (SELECT *, coalesce(CASE WHEN l_returnflag <> 'N' THEN 0.1 + 8 * l_discount END, 0.1 + l_tax * 10) AS p, 0.1 + l_tax * 10 AS q FROM lineitem)")
def desk_formulas(spark, sf):
    """How far the last print is from fair (in logits; 0 before the first), and how much a new strategy is given by its age in days."""
    li = read(spark, sf, "lineitem")
    last = F.when(F.col("l_returnflag") != "N", 0.1 + 8 * F.col("l_discount"))
    dev = bt.dev_feature(last, 0.1 + F.col("l_tax") * 10)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.round(dev, 9).alias("deviation"), F.round(bt.allocation_ramp(F.col("l_quantity") - 10, 30.0, 0.25), 9).alias("ramp"))


DRAWN = 20


@query(
    "bootstrap_uniqueness",
    f"""WITH {SPANS_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id, t0, t1) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM spans), pk AS (SELECT g, floor({uniform_sql("'u'", "g", "0", "i")} * n)::BIGINT AS i, i AS place FROM nu), dr AS (SELECT nu.g, place, t0, t1 FROM pk JOIN nu ON nu.g = pk.g AND nu.i = pk.i),
        ed AS (SELECT g, t, sum(d) AS d FROM (SELECT g, t0 AS t, 1 AS d FROM dr UNION ALL SELECT g, t1, -1 FROM dr) GROUP BY ALL), se AS (SELECT g, t, lead(t) OVER w AS nx, sum(d) OVER w AS c FROM ed WINDOW w AS (PARTITION BY g ORDER BY t)),
        ar AS (SELECT g, t, coalesce(sum(CASE WHEN c > 0 THEN (nx - t) / c ELSE 0 END) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS area FROM se)
        SELECT dr.g, round(avg((b.area - a.area) / (t1 - t0)), 9) AS uniqueness FROM dr JOIN ar a ON a.g = dr.g AND a.t = t0 JOIN ar b ON b.g = dr.g AND b.t = t1 GROUP BY dr.g""",
)
def bootstrap_uniqueness(spark, sf):
    """Mean uniqueness of as many spans drawn with replacement, repeats counted apart."""
    drawn = resampled(spans(spark, sf).select("g", "id", "t0", "t1"), "g", ["id", "t0", "t1"], ["t0", "t1"], 1, "u")
    return rounded(sp.average_uniqueness(drawn, "g").groupBy("g").agg(F.avg("uniqueness").alias("uniqueness")), g=None, uniqueness=9)
