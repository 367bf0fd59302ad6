"""Queries over joins in time, labels, and bitemporal lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.operators import asof, labels
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, epoch, events, read


def kind(e, name):
    return e.filter(F.col("kind") == name)


@query(
    "asof_last_print",
    f"""WITH {EVENTS_SQL} SELECT p.event_id, p.g, v.value AS last_value, v.event_id AS last_id, p.us - v.us AS age_us FROM (SELECT * FROM ev WHERE kind = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM ev WHERE kind = 'view') v ON p.g = v.g AND p.us >= v.us""",
)
def asof_last_print(spark, sf):
    """For each purchase the user's last view at or before it, and its age."""
    e = events(spark, sf)
    views = kind(e, "view").select("g", "us", F.col("value").alias("last_value"), F.col("event_id").alias("last_id"))
    hit = asof.asof_join(kind(e, "purchase").select("event_id", "g", F.col("us").alias("t")), views, "g", "t", "us", ["last_value", "last_id"], order=["last_id"])
    return hit.select("event_id", "g", "last_value", "last_id", (F.col("t") - F.col("matched_time")).alias("age_us"))


@query(
    "asof_bucketed",
    f"""WITH {EVENTS_SQL} SELECT p.event_id, v.event_id AS last_id FROM (SELECT *, 0 AS one FROM ev WHERE kind = 'purchase') p
        ASOF LEFT JOIN (SELECT *, 0 AS one FROM ev WHERE kind = 'error') v ON p.one = v.one AND p.us > v.us""",
)
def asof_bucketed(spark, sf):
    """The last error of any user strictly before each purchase: one group, cut into days that are carried forward."""
    e = events(spark, sf).withColumn("one", F.lit(0))
    errors = kind(e, "error").select("one", "us", F.col("event_id").alias("last_id"))
    hit = asof.asof_join(kind(e, "purchase").select("event_id", "one", F.col("us").alias("t")), errors, "one", "t", "us", ["last_id"], strict=True, order=["last_id"], bucket_seconds=86400 * 1000000)
    return hit.select("event_id", "last_id")


@query(
    "asof_hour_ago",
    f"""WITH {EVENTS_SQL}, v AS (SELECT * FROM ev WHERE kind = 'view'), p AS (SELECT * FROM ev WHERE kind = 'click'), a AS (SELECT p.*, v.value AS now_value, v.us AS now_us FROM p ASOF LEFT JOIN v ON p.g = v.g AND p.us >= v.us + 60000000),
        b AS (SELECT a.*, v.value AS then_value FROM a ASOF LEFT JOIN v ON a.g = v.g AND a.us - 86400000000 >= v.us + 60000000)
        SELECT event_id, CASE WHEN us - now_us <= 3 * 86400000000 THEN now_value END AS now_value, round(now_value - then_value, 6) AS change FROM b""",
)
def asof_hour_ago(spark, sf):
    """A value known a minute after its time, its change over a day, and a greatest age."""
    e = events(spark, sf)
    known = kind(e, "view").select("g", (F.col("us") + 60000000).alias("known"), "value", "event_id")
    p = kind(e, "click").select("event_id", "g", F.col("us").alias("t"), (F.col("us") - 86400000000).alias("t_before"))
    now = asof.asof_join(p, known.select("g", "known", F.col("value").alias("now_value"), F.col("event_id").alias("o")), "g", "t", "known", ["now_value"], order=["o"]).withColumnRenamed("matched_time", "now_known")
    both = asof.asof_join(now, known.select("g", "known", F.col("value").alias("then_value"), F.col("event_id").alias("o")), "g", "t_before", "known", ["then_value"], order=["o"])
    fresh = F.col("t") - (F.col("now_known") - 60000000) <= 3 * 86400000000
    return both.select("event_id", F.when(fresh, F.col("now_value")).alias("now_value"), F.round(F.col("now_value") - F.col("then_value"), 6).alias("change"))


@query(
    "asof_bitemporal",
    f"""WITH {EVENTS_SQL}, q AS (SELECT g, ts, ts + k * 3600 AS available, event_id // 3 AS seq, k AS rev, value FROM ev WHERE kind = 'view'), d AS (SELECT event_id, g, ts FROM ev WHERE kind = 'purchase')
        SELECT d.event_id, arg_max(value, (seq, rev, q.ts)) AS value, max(seq) AS seq FROM d LEFT JOIN q ON q.g = d.g AND q.available <= d.ts GROUP BY d.event_id""",
)
def asof_bitemporal(spark, sf):
    """The quote of greatest sequence and revision among those available by the decision; a late older one can't roll it back."""
    e = events(spark, sf)
    w = Window.partitionBy("g").orderBy("available", "row").rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct(F.floor(F.col("event_id") / 3).alias("seq"), F.col("k").alias("rev"), F.col("ts"), F.col("value"))
    best = kind(e, "view").select("g", (F.col("ts") + F.col("k") * 3600).alias("available"), row.alias("row")).withColumn("best", F.max("row").over(w))
    states = best.select("g", "available", "best.seq", "best.value", F.col("row").alias("o"))
    hit = asof.asof_join(kind(e, "purchase").select("event_id", "g", "ts"), states, "g", "ts", "available", ["value", "seq"], order=["o"])
    return hit.select("event_id", "value", "seq")


PATH = "ev AS (SELECT user_id AS g, event_id, floor(epoch(ts))::BIGINT AS ts, event_type AS kind, value FROM events), p AS (SELECT g, ts, arg_max(value, event_id) AS value FROM ev GROUP BY g, ts)"


def path(spark, sf):
    return events(spark, sf).groupBy("g", "ts").agg(F.max_by("value", "event_id").alias("value"))


@query("vertical_barrier", f"WITH {PATH} SELECT e.event_id, p.ts AS t1 FROM ev e ASOF LEFT JOIN p ON e.g = p.g AND e.ts + 86400 <= p.ts")
def vertical_barrier(spark, sf):
    """The first time of the user's path a day or more after each event."""
    e = events(spark, sf).select("event_id", "g", "ts")
    return labels.vertical_barrier(e, path(spark, sf).withColumnRenamed("ts", "pt"), "g", "ts", "pt", 86400).select("event_id", "t1")


BARRIER = f"""{PATH}, c AS (SELECT event_id, g, ts, value FROM ev WHERE kind = 'click'), j AS (SELECT c.event_id, p.ts AS pt, p.value / nullif(c.value, 0) - 1 AS r FROM c JOIN p ON p.g = c.g AND p.ts > c.ts AND p.ts <= c.ts + 172800),
    f AS (SELECT event_id, min(CASE WHEN r >= 0.5 THEN pt END) AS u, min(CASE WHEN r <= -0.5 THEN pt END) AS d, max(pt) AS l FROM j GROUP BY event_id),
    tb AS (SELECT f.event_id, CASE WHEN u < d OR (u IS NOT NULL AND d IS NULL) THEN u WHEN d < u OR (d IS NOT NULL AND u IS NULL) THEN d ELSE l END AS touch,
        CASE WHEN u < d OR (u IS NOT NULL AND d IS NULL) THEN 1 WHEN d < u OR (d IS NOT NULL AND u IS NULL) THEN -1 ELSE 0 END AS side FROM f), lab AS (SELECT tb.*, j.r AS ret FROM tb JOIN j ON j.event_id = tb.event_id AND j.pt = touch)"""


def barriers(spark, sf):
    clicks = events(spark, sf).filter("kind = 'click'").select("event_id", "g", "ts", "value")
    return labels.triple_barrier(clicks, path(spark, sf), "g", "ts", "value", "ts", "value", 0.5, 0.5, 172800)


@query("triple_barrier", f"WITH {BARRIER} SELECT event_id, touch, side, round(ret, 9) AS ret FROM lab")
def triple_barrier(spark, sf):
    """Which barrier the path touches first within two days of a click."""
    return barriers(spark, sf).select("event_id", "touch", "side", F.round("ret", 9).alias("ret"))


@query("meta_labels", f"WITH {BARRIER} SELECT event_id, CASE WHEN ret * (event_id % 3 - 1) > 0 THEN 1 ELSE 0 END AS y, sign(ret)::INT AS bin FROM lab WHERE event_id % 3 <> 1")
def meta_labels(spark, sf):
    """Whether a primary side was right, for events that have one."""
    side = F.col("event_id") % 3 - 1
    return barriers(spark, sf).filter(side != 0).select("event_id", F.when(F.col("ret") * side > 0, 1).otherwise(0).alias("y"), F.signum("ret").cast("int").alias("bin"))


@query(
    "fixed_horizon",
    """WITH o AS (SELECT user_id AS g, event_id, lag(value) OVER w AS ref, coalesce(lead(value, 4) OVER w, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fin
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(fin - ref, 6) AS ret, sign(fin - ref) AS label FROM o""",
)
def fixed_horizon(spark, sf):
    """Return over five steps from the price before each event."""
    return labels.fixed_horizon(events(spark, sf), "g", ["event_id"], "value", 5).select("event_id", F.round("ret", 6).alias("ret"), "label")


@query(
    "cusum_events",
    """WITH RECURSIVE r AS (SELECT user_id AS g, event_id, row_number() OVER w AS rn, coalesce(ln(nullif(value, 0) / nullif(lag(value) OVER w, 0)), 0) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        s AS (SELECT g, event_id, rn, 0::DOUBLE AS up, 0::DOUBLE AS dn, 0 AS flag FROM r WHERE rn = 1
        UNION ALL SELECT r.g, r.event_id, r.rn, CASE WHEN greatest(0, up + r.r) > 1 AND NOT least(0, dn + r.r) < -1 THEN 0 ELSE greatest(0, up + r.r) END,
            CASE WHEN least(0, dn + r.r) < -1 THEN 0 ELSE least(0, dn + r.r) END, CASE WHEN least(0, dn + r.r) < -1 THEN -1 WHEN greatest(0, up + r.r) > 1 THEN 1 ELSE 0 END FROM s JOIN r ON r.g = s.g AND r.rn = s.rn + 1)
        SELECT event_id, flag FROM s""",
)
def cusum_events(spark, sf):
    """Events where a user's cumulative log return passes 1 either way."""
    w = Window.partitionBy("g").orderBy("event_id")
    e = events(spark, sf).withColumn("r", F.ln(F.try_divide(F.col("value"), F.lag("value").over(w))))
    return labels.cusum_filter(e, "g", ["event_id"], "r", 1.0).select("event_id", "flag")


@query(
    "tape_normalise",
    """WITH t AS (SELECT DISTINCT l_suppkey AS g, l_orderkey, l_returnflag, l_quantity, l_extendedprice, floor(epoch(l_shipdate))::BIGINT AS ts FROM lineitem)
        SELECT g, ts, l_orderkey, l_returnflag, l_quantity, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 100000 - l_extendedprice END AS up_price,
        row_number() OVER (PARTITION BY g ORDER BY ts, l_orderkey, l_returnflag, l_quantity, l_extendedprice) AS seq FROM t""",
)
def tape_normalise(spark, sf):
    """Deduplicated fills, flipped to one side's frame and numbered anew."""
    t = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", epoch("l_shipdate").alias("ts")).dropDuplicates()
    w = Window.partitionBy("g").orderBy("ts", "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    up = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(100000 - F.col("l_extendedprice"))
    return t.select("g", "ts", "l_orderkey", "l_returnflag", "l_quantity", up.alias("up_price"), F.row_number().over(w).alias("seq"))


@query(
    "kline_gapfill",
    """WITH h AS (SELECT user_id AS g, floor(epoch(ts) / 3600)::BIGINT AS hr, arg_min(value, event_id) AS o, max(value) AS hi, min(value) AS lo, arg_max(value, event_id) AS c, count(*) AS n FROM events GROUP BY ALL),
        grid AS (SELECT g, unnest(range(min(hr), max(hr) + 1)) AS hr FROM h GROUP BY g), f AS (SELECT grid.g, grid.hr, o, hi, lo, last_value(c IGNORE NULLS) OVER (PARTITION BY grid.g ORDER BY grid.hr ROWS UNBOUNDED PRECEDING) AS c, coalesce(n, 0) AS n
            FROM grid LEFT JOIN h ON h.g = grid.g AND h.hr = grid.hr)
        SELECT g, hr, coalesce(o, c) AS open, coalesce(hi, c) AS high, coalesce(lo, c) AS low, c AS close, n FROM f""",
)
def kline_gapfill(spark, sf):
    """Hourly prices of each user on a full grid; empty hours repeat the last close."""
    e = events(spark, sf).withColumn("hr", F.floor(F.col("ts") / 3600))
    h = e.groupBy("g", "hr").agg(F.min_by("value", "event_id").alias("o"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("value", "event_id").alias("c"), F.count(F.lit(1)).alias("n"))
    grid = h.groupBy("g").agg(F.min("hr").alias("a"), F.max("hr").alias("z")).select("g", F.explode(F.sequence("a", "z")).alias("hr"))
    w = Window.partitionBy("g").orderBy("hr").rowsBetween(Window.unboundedPreceding, 0)
    f = grid.join(h, ["g", "hr"], "left").withColumn("c", F.last("c", ignorenulls=True).over(w))
    return f.select("g", "hr", F.coalesce("o", "c").alias("open"), F.coalesce("hi", "c").alias("high"), F.coalesce("lo", "c").alias("low"), F.col("c").alias("close"), F.coalesce("n", F.lit(0)).alias("n"))


RUNS = """d AS (SELECT DISTINCT user_id AS g, floor(epoch(ts) / 86400)::BIGINT AS day FROM events), i AS (SELECT g, day, day - row_number() OVER (PARTITION BY g ORDER BY day) AS key FROM d),
    runs AS (SELECT g, min(day) AS lo, max(day) + 1 AS hi, count(*) AS n FROM i GROUP BY g, key)"""


@query("contiguous_runs", f"WITH {RUNS} SELECT g, lo, hi, n FROM runs")
def contiguous_runs(spark, sf):
    """Maximal runs of days on which a user was seen."""
    return asof.contiguous_runs(events(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400)), ["g"], "day")


@query("covered_windows", f"WITH {RUNS} SELECT DISTINCT d.g, d.day FROM d JOIN runs r ON r.g = d.g AND r.lo <= d.day - 1 AND r.hi >= d.day + 2")
def covered_windows(spark, sf):
    """Days whose neighbours are also covered: containment in a run."""
    d = events(spark, sf).select("g", F.floor(F.col("ts") / 86400).alias("day")).distinct()
    runs = asof.contiguous_runs(d, ["g"], "day").withColumnRenamed("g", "rg")
    return d.join(runs, (d["g"] == runs["rg"]) & (runs["lo"] <= d["day"] - 1) & (runs["hi"] >= d["day"] + 2), "left_semi")


@query(
    "matched_decreases",
    f"""WITH {EVENTS_SQL}, c AS (SELECT event_id, g, ts, k FROM ev WHERE kind = 'error'), t AS (SELECT g, ts, k FROM ev WHERE kind = 'purchase')
        SELECT g, count(*) AS decreases, sum(CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.g = c.g AND abs(t.k - c.k) <= 5 AND abs(t.ts - c.ts) <= 86400) THEN 1 ELSE 0 END)::BIGINT AS matched FROM c GROUP BY g""",
)
def matched_decreases(spark, sf):
    """Band join: decreases that a trade of about the same level explains within a day."""
    e = events(spark, sf)
    c, t = kind(e, "error").select("event_id", "g", "ts", "k"), kind(e, "purchase").select("g", F.col("ts").alias("tt"), F.col("k").alias("tk"))
    near = asof.range_join(c, t, "g", F.col("ts") - 86400, F.col("ts") + 86400, "tt", 86400).filter(F.abs(F.col("tk") - F.col("k")) <= 5).select("event_id").distinct().withColumn("hit", F.lit(1))
    return c.join(near, "event_id", "left").groupBy("g").agg(F.count(F.lit(1)).alias("decreases"), F.coalesce(F.sum("hit"), F.lit(0)).alias("matched"))


@query(
    "snapshot_as_of",
    """WITH v AS (SELECT source, doc_id, 1000 + (doc_id * 37) % 5000 AS available, n_chars FROM documents) SELECT source, arg_max(doc_id, (available, doc_id)) AS doc_id, max(available) AS available FROM v WHERE available <= 4000 GROUP BY source""",
)
def snapshot_as_of(spark, sf):
    """The latest snapshot of each source that was available by an instant."""
    v = read(spark, sf, "documents").select("source", "doc_id", (1000 + (F.col("doc_id") * 37) % 5000).alias("available"))
    return v.filter("available <= 4000").groupBy("source").agg(F.max_by("doc_id", F.struct("available", "doc_id")).alias("doc_id"), F.max("available").alias("available"))


@query(
    "missing_labels",
    "SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, CASE WHEN l.doc_id IS NULL THEN 'NO_LABEL' WHEN sha256(d.text) IN (SELECT sha256(text) FROM documents GROUP BY text HAVING count(*) > 1) THEN 'COPIED' ELSE 'OK' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def missing_labels(spark, sf):
    """Semi-join with reasons for what is left out."""
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels").select("doc_id", F.lit(True).alias("hit"))
    copied = d.groupBy(F.sha2("text", 256).alias("sha")).count().filter("count > 1").select("sha", F.lit(True).alias("copied"))
    j = d.select("doc_id", F.sha2("text", 256).alias("sha")).join(lab, "doc_id", "left").join(copied, "sha", "left")
    return j.select("doc_id", F.coalesce("hit", F.lit(False)).alias("labelled"), F.when(F.col("hit").isNull(), "NO_LABEL").when(F.col("copied"), "COPIED").otherwise("OK").alias("status"))
