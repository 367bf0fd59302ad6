"""Queries over messages, series and text collections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.functions.distributions import uniform, uniform_sql
from tidelight.operators import sequences as sq
from tidelight.operators import spans as sp
from tidelight.operators.evaluation import resampled
from tidelight.plans.registry import query
from tidelight.sources.tables import EVENTS_SQL, SPANS_SQL, epoch, events, read, spans


@query(
    "entropy_plugin",
    f"""WITH {EVENTS_SQL}, w AS (SELECT g, kind AS a, lead(kind) OVER (PARTITION BY g ORDER BY event_id) AS b FROM ev), c1 AS (SELECT g, a, count(*) AS n FROM w GROUP BY ALL), c2 AS (SELECT g, a, b, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY ALL),
        h1 AS (SELECT g, -sum(n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS t FROM c1) GROUP BY g), h2 AS (SELECT g, -sum(n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS t FROM c2) GROUP BY g)
        SELECT g, round(h1.h, 8) AS h1, round(h2.h / 2, 8) AS h2 FROM h1 JOIN h2 USING (g)""",
)
def entropy_plugin(spark, sf):
    """Plug-in entropy of a user's event kinds by words of one and two."""
    w = Window.partitionBy("g").orderBy("event_id")
    e = events(spark, sf).select("g", F.col("kind").alias("a"), F.lead("kind").over(w).alias("b"))

    def entropy(counts, name):
        share = F.col("count") / F.sum("count").over(Window.partitionBy("g"))
        return counts.withColumn("p", share).groupBy("g").agg((-F.sum(F.col("p") * F.log2("p"))).alias(name))

    one, two = entropy(e.groupBy("g", "a").count(), "h1"), entropy(e.filter("b is not null").groupBy("g", "a", "b").count(), "h2")
    return one.join(two, "g").select("g", F.round("h1", 8).alias("h1"), F.round(F.col("h2") / 2, 8).alias("h2"))


@query(
    "mutual_information",
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), hx AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(n) / max(t) AS p FROM c, t GROUP BY x)), hy AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(n) / max(t) AS p FROM c, t GROUP BY y)),
        hxy AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT n / t AS p FROM c, t)) SELECT round(hx.h, 8) AS hx, round(hy.h, 8) AS hy, round(hx.h + hy.h - hxy.h, 8) AS information FROM hx, hy, hxy""",
)
def mutual_information(spark, sf):
    """Entropies of two columns and what they share, from one pass of grouping sets."""
    c = read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set"))
    total = F.max(F.when(F.col("set") == 3, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    p = c.withColumn("p", F.col("n") / total).groupBy("set").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    pick = lambda k: F.max(F.when(F.col("set") == k, F.col("h")))
    return p.agg(F.round(pick(1), 8).alias("hx"), F.round(pick(2), 8).alias("hy"), F.round(pick(1) + pick(2) - pick(0), 8).alias("information"))


@query("entropy_lz")
def entropy_lz(spark, sf):
    """Lempel-Ziv share and Kontoyiannis rate of each user's sequence of event kinds."""
    return sq.per_series(events(spark, sf), "g", "event_id", "kind", "lz double, rate double", lambda x: {"lz": [sq.lempel_ziv(x.tolist())], "rate": [sq.kontoyiannis(x.tolist())]})


@query(
    "message_encoding",
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, (value >= a)::INT + (value >= b)::INT + (value >= c)::INT AS quantile, least(greatest(floor((value - 50) / 60)::INT, 0), 6) AS sigma, (value > 250)::INT AS up FROM events, q",
)
def message_encoding(spark, sf):
    """Values as symbols: by quantile edges, by fixed steps, and by sign."""
    e = read(spark, sf, "events")
    edges = e.agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("edges"))  # one row
    v = F.col("value")
    return e.crossJoin(F.broadcast(edges)).select(
        "event_id", F.size(F.filter("edges", lambda x: x <= v)).alias("quantile"), F.least(F.greatest(F.floor((v - 50) / 60).cast("int"), F.lit(0)), F.lit(6)).alias("sigma"), (v > 250).cast("int").alias("up")
    )


@query("message_words", "SELECT conv_id, string_agg(substr(role, 1, 1), '' ORDER BY turn) AS message FROM conversations GROUP BY conv_id")
def message_words(spark, sf):
    """A conversation's roles as a string of symbols."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("s")))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda t: t["s"]), "").alias("message"))


FFD = sq.ffd_weights(0.4, 1e-2)
DAILY_SQL = "daily AS (SELECT o_orderpriority AS g, floor(epoch(o_orderdate) / 86400)::BIGINT AS day, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY ALL)"


def daily(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.floor(epoch("o_orderdate") / 86400).alias("day")).agg((F.sum("o_totalprice") / 1e6).alias("v"))


@query(
    "ffd",
    f"""WITH {DAILY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) AS rn FROM daily), w(k, w) AS (VALUES {", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(FFD))})
        SELECT a.g, a.day, CASE WHEN a.rn >= {len(FFD)} THEN round(sum(b.v * w), 7) END AS diff FROM n a JOIN n b ON a.g = b.g AND b.rn <= a.rn AND b.rn > a.rn - {len(FFD)} JOIN w ON w.k = a.rn - b.rn GROUP BY a.g, a.day, a.rn""",
)
def ffd(spark, sf):
    """Fixed-width fractional difference of daily totals."""
    return sq.frac_diff(daily(spark, sf), "g", "day", "v", 0.4, 1e-2).select("g", "day", F.round("diff", 7).alias("diff"))


@query("min_ffd")
def min_ffd(spark, sf):
    """Dickey-Fuller t of each series at several orders of differencing."""

    def grid(x):
        ds = [0.0, 0.25, 0.5, 0.75, 1.0]
        return {"d": ds, "t": [sq.adf(np.convolve(x, sq.ffd_weights(d, 1e-2))[len(sq.ffd_weights(d, 1e-2)) - 1 : len(x)]) for d in ds]}

    return sq.per_series(daily(spark, sf), "g", "day", "v", "d double, t double", grid)


MONTH_SQL = "m AS (SELECT l_suppkey AS g, year(l_shipdate) * 12 + month(l_shipdate) AS t, sum(l_extendedprice) / sum(l_quantity) / 100 AS y FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) - 1 AS i FROM m)"


def monthly(spark, sf):
    """Mean price of each supplier's months."""
    li = read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("g"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity") / 100).alias("y"))


@query(
    "csw_cusum",
    f"""WITH {MONTH_SQL}, d AS (SELECT g, i, y, sum(pow(y - coalesce(y0, y), 2)) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS q FROM (SELECT *, lag(y) OVER (PARTITION BY g ORDER BY i) AS y0 FROM n))
        SELECT a.g, a.i, round(max((a.y - b.y) / (sqrt(a.q / (a.i - 1)) * sqrt(a.i - b.i)) / sqrt(4.6 + ln(a.i - b.i))), 6) AS stat FROM d a JOIN d b ON a.g = b.g AND b.i < a.i WHERE a.i >= 2 GROUP BY a.g, a.i""",
)
def csw_cusum(spark, sf):
    """CUSUM of levels against all earlier levels, as a share of its critical value."""
    out = sq.per_series(monthly(spark, sf), "g", "t", "y", "i long, stat double", lambda y: {"i": list(range(len(y))), "stat": sq.csw_cusum(y).tolist()})
    return out.filter("i >= 2").select("g", "i", F.round("stat", 6).alias("stat"))


@query(
    "bsadf",
    f"""WITH {MONTH_SQL}, d AS (SELECT g, i, y AS x, lead(y) OVER (PARTITION BY g ORDER BY i) - y AS d FROM n), k AS (SELECT * FROM d WHERE d IS NOT NULL),
        w AS (SELECT e.g, e.i AS fin, s.i AS start, count(*) AS m, sum(k.x) AS sx, sum(k.x * k.x) AS sxx, sum(k.d) AS sd, sum(k.x * k.d) AS sxd, sum(k.d * k.d) AS sdd FROM k e JOIN k s ON s.g = e.g AND e.i - s.i + 1 >= 20 JOIN k ON k.g = e.g AND k.i BETWEEN s.i AND e.i GROUP BY ALL),
        b AS (SELECT *, sxx - sx * sx / m AS vx, sxd - sx * sd / m AS cxd FROM w), r AS (SELECT *, cxd / vx AS beta, sdd - sd * sd / m - cxd / vx * cxd AS rss FROM b)
        SELECT g, fin + 1 AS i, round(max(beta / sqrt(rss / (m - 2) / vx)), 5) AS stat FROM r GROUP BY g, fin""",
)
def bsadf(spark, sf):
    """Backward supremum of Dickey-Fuller statistics."""
    out = sq.per_series(monthly(spark, sf), "g", "t", "y", "i long, stat double", lambda y: {"i": list(range(len(y))), "stat": sq.bsadf(y).tolist()})
    return out.filter(~F.isnan("stat")).select("g", "i", F.round("stat", 5).alias("stat"))


@query(
    "chow_dfc",
    f"""WITH {MONTH_SQL}, d AS (SELECT g, i, y AS x, lead(y) OVER (PARTITION BY g ORDER BY i) - y AS d FROM n), k AS (SELECT *, count(*) OVER (PARTITION BY g) AS m, sum(d * d) OVER (PARTITION BY g) AS dd, sum(x * x) OVER w AS sxx, sum(x * d) OVER w AS sxd FROM d WHERE d IS NOT NULL WINDOW w AS (PARTITION BY g ORDER BY i DESC ROWS UNBOUNDED PRECEDING))
        SELECT g, round(max(sxd / sxx / sqrt(greatest(dd - sxd / sxx * sxd, 1e-300) / greatest(m - 1, 1) / sxx)), 7) AS sdfc FROM k WHERE i >= floor(m * 0.15) AND i < floor(m * 0.85) GROUP BY g""",
)
def chow_dfc(spark, sf):
    """Supremum of Chow-type Dickey-Fuller statistics of every supplier."""
    return sq.per_series(monthly(spark, sf), "g", "t", "y", "sdfc double", lambda y: {"sdfc": [round(sq.chow(y), 7)]}).filter(~F.isnan("sdfc"))


@query(
    "holding_period",
    f"""WITH RECURSIVE {EVENTS_SQL}, x AS (SELECT g, ts::DOUBLE AS t, sum(CASE kind WHEN 'purchase' THEN 1.0 WHEN 'click' THEN -1.0 ELSE 0 END) OVER w AS p, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY g ORDER BY event_id)),
        s AS (SELECT g, rn, p, 0::DOUBLE AS held, 0::DOUBLE AS weight, 0::DOUBLE AS entry FROM x WHERE rn = 1 UNION ALL SELECT x.g, x.rn, x.p,
            held + CASE WHEN s.p * x.p < 0 THEN (x.t - entry) * abs(s.p) WHEN abs(x.p) < abs(s.p) THEN (x.t - entry) * (abs(s.p) - abs(x.p)) ELSE 0 END, weight + CASE WHEN s.p * x.p < 0 THEN abs(s.p) WHEN abs(x.p) < abs(s.p) THEN abs(s.p) - abs(x.p) ELSE 0 END,
            CASE WHEN s.p * x.p < 0 THEN x.t WHEN abs(x.p) > abs(s.p) THEN (entry * abs(s.p) + x.t * (abs(x.p) - abs(s.p))) / abs(x.p) ELSE entry END FROM s JOIN x ON x.g = s.g AND x.rn = s.rn + 1)
        SELECT g, round(arg_max(held / nullif(weight, 0), rn) / 86400, 6) AS days FROM s GROUP BY g""",
)
def holding_period(spark, sf):
    """Mean holding time of each account's units."""
    w = Window.partitionBy("g").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = events(spark, sf).withColumn("p", F.sum(F.when(F.col("kind") == "purchase", 1.0).when(F.col("kind") == "click", -1.0).otherwise(0.0)).over(w))
    both = p.select("g", "event_id", F.struct(F.col("ts").cast("double").alias("t"), "p").alias("x"))

    def f(x):
        return {"days": [sq.holding_period(np.array([v["t"] for v in x]), np.array([v["p"] for v in x])) / 86400]}

    return sq.per_series(both, "g", "event_id", "x", "days double", f).select("g", F.round(F.when(~F.isnan("days"), F.col("days")), 6).alias("days"))


@query("hrp_weights")
def hrp_weights(spark, sf):
    """Hierarchical risk parity over five order priorities; the covariance is computed in the cluster, a row for each pair."""
    d = daily(spark, sf)
    a, b = d.select("day", F.col("g").alias("a"), F.col("v").alias("x")), d.select("day", F.col("g").alias("b"), F.col("v").alias("y"))
    if d.select("g").distinct().count() > 2048:
        raise ValueError("a covariance of more than 2,048 assets doesn't fit one machine")
    cov = a.join(b, "day").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c")).orderBy("a", "b").collect()  # assets squared, 2,048 at most
    names = sorted({r["a"] for r in cov})
    m = np.array([r["c"] for r in cov]).reshape(len(names), -1)
    w, iv = sq.hierarchical_risk_parity((m + m.T) / 2), sq.inverse_variance(m)
    return spark.createDataFrame([(n, float(x), float(y)) for n, x, y in zip(names, w, iv, strict=True)], "asset string, hrp double, inverse_variance double")


@query("seq_bootstrap")
def seq_bootstrap(spark, sf):
    """Sequential bootstrap of each supplier's spans: how often each is drawn."""
    s = spans(spark, sf).select("g", "id", F.struct("t0", "t1").alias("span"))

    def draw(x):
        t0, t1 = np.array([v["t0"] for v in x]), np.array([v["t1"] for v in x])
        n = np.bincount(sq.sequential_bootstrap(t0, t1, len(t0), 7), minlength=len(t0))
        return {"place": list(range(len(t0))), "draws": n.tolist()}

    return sq.per_series(s, "g", "id", "span", "place long, draws long", draw)


INDICATOR = f"""WITH {SPANS_SQL}, u AS (SELECT g, id, unnest(generate_series(CAST(ceil(t0 / 30.0) AS BIGINT) * 30, t1 - 1, 30)) AS d FROM spans), c AS (SELECT g, d, count(*) AS c FROM u GROUP BY ALL)
    SELECT id, round(avg(1.0 / c), 9) AS uniqueness, count(*) AS units FROM u JOIN c USING (g, d) GROUP BY g, id"""


@query("indicator_uniqueness", INDICATOR)
def indicator_uniqueness(spark, sf):
    """Uniqueness from the sparse indicator matrix of every supplier's spans, on a grid of every thirtieth day."""
    return sp.grid_uniqueness(spans(spark, sf), "g", "id", 30).select("id", F.round("uniqueness", 9).alias("uniqueness"), "units")


WANTED = ["and", "the", "of", "license"]


@query(
    "note_search",
    f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS terms FROM documents) SELECT doc_id, round(1 - len(list_intersect(terms, {WANTED!r})) / {len(WANTED)}.0, 6) AS distance FROM t ORDER BY distance, doc_id LIMIT 10""",
)
def note_search(spark, sf):
    """The ten documents that hold the most of the wanted terms."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    hits = F.size(F.array_intersect(terms, F.array(*map(F.lit, WANTED))))
    return read(spark, sf, "documents").select("doc_id", F.round(1 - hits / len(WANTED), 6).alias("distance")).orderBy("distance", "doc_id").limit(10)


@query(
    "vector_topk",
    "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 7) AS distance FROM embeddings, q WHERE vec_id <> 0 ORDER BY 2, 1 LIMIT 10",
)
def vector_topk(spark, sf):
    """The ten vectors nearest to one by cosine distance."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(e.filter("vec_id = 0").limit(1).select(F.col("v").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    distance = 1 - dot("v", "q") / F.sqrt(dot("q", "q")) / F.sqrt(dot("v", "v"))
    return e.filter("vec_id <> 0").crossJoin(q).select("vec_id", F.round(distance, 7).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("recent_papers", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 20")
def recent_papers(spark, sf):
    """Filtered, ordered and limited."""
    return read(spark, sf, "documents").filter("lang = 'en' and n_chars > 500").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("corpus_stats", "SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS en, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT source) AS sources FROM documents")
def corpus_stats(spark, sf):
    """Counts, a conditional count, and extremes."""
    return read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count_distinct("source").alias("sources"))


@query("insert_or_ignore", "SELECT doc_id, 'old' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def insert_or_ignore(spark, sf):
    """New rows whose key is not there yet, appended to the old ones."""
    d = read(spark, sf, "documents").select("doc_id")
    old, new = d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0")
    return old.withColumn("origin", F.lit("old")).unionByName(new.join(old, "doc_id", "left_anti").withColumn("origin", F.lit("new")))


@query("evenly_spaced", "WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, l_suppkey AS g FROM lineitem) SELECT g, i FROM r WHERE i IN (0, n // 4, n // 2, 3 * n // 4, n - 1)")
def evenly_spaced(spark, sf):
    """Five evenly spaced rows of each series, its ends included."""
    w = Window.partitionBy("g")
    r = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    r = r.withColumn("i", F.row_number().over(w.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return r.filter(F.expr("i in (0, n div 4, n div 2, 3 * n div 4, n - 1)")).select("g", "i")


KEY = ("l_orderkey", "l_linenumber", "l_partkey")


@query("keyed_subsample", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {uniform_sql(*KEY)}, {', '.join(KEY)}, l_shipdate) AS rn FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM k WHERE rn <= 5")
def keyed_subsample(spark, sf):
    """At most five rows of each supplier, chosen by a hash of their key."""
    w = Window.partitionBy("l_suppkey").orderBy(uniform(*KEY), *KEY, "l_shipdate")
    return read(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "block_bootstrap_ci",
    f"""WITH {EVENTS_SQL}, b AS (SELECT ts // 7200 AS block, sum(value) AS s, count(*) AS c, row_number() OVER (ORDER BY ts // 7200) - 1 AS i, count(*) OVER () AS n FROM ev GROUP BY ts // 7200), p AS (SELECT b, floor({uniform_sql("'k'", "0", "b", "i")} * n)::BIGINT AS i FROM b, range(200) t(b)),
        d AS (SELECT p.b, sum(s) / sum(c) AS m FROM p JOIN b USING (i) GROUP BY p.b), o AS (SELECT sum(s) / sum(c) AS mean FROM b) SELECT round(quantile_cont(m, 0.025), 7) AS lo, round(quantile_cont(m, 0.975), 7) AS hi, round(any_value(mean), 7) AS mean, round((1 + count(*) FILTER (m - mean <= mean - 250)) / 201.0, 9) AS p FROM d, o""",
)
def block_bootstrap_ci(spark, sf):
    """Interval of the mean value by resampling blocks of two hours, and the share of centred means as low as its distance from 250."""
    b = events(spark, sf).groupBy(F.floor(F.col("ts") / 7200).alias("block")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c")).withColumn("all", F.lit(0))
    d = resampled(b, "all", ["block"], ["s", "c"], 200, "k").groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"))
    d = d.crossJoin(F.broadcast(b.agg((F.sum("s") / F.sum("c")).alias("mean"))))  # one row
    low = F.sum(F.when(F.col("m") - F.col("mean") <= F.col("mean") - 250, 1).otherwise(0))
    return d.agg(F.round(F.percentile("m", 0.025), 7).alias("lo"), F.round(F.percentile("m", 0.975), 7).alias("hi"), F.round(F.first("mean"), 7).alias("mean"), F.round((1 + low) / 201, 9).alias("p"))


@query("state_log_chain", "SELECT event_id, lag(sha256(concat(event_id, '|', event_type))) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_hash FROM events")
def state_log_chain(spark, sf):
    """Hash of the record before, as a chain that a replay can verify."""
    digest = F.sha2(F.concat_ws("|", F.col("event_id"), F.col("event_type")), 256)
    return read(spark, sf, "events").select("event_id", F.lag(digest).over(Window.partitionBy("user_id").orderBy("event_id")).alias("prev_hash"))
