"""Queries over label spans of the suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.operators import asof, spans as sp
from tidelight.plans.registry import query
from tidelight.sources.tables import SPANS_SQL, spans

SEG_SQL = f"""{SPANS_SQL}, edges AS (SELECT g, t0 AS lo, 1 AS d, size AS v, side FROM spans UNION ALL SELECT g, t1, -1, -size, side FROM spans),
    pts AS (SELECT g, lo, sum(d) AS d, sum(v) AS v, sum(CASE WHEN side > 0 THEN d ELSE 0 END) AS dl, sum(CASE WHEN side < 0 THEN d ELSE 0 END) AS ds FROM edges GROUP BY g, lo),
    seg AS (SELECT g, lo, lead(lo) OVER w AS hi, sum(d) OVER w AS c, sum(v) OVER w AS v, sum(dl) OVER w AS cl, sum(ds) OVER w AS cs FROM pts WINDOW w AS (PARTITION BY g ORDER BY lo))"""
UNIQ_SQL = f"""{SEG_SQL}, pre AS (SELECT g, lo, coalesce(sum(CASE WHEN c > 0 THEN (hi - lo) / c ELSE 0 END) OVER (PARTITION BY g ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS area FROM seg),
    uq AS (SELECT s.*, (b.area - a.area) / (s.t1 - s.t0) AS uniqueness FROM spans s JOIN pre a ON a.g = s.g AND a.lo = s.t0 JOIN pre b ON b.g = s.g AND b.lo = s.t1)"""


@query("avg_uniqueness", f"WITH {UNIQ_SQL} SELECT g, id, round(uniqueness, 9) AS uniqueness FROM uq")
def avg_uniqueness(spark, sf):
    """Mean of 1 / concurrency over each span."""
    return sp.average_uniqueness(spans(spark, sf), "g").select("g", "id", F.round("uniqueness", 9).alias("uniqueness"))


@query("span_concurrency", f"WITH {SEG_SQL} SELECT g, lo AS t, c::BIGINT AS open, round(CASE WHEN c > 0 THEN v / c ELSE 0 END, 6) AS mean_size FROM seg")
def span_concurrency(spark, sf):
    """Spans open at each start and end, and the mean size of open bets."""
    s = sp.segments(spans(spark, sf), "g", "size")
    return s.select("g", F.col("lo").alias("t"), F.col("c").alias("open"), F.round(F.when(F.col("c") > 0, F.col("v") / F.col("c")).otherwise(0.0), 6).alias("mean_size"))


@query(
    "budget_size",
    f"""WITH {SEG_SQL} SELECT g, lo AS t, cl::BIGINT AS long, cs::BIGINT AS short,
        round(coalesce(cl / nullif(max(cl) OVER (PARTITION BY g), 0), 0) - coalesce(cs / nullif(max(cs) OVER (PARTITION BY g), 0), 0), 9) AS size FROM seg""",
)
def budget_size(spark, sf):
    """Long and short concurrency, each as a share of its greatest."""
    s = spans(spark, sf)
    long = sp.segments(s.withColumn("l", F.when(F.col("side") > 0, 1).otherwise(0)), "g", "l").select("g", "lo", F.col("v").alias("long"), (F.col("c") - F.col("v")).alias("short"))
    w = Window.partitionBy("g")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))
    return long.select("g", F.col("lo").alias("t"), F.col("long").cast("long").alias("long"), F.col("short").cast("long").alias("short"), F.round(share("long") - share("short"), 9).alias("size"))


@query(
    "active_bet_average",
    f"WITH {SEG_SQL} SELECT s.g, s.id, round(v / c, 6) AS active FROM spans s JOIN seg ON seg.g = s.g AND seg.lo = s.t0",
)
def active_bet_average(spark, sf):
    """Mean size of the bets open when each one is made."""
    s = spans(spark, sf)
    seg = sp.segments(s, "g", "size").select("g", F.col("lo").alias("t0"), F.round(F.try_divide("v", "c"), 6).alias("active"))  # none are open after the last end
    return s.join(seg, ["g", "t0"]).select("g", "id", "active")


RET_SQL = "ret AS (SELECT l_suppkey AS g, floor(epoch(l_shipdate) / 86400)::BIGINT AS u, sum(l_tax - 0.04) AS r FROM lineitem GROUP BY 1, 2)"


@query(
    "return_attribution",
    f"""WITH {SEG_SQL}, {RET_SQL}, con AS (SELECT ret.g, u, r, seg.c FROM ret ASOF JOIN seg ON ret.g = seg.g AND ret.u >= seg.lo), sh AS (SELECT g, u, CASE WHEN c > 0 THEN r / c ELSE 0 END AS x FROM con),
        w AS (SELECT s.g, s.id, abs(coalesce(sum(x), 0)) AS w FROM spans s LEFT JOIN sh ON sh.g = s.g AND sh.u >= s.t0 AND sh.u < s.t1 GROUP BY s.g, s.id)
        SELECT g, id, round(w * count(*) OVER (PARTITION BY g) / nullif(sum(w) OVER (PARTITION BY g), 0), 6) AS weight FROM w""",
)
def return_attribution(spark, sf):
    """Weights by the return that each span attributes to itself."""
    s = spans(spark, sf)
    from tidelight.sources.tables import epoch, read

    returns = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.floor(epoch("l_shipdate") / 86400).alias("u")).agg(F.sum(F.col("l_tax") - 0.04).alias("r"))
    return sp.return_attribution(s, "g", returns).select("g", "id", F.round("weight", 6).alias("weight"))


@query(
    "time_decay",
    f"""WITH {UNIQ_SQL}, d AS (SELECT g, id, sum(uniqueness) OVER (PARTITION BY g ORDER BY t0, id ROWS UNBOUNDED PRECEDING) AS cum, sum(uniqueness) OVER (PARTITION BY g) AS last FROM uq)
        SELECT g, id, round(greatest(1 - 0.5 + 0.5 / last * cum, 0), 9) AS decay FROM d""",
)
def time_decay(spark, sf):
    """Linear decay of weights in cumulative uniqueness."""
    return sp.time_decay(sp.average_uniqueness(spans(spark, sf), "g"), "g", ["t0", "id"]).select("g", "id", F.round("decay", 9).alias("decay"))


FOLD_SQL = f"{SPANS_SQL}, f AS (SELECT *, ntile(5) OVER (PARTITION BY g ORDER BY t0, id) - 1 AS fold FROM spans)"


@query(
    "purged_kfold",
    f"""WITH {FOLD_SQL}, env AS (SELECT g, fold AS test_fold, min(t0) AS lo, max(t1) AS hi FROM f GROUP BY ALL)
        SELECT f.g, test_fold, CASE WHEN fold = test_fold THEN 'test' WHEN t0 < hi AND t1 > lo OR t0 >= hi AND t0 < hi + 30 THEN 'purged' ELSE 'train' END AS role, count(*) AS n FROM f JOIN env USING (g) GROUP BY ALL""",
)
def purged_kfold(spark, sf):
    """Rows of each role in five purged folds with an embargo of 30 days."""
    return sp.purged_kfold(spans(spark, sf), "g", ["t0", "id"], 5, 30).groupBy("g", "test_fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "purged_kfold_merged",
    f"""WITH {SPANS_SQL}, days AS (SELECT g, t0, ntile(5) OVER (PARTITION BY g ORDER BY t0) - 1 AS fold FROM (SELECT DISTINCT g, t0 FROM spans)), f AS (SELECT s.*, fold FROM spans s JOIN days USING (g, t0)),
        i AS (SELECT *, CASE WHEN t0 > max(t1) OVER (PARTITION BY g, fold ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM f),
        j AS (SELECT *, sum(fresh) OVER (PARTITION BY g, fold ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM i), st AS (SELECT g, fold AS test_fold, island, min(t0) AS lo, max(t1) AS hi FROM j GROUP BY ALL),
        tf AS (SELECT DISTINCT g, fold AS test_fold FROM f)
        SELECT f.g, test_fold, CASE WHEN fold = test_fold THEN 'test' WHEN EXISTS (SELECT 1 FROM st WHERE st.g = f.g AND st.test_fold = tf.test_fold AND (t0 < hi AND t1 > lo OR t0 >= hi AND t0 < hi + 10)) THEN 'purged' ELSE 'train' END AS role,
        count(*) AS n FROM f JOIN tf USING (g) GROUP BY ALL""",
)
def purged_kfold_merged(spark, sf):
    """The same by whole days, purged against merged stretches of test spans."""
    return sp.purged_by_stretches(spans(spark, sf), "g", "t0", 5, 10).groupBy("g", "test_fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("merge_spans", f"""WITH {SPANS_SQL}, i AS (SELECT *, CASE WHEN t0 > max(t1) OVER (PARTITION BY g ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM spans),
    j AS (SELECT *, sum(fresh) OVER (PARTITION BY g ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM i) SELECT g, min(t0) AS t0, max(t1) AS t1 FROM j GROUP BY g, island""")  # fmt: skip
def merge_spans(spark, sf):
    """Maximal stretches that a supplier's spans cover."""
    return asof.merge_spans(spans(spark, sf), "g")


@query(
    "cpcv_paths",
    """WITH s AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(6) AS x(a), range(6) AS y(b) WHERE a < b), m AS (SELECT split, unnest([a, b]) AS grp FROM s)
        SELECT row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path, grp, split FROM m""",
)
def cpcv_paths(spark, sf):
    """The split that supplies each group to each path, for two test groups of six."""
    return spark.createDataFrame(sp.backtest_paths(6, 2), "path long, grp long, split long")


@query(
    "cpcv_splits",
    f"""WITH {SPANS_SQL}, f AS (SELECT *, ntile(6) OVER (PARTITION BY g ORDER BY t0, id) - 1 AS fold FROM spans), env AS (SELECT g, fold AS tf, min(t0) AS lo, max(t1) AS hi FROM f GROUP BY ALL),
        s AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(6) AS x(a), range(6) AS y(b) WHERE a < b),
        p AS (SELECT f.g, id, split, bool_or(fold = tf) AS test, bool_or(t0 < hi AND t1 > lo OR t0 >= hi AND t0 < hi + 30) AS hit FROM f JOIN env USING (g) JOIN s ON tf = a OR tf = b GROUP BY ALL)
        SELECT g, split, sum(test::INT)::BIGINT AS n_test, sum((NOT test AND NOT hit)::INT)::BIGINT AS n_train FROM p GROUP BY ALL""",
)
def cpcv_splits(spark, sf):
    """Train and test sizes of all fifteen splits into two test groups of six, purged and with an embargo."""
    rows = sp.folds(spans(spark, sf), "g", ["t0", "id"], 6)
    env = rows.groupBy("g", F.col("fold").alias("tf")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    flags = rows.join(env, "g").select("g", "id", "tf", (F.col("fold") == F.col("tf")).alias("test"), ((F.col("t0") < F.col("hi")) & (F.col("t1") > F.col("lo")) | (F.col("t0") >= F.col("hi")) & (F.col("t0") < F.col("hi") + 30)).alias("hit"))
    choice = F.broadcast(spark.createDataFrame([(s, g) for s, groups in sp.combinatorial_splits(6, 2) for g in groups], "split long, tf int"))  # thirty rows
    per = flags.join(choice, "tf").groupBy("g", "id", "split").agg(F.bool_or("test").alias("test"), F.bool_or("hit").alias("hit"))
    one = lambda c: F.sum(c.cast("long"))
    return per.groupBy("g", "split").agg(one(F.col("test")).alias("n_test"), one(~F.col("test") & ~F.col("hit")).alias("n_train"))


@query(
    "group_index",
    f"WITH {SPANS_SQL} SELECT g, id, ntile(10) OVER (PARTITION BY g ORDER BY t0, id)::INT - 1 AS fold, coalesce(lead(t0, 5) OVER (PARTITION BY g ORDER BY t0, id), max(t0) OVER (PARTITION BY g)) AS embargo_until FROM spans",
)
def group_index(spark, sf):
    """Ten contiguous groups, and the time five rows later as the end of an embargo."""
    w = Window.partitionBy("g").orderBy("t0", "id")
    return sp.folds(spans(spark, sf), "g", ["t0", "id"], 10).select("g", "id", "fold", F.coalesce(F.lead("t0", 5).over(w), F.max("t0").over(Window.partitionBy("g"))).alias("embargo_until"))
