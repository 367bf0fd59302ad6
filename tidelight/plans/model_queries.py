"""Queries over models, recursive tests and compounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.operators import models
from tidelight.operators import sequences as sq
from tidelight.operators import spans as sp
from tidelight.plans.registry import query
from tidelight.plans.sequence_queries import DAILY_SQL, daily
from tidelight.sources.tables import events, spans


@query(
    "brown_durbin_evans",
    f"""WITH {DAILY_SQL}, m AS (SELECT g, day, v, row_number() OVER w - 1 AS n, avg(v) OVER (PARTITION BY g ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM daily WINDOW w AS (PARTITION BY g ORDER BY day)),
        r AS (SELECT *, (v - past) / sqrt(1 + 1.0 / n) AS w FROM m WHERE n > 0), s AS (SELECT *, w / stddev_pop(w) OVER (PARTITION BY g) AS z FROM r)
        SELECT g, day, round(sum(z) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS cusum FROM s""",
)
def brown_durbin_evans(spark, sf):
    """Cumulative standardised one-step forecast errors of the running mean."""
    w = Window.partitionBy("g").orderBy("day")
    d = daily(spark, sf).withColumn("n", F.row_number().over(w) - 1).withColumn("past", F.avg("v").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("n > 0")
    r = d.withColumn("w", (F.col("v") - F.col("past")) / F.sqrt(1 + 1 / F.col("n")))
    z = r.withColumn("z", F.col("w") / F.stddev_pop("w").over(Window.partitionBy("g")))
    return z.select("g", "day", F.round(F.sum("z").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("cusum"))


@query(
    "bankroll_simulation",
    """WITH RECURSIVE r AS (SELECT user_id AS g, event_id, (value - 250) / 2500 AS ret, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        k AS (SELECT g, event_id, rn, 1000 + least(100.0, 150.0) * ret AS bank FROM r WHERE rn = 1 UNION ALL SELECT r.g, r.event_id, r.rn, bank + least(0.1 * bank, 150) * r.ret FROM k JOIN r ON r.g = k.g AND r.rn = k.rn + 1) SELECT event_id, round(bank, 5) AS bankroll FROM k""",
)
def bankroll_simulation(spark, sf):
    """A bankroll that stakes a tenth of itself on each bet, at most 150."""
    e = events(spark, sf).select("g", "event_id", F.struct("event_id", ((F.col("value") - 250) / 2500).alias("r")).alias("x"))

    def f(x):
        bank, out = 1000.0, []
        for v in x:
            bank += min(0.1 * bank, 150.0) * v["r"]
            out.append(bank)
        return {"id": [v["event_id"] for v in x], "bank": out}

    return sq.per_series(e, "g", "event_id", "x", "id long, bank double", f).select(F.col("id").alias("event_id"), F.round("bank", 5).alias("bankroll"))


@query("har_fit")
def har_fit(spark, sf):
    """Log variance of daily changes on its means over one, five and twenty-two days."""
    w = Window.partitionBy("g").orderBy("day")
    d = daily(spark, sf).withColumn("r", F.ln("v") - F.ln(F.lag("v").over(w))).withColumn("r2", F.col("r") * F.col("r") + 1e-6)
    mean = lambda k: F.when(F.count("r2").over(w.rowsBetween(-k, -1)) == k, F.ln(F.avg("r2").over(w.rowsBetween(-k, -1))))
    rows = d.select(F.ln("r2").alias("y"), mean(1).alias("d1"), mean(5).alias("d5"), mean(22).alias("d22"))
    beta = models.least_squares(rows, "y", ["d1", "d5", "d22"])
    return spark.createDataFrame([(k, round(v, 9)) for k, v in beta.items()], "term string, beta double")


FEATURES = ["x1", "x2", "noise"]


def labelled(spark, sf):
    """Every supplier's spans as labelled rows with the folds they test and train; folds and purging are within a supplier."""
    s = spans(spark, sf).withColumn("x2", (F.col("t1") - F.col("t0")).cast("double")).withColumn("t1", F.col("t0") + 30).select("g", "id", "t0", "t1", F.col("size").alias("x1"), "x2", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("noise"), (F.col("ret") > 0).cast("double").alias("y"), F.lit(1.0).alias("w"))
    return sp.purged_sets(s, "g", ["t0", "id"], 3, 5).withColumn("x1", F.col("x1") + 3 * F.col("y"))


@query("cv_importance")
def cv_importance(spark, sf):
    """Held-out loss of a logistic regression over purged folds, and its rise when a feature is permuted."""
    data = models.prepared(labelled(spark, sf), FEATURES, "y", "w", ["g", "id"], 3)
    return models.cross_validate(data, FEATURES, ["x1", "noise"]).groupBy("feature").agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("martingale_tests")
def martingale_tests(spark, sf):
    """Greatest quadratic trend statistic over all windows that end at each day of a series."""
    out = sq.per_series(daily(spark, sf), "g", "day", "v", "i long, smt double", lambda y: {"i": list(range(len(y))), "smt": sq.smt(y).tolist()})
    return out.filter(~F.isnan("smt"))


@query("feature_search")
def feature_search(spark, sf):
    """Held-out losses over purged folds: of each feature alone, of each penalty of a small grid, and with correlated features permuted together."""
    s = labelled(spark, sf).withColumn("x3", F.col("x1") + 0.1 * F.col("noise"))
    data = models.prepared(s, [*FEATURES, "x3"], "y", "w", ["g", "id"], 3)
    tried = [*[([f], 1e-4) for f in FEATURES], *[(FEATURES, penalty) for penalty in (1e-4, 1.0)]]
    found = {r["model"]: r["loss"] for r in models.search(data, tried).collect()}
    rows = [("alone", f, found[k]) for k, f in enumerate(FEATURES)]
    grid = {tried[k][1]: found[k] for k in range(len(FEATURES), len(tried))}
    best = min(grid, key=lambda penalty: (grid[penalty], -penalty))  # of equal ones the greater penalty
    rows += [("best penalty" if penalty == best else "penalty", "1.0E-4" if penalty == 1e-4 else str(penalty), loss) for penalty, loss in grid.items()]
    features = data.fit.select(*[F.col(f"f{k}").alias(f) for k, f in enumerate(data.features)])
    groups = models.correlation_clusters(features, data.features, 3)
    together = models.cross_validate(data, data.features, groups).groupBy("feature").agg(F.avg("loss").alias("loss"))
    rows += [("permuted", r["feature"], r["loss"]) for r in together.collect()]
    return spark.createDataFrame(rows, "kind string, name string, loss double").withColumn("loss", F.round("loss", 6))
