"""What the second round's findings showed, on small tables."""

import math

import duckdb
from pyspark.sql import functions as F

from tests.test_queries import TABLES
from tidelight.llm import html_text
from tidelight.operators import models, spans, stats
from tidelight.plans import stat_queries
from tidelight.plans.queries import ORACLE_SQL, QUERIES


def same_as_sql(spark, name, folder, digits=6):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in c.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()]
    got = [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def tables_with(sf, folder, **made):
    """The smallest tables in ``folder``, some of them made by SQL."""
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        c.sql(f"copy ({made.get(t, f'select * from {t}')}) to '{folder}/{t}.parquet'")
    return str(folder)


def test_active_bets_without_broadcast(spark, sf):
    """The mean is taken before the join there, where the last segment of a group has no open bet."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same_as_sql(spark, "active_bet_average", sf)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hold_to_expiry_from_nothing(spark, sf, tmp_path):
    """A user whose first value is zero stays flat in the SQL."""
    rows = "(0, timestamp '2024-01-01', 1, 'view', 0.0, '{}'), (1, timestamp '2024-01-02', 1, 'view', 3.0, '{}'), (2, timestamp '2024-01-01', 2, 'view', 2.0, '{}'), (3, timestamp '2024-01-02', 2, 'view', 4.0, '{}')"
    same_as_sql(spark, "hold_to_expiry", tables_with(sf, tmp_path, events=f"SELECT * REPLACE (event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, value::DOUBLE AS value) FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)"))


def line_items(*returns):
    """Line items of one supplier with these profits, in tenths, one each day."""
    rows = ", ".join(f"({n}, {0.05 if r > 0 else 0.03}, {abs(r) * 100.0}, timestamp '2024-01-01' + interval {n} day)" for n, r in enumerate(returns))
    return f"SELECT l.* REPLACE (v.n::BIGINT AS l_orderkey, 1::BIGINT AS l_suppkey, v.t::DOUBLE AS l_tax, v.q::DOUBLE AS l_quantity, v.d AS l_shipdate) FROM (VALUES {rows}) v(n, t, q, d), (SELECT * FROM lineitem LIMIT 1) l"


def test_windows_needed_without_edge(spark, sf, tmp_path):
    """Profits that sum to nothing have no Sharpe ratio above zero, though doubles leave a rest."""
    folder = tables_with(sf, tmp_path, lineitem=line_items(1, 2, -3))
    returns = stat_queries.exact_returns(spark, folder).orderBy("day").coalesce(1)
    for order in ("day", "r", "abs(r)", "-r"):
        assert stats.summary(returns.orderBy(F.expr(order)).coalesce(1), "g", "r").first()["sharpe"] == 0
    assert QUERIES["windows_needed"](spark, folder).first()["needed"] is None


def test_time_weighted_return_at_nothing(spark, sf, tmp_path):
    """An account of three that loses three tenths ten times is lost, whatever it would gain later; sums of doubles leave a rest above zero."""
    folder = tables_with(sf, tmp_path, lineitem=line_items(*[-3] * 10, 5))
    assert QUERIES["time_weighted_return"](spark, folder).first()["twrr"] == -1


def test_indicator_uniqueness_makes_no_rows_for_units(spark, sf):
    """Spans stay one row each, however long they are; repeated rows count twice."""
    rows = [("g", "a", 0, 3_000_000), ("g", "b", 30, 61), ("g", "c", 31, 60), ("h", "a", -61, 1), ("h", "a", -61, 1)]
    out = spans.grid_uniqueness(spark.createDataFrame(rows, "g string, id string, t0 long, t1 long"), "g", "id", 30)
    assert "Generate explode(sequence" not in out._jdf.queryExecution().toString()
    got = {(r["g"], r["id"]): (round(r["uniqueness"], 12), r["units"]) for r in out.collect()}
    assert got == {("g", "a"): (round((99_998 + 2 * 0.5) / 100_000, 12), 100_000), ("g", "b"): (0.5, 2), ("h", "a"): (0.5, 6)}


def test_places_need_no_task_for_a_group(spark):
    """Rows of a fold are numbered as by one sort, in ranges of their hash."""
    rows = spark.range(500).select((F.col("id") % 2).cast("int").alias("fold"), F.xxhash64("id").alias("h"), "id")
    got = [(r["fold"], r["id"]) for r in models.numbered(rows, "fold", "h", ["id"]).orderBy("fold", "_i").collect()]
    assert got == [(r["fold"], r["id"]) for r in rows.orderBy("fold", "h", "id").collect()]
    places = models.numbered(rows, "fold", "h", ["id"]).groupBy("fold").agg(F.sort_array(F.collect_list("_i")).alias("i")).collect()
    assert all(r["i"] == list(range(1, 251)) for r in places)


def test_importance_reads_the_tables_once(spark):
    """All fits and scores come from two written tables; the loss is the logistic regression's."""
    rows = [(k, float(k % 7), float(k % 7 + k % 3 > 4), 1.0 + k % 2) for k in range(300)]
    data = models.prepared(
        spark.createDataFrame(rows, "k long, x double, y double, w double"), ["x"], "y", "w", ["k"], 2,
        spark.createDataFrame([(k, f, "test" if k % 2 == f else "train") for k in range(300) for f in (0, 1)], "k long, test_fold int, role string"),
    )
    losses = {(r["fold"], r["feature"]): r["loss"] for r in models.cross_validate(data, ["x"], ["x"]).collect()}
    (a, b), = [c for at, c in models.fitted(data, [(["x"], 0.0)]).items() if at == (0, 0)]
    train = [(x, y, w) for k, x, y, w in rows if k % 2 == 1]
    p = [1 / (1 + math.exp(-(a * x + b))) for x, _, _ in train]
    assert abs(sum(w * (q - y) for q, (_, y, w) in zip(p, train, strict=True))) < 1e-6
    assert abs(sum(w * x * (q - y) for q, (x, y, w) in zip(p, train, strict=True))) < 1e-6
    assert losses[0, "none"] < losses[0, "x"] and losses[1, "none"] < losses[1, "x"]


def test_partner_beyond_many_copies(spark):
    """A page whose forty nearest pages on each side are its copies still meets its template's next page."""
    menu, copy = "<div>shop menu</div>", "<div>the one long text that all of these copies have, word by word, and more of it</div>"
    pages = [(k, f"http://h.example/a/{k:03d}", f"{menu}{copy}<div>{k}</div>") for k in range(81)]
    pages += [(100 + k, f"http://h.example/b/{k}", f"{menu}<div>another text of its own, number {k}, that has no copy at all</div>") for k in range(3)]
    out = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert not any("shop menu" in text for text in out.values())
    assert all(out[k].endswith(f"\n{k}") for k in range(81))
