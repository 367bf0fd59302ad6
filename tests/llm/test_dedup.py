"""Exact, near, line and substring deduplication against brute force, and their odd cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidelight.llm import components, exact_dedup, line_dedup, near_dedup, queries, substring_dedup

LONG = " ".join(f"w{k}" for k in range(3000))
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "one"), (5, "One"), (6, LONG), (7, LONG), (8, LONG + " tail"), (9, "a b c"), (10, "a b c"), (11, None), (12, "Ünï çödé " * 40),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in ODD], "doc_id long, text string, n_words int, kept string")


def empty(odd):
    return odd.filter("false")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
NEAR = ("doc_id", "n_shingles", "component_id", "kept")
CUT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_exact(spark, sf, docs, odd):
    assert rows(queries.op3_exact_dedup(spark, sf), *EXACT) == exact(docs)
    assert rows(exact_dedup.mark_exact(odd), *EXACT) == exact(ODD)
    assert exact_dedup.mark_exact(empty(odd)).count() == 0


def test_exact_drop_keeps_columns_and_nulls(odd):
    left = exact_dedup.drop_exact(odd.unionByName(odd))
    assert left.columns == odd.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _, _, k, _ in exact(ODD) if k}
    assert left.count() == len({t or "" for _, t in ODD})


def test_near(spark, sf, docs, odd):
    assert rows(queries.op10_near_dedup(spark, sf), *NEAR) == brute.near(docs)
    assert rows(near_dedup.label_near(odd), *NEAR) == brute.near(ODD)
    assert near_dedup.label_near(empty(odd)).count() == 0


def test_near_chain_without_a_common_centre(spark):
    """A chain of texts, each similar only to the next: stars alone would lose links."""
    base = [f"t{k}" for k in range(60)]
    chain = [(100 - k, " ".join(base[k * 3 : k * 3 + 40])) for k in range(7)]
    random.Random(5).shuffle(chain)
    assert rows(near_dedup.label_near(spark.createDataFrame(chain, "doc_id long, text string")), *NEAR) == brute.near(chain)


def test_near_large_mixed_buckets(spark, monkeypatch):
    """Noisy copies of one text, many of them similar only to some others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 24)
    r = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    made = [(k, " ".join(f"x{r.randrange(10**6)}" if r.random() < 0.06 else w for w in base)) for k in range(150)]
    assert rows(near_dedup.label_near(spark.createDataFrame(made, "doc_id long, text string")), *NEAR) == brute.near(made)


def test_near_null_id_is_kept(spark):
    d = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert rows(near_dedup.label_near(d), "doc_id", "component_id", "kept") == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert near_dedup.drop_near(d, shingle=2).count() == 2


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(40)] + [(7, 7), (None, 3)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root}
    got = rows(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark, sf, docs, odd):
    cols = ("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")
    assert rows(queries.op2_line_dedup(spark, sf), *cols) == brute.lines(docs)
    assert rows(line_dedup.mark_lines(odd), *cols) == brute.lines(ODD)
    assert line_dedup.mark_lines(empty(odd)).count() == 0
    left = line_dedup.drop_lines(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)


def test_lines_that_repeat_themselves(spark):
    """A line written 1, 2 and 5 times, and lines of one character, against brute force."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
    said = [" ".join(word() for _ in range(n)) for n in (15, 30, 40) for _ in range(12)]
    made = [(10 * i + k, " ".join([s] * times)) for i, s in enumerate(said) for k, times in enumerate((1, 2, 5))]
    made += [(10000 + k, c * n) for k, (c, n) in enumerate((c, n) for c in "-=*#_x" for n in (80, 160, 200, 900))]
    d = spark.createDataFrame(made, "doc_id long, text string")
    cols = ("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")
    assert rows(line_dedup.mark_lines(d), *cols) == brute.lines(made)
    lines = d.withColumnsRenamed({"doc_id": "rep", "text": "line"})
    assert line_dedup.band_keys(lines, 8).select("rep").distinct().count() == len(made)


def test_short_similar_lines(spark):
    """Pairs of short lines of similarity from 0.8 to 0.9: every one shares a key."""
    r = random.Random(6)
    made, at = [], 0
    for n in (4, 5, 6, 9, 12, 16, 20, 23, 24):
        for _ in range(40):
            line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + 7))
            more = r.randrange(1, n // 4 + 1)
            made += [(at, line), (at + 1, line + "".join(r.choice("0123456789") for _ in range(more)))]
            at += 2
    d = spark.createDataFrame(made, "rep long, line string")
    keys = {}
    for k in line_dedup.band_keys(d, 8).collect():
        keys.setdefault(k["rep"], set()).add(k["bucket"])
    assert all(keys[k] & keys[k + 1] for k in range(0, at, 2))
    cols = ("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")
    assert rows(line_dedup.mark_lines(d, id_col="rep", text_col="line"), *cols) == brute.lines(made)


def test_line_keys_recall(spark):
    """Long lines against brute force: of pairs of similarity 0.8 to 0.85 nearly all share a key."""
    r = random.Random(8)
    made, at = [], 0
    for n in (28, 40, 70, 150, 400, 1500):
        for _ in range(60):
            line = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + 7)]
            other = line[:-max(1, n // 10)] + [r.choice("0123456789") for _ in range(max(1, n // 10))]
            made += [(at, "".join(line)), (at + 1, "".join(other))]
            at += 2
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for _, x in made]
    close = [k for k in range(0, at, 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    keys = {}
    for k in line_dedup.band_keys(spark.createDataFrame(made, "rep long, line string"), 8).collect():
        keys.setdefault(k["rep"], set()).add(k["bucket"])
    assert len(close) > 250
    assert sum(bool(keys[k] & keys[k + 1]) for k in close) >= 0.98 * len(close)


def test_line_families(spark, monkeypatch):
    """Noisy copies of a few lines, in blocks; white-space lines and names that clash with inner ones."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    base = [[word() for _ in range(40)] for _ in range(2)]
    made = [(k, "\n".join([" ".join(word() if r.random() < 0.02 else w for w in base[k % 2]), "\t", "", "\u00a0 "])) for k in range(120)]
    made += [(500, "-" * 40), (501, "-" * 4000), (502, "ab " * 15), (503, "ab " * 915), (504, "ha " * 20), (505, "ha " * 200)]
    d = spark.createDataFrame([(i, t, 1, {"a": 2}, 3) for i, t in made], "doc_id long, text string, gone int, _gone map<string,int>, rep int")
    cols = ("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")
    want = brute.lines(made)
    got = rows(line_dedup.mark_lines(d), *cols)
    assert len(got ^ want) <= 0.02 * len(want)  # bands are a matter of chance
    left = {x["doc_id"]: x["text"] for x in line_dedup.drop_lines(d).collect()}
    assert left[1].endswith("\t\n\n\u00a0 ") and left[501] == "" and left[505] == ""
    assert line_dedup.drop_lines(d).columns == d.columns


def test_lines_stay_in_the_jvm(spark, monkeypatch):
    """Families of lines, also beyond the basic plane, are linked without a Python worker."""
    def refuse(*_, **__):
        raise AssertionError("Python on the executors")
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", refuse)
    monkeypatch.setattr(type(spark.range(1).groupBy()), "applyInArrow", refuse)
    r = random.Random(7)
    base = [r.choice("abcdefgh \U0001f600\U0001f680é\r") for _ in range(160)]
    made = [(k, "".join(base[: 100 + 5 * (k % 8)] + [r.choice("xyz") for _ in range(k // 8)])) for k in range(40)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    cols = ("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")
    assert rows(line_dedup.mark_lines(d), *cols) == brute.lines(made)
    counts = {x["rep"]: x["n"] for x in line_dedup.band_keys(d.withColumnsRenamed({"doc_id": "rep", "text": "line"}), 8).collect()}
    assert counts == {k: len({x[i : i + 8] for i in range(len(x) - 7)}) for k, x in made}


def test_near_ids_that_repeat(spark):
    """Rows that repeat an id with other texts are compared by their own words; clashing names are carried."""
    words = [f"w{k}" for k in range(40)]
    a, b = " ".join(words), " ".join(words[::-1])
    made = [(5, a), (5, b), (5, a), (7, b + " end"), (9, a + " end"), (9, a + " end"), (11, "else " + b)]
    d = spark.createDataFrame([(i, t, 1, {"x": 1}) for i, t in made], "doc_id long, text string, gone int, _gone map<string,int>")
    got = sorted(tuple(r) for r in near_dedup.label_near(d).select("doc_id", "component_id", "kept").collect())
    assert got == [(5, 5, True)] * 3 + [(7, 5, False)] + [(9, 5, False)] * 2 + [(11, 5, False)]
    left = near_dedup.drop_near(d, shingle=2)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {5}


def test_odd_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 60, 64, 65, 5000, 40000)]
    sets += [np.unique(np.r_[x[: len(x) * 9 // 10], r.integers(0, 2**63, 5).astype(np.uint64)]) for x in sets]
    odd = near_dedup.OddSketches([near_dedup.odd_sketch(x) for x in sets])
    for i in range(len(sets)):
        least = odd.least_difference(i, np.arange(len(sets)))
        assert all(d <= len(np.setxor1d(sets[i], x)) for d, x in zip(least, sets, strict=True))


def test_substrings(spark, sf, docs, odd):
    assert rows(queries.op9_substring_dedup(spark, sf), *CUT) == brute.repeats(docs)
    assert rows(substring_dedup.mark_repeats(odd), *CUT) == brute.repeats(ODD)
    assert substring_dedup.mark_repeats(empty(odd)).count() == 0


def test_substrings_repetitive(spark):
    r = random.Random(3)
    made = [(k, " ".join(r.choice("ab") for _ in range(r.randrange(400)))) for k in range(8)] + [(9, "z " * 200), (10, "z " * 150)]
    made += [(20 + k, " ".join(["p q r s t u v"] * 4 + [str(k)] * 3 + ["p q r s t u v"] * 3)) for k in range(4)]
    assert rows(substring_dedup.mark_repeats(spark.createDataFrame(made, "doc_id long, text string")), *CUT) == brute.repeats(made)


def test_substring_cut_leaves_the_kept_words(spark, docs):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hits string")
    left = substring_dedup.cut_repeats(d)
    assert left.columns == d.columns
    digest = {(r["doc_id"], hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest()) for r in left.collect()}
    assert digest == {(i, h) for i, _, _, h in brute.repeats(docs)}


def test_substrings_of_ids_that_repeat(spark):
    """Rows that repeat an id with other texts keep their own words; equal rows share their fate."""
    one, two = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    short = " ".join(f"c{k}" for k in range(50))
    made = [(1, one), (5, one), (5, short), (5, short), (5, "x " + two[:150]), (6, two)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    n_two = len(two[:150].split())
    got = sorted(tuple(r)[:3] for r in substring_dedup.mark_repeats(d).collect())
    assert (1, 100, 0) in got and (5, 100, 100) in got and got.count((5, 50, 0)) == 2
    assert (6, 100, n_two) in got and (5, n_two + 1, 0) in got
    left = substring_dedup.cut_repeats(d.withColumn("names", F.lit(1)))
    assert left.columns == ["doc_id", "text", "names"] and left.filter("text = ''").count() == 1


def test_history_in_a_carried_index(spark):
    """A later batch loses what an index from earlier calls holds, whatever the ids."""
    text = " ".join(f"w{k}" for k in range(60))
    new = " ".join(f"n{k}" for k in range(40))
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, buckets=2)
    ask = lambda d: {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.mark_repeats(d, index=index).collect()}
    tables = spark.catalog.listTables
    before = len(tables())
    assert ask(frame((9, text))) == {9: (60, 0)}
    assert ask(frame((2, "x " + text), (3, text), (4, new))) == {2: (61, 60), 3: (60, 60), 4: (40, 0)}
    assert ask(frame((1, new + " y " + new), (2, "other"))) == {1: (81, 80), 2: (1, 0)}
    index.close()
    assert len(tables()) == before and ask(frame((1, text))) == {1: (60, 0)}
    index.close()


def test_index_in_batches_compacts(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, buckets=3)
    substring_dedup.find_repeats(d, batches=4, index=index)
    assert [level for level, _ in index.runs] == [2]
    run = index.runs[0][1]
    assert run.count() == run.select("fp").distinct().count()
