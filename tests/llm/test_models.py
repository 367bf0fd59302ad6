"""Toxicity, nearest neighbours, page text, tokens, packing and totals."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelight.llm import ann, bpe, html_text, packing, queries, token_counts, toxicity

MULTI, GPT = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "<|endoftext|> a"), (5, "x" * 30000), (6, "日本語 😀 é" * 50), (7, "1234 don't  stop"), (7, "1234 don't  stop")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "en", 3, 4) for i, t in ODD], "doc_id long, text string, source string, lang string, ids int, sign int")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def library():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_bpe_equals_the_library(spark, sf, texts, odd):
    enc = library()

    def want(i, t):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert {tuple(r) for r in queries.op8_bpe(spark, sf).select(*cols).collect()} == {want(*x) for x in texts.items()}
    assert {tuple(r) for r in bpe.roundtrip_digests(odd, MULTI, P.PATTERN).select(*cols).collect()} == {want(*x) for x in ODD}
    coded = bpe.encode_documents(odd, MULTI, P.PATTERN)
    assert {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode_ids(coded, MULTI, P.PATTERN).collect()} == {(i, (t or "").encode()) for i, t in ODD}
    assert bpe.roundtrip_digests(odd.filter("false"), MULTI, P.PATTERN).count() == 0


def test_bpe_random_bytes():
    r, enc, own = random.Random(1), library(), bpe.BacktrackEncoder(bpe.read_ranks(MULTI))
    for _ in range(1500):
        piece = "".join(r.choice(["a", "th", "e", "ing", " ", "é", "日", "0", "\n", "!!", "ß", "tion"]) for _ in range(r.randrange(1, 40)))
        assert own.encode(piece.encode()) == enc._encode_single_piece(piece.encode())


def check_packing(rows, docs):
    tok = Tokenizer.from_file(GPT)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for i, pieces in by_doc.items():
        ids = np.array([*tok.encode(docs[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return sum(p["length"] for p in rows) / (2048 * len(by_seq))


def test_packing(spark, sf, texts, odd):
    assert check_packing(queries.op1_packing(spark, sf).collect(), texts) > 0.97
    check_packing(packing.pack_documents(odd.dropDuplicates(["doc_id"]), GPT, P.PATTERN, group_pieces=3).collect(), dict(ODD))
    assert packing.pack_documents(odd.filter("false"), GPT, P.PATTERN).count() == 0


def test_packing_spreads_copies(spark):
    """Copies of one row are dealt over all groups."""
    d = spark.createDataFrame([(7, "<|endoftext|>a b c<|endoftext|>") for _ in range(600)], "doc_id long, text string")
    rows = packing.pack_documents(d, GPT, P.PATTERN, group_pieces=100, capacity=64).collect()
    groups = np.bincount([r["sequence_id"] // packing.GROUP_STRIDE for r in rows])
    assert len(rows) == 600 and len(groups) == 6 and groups.max() < 150 and {r["doc_tokens"] for r in rows} == {6}


def test_packed_sequences_hold_the_ids(spark, odd):
    placed = packing.pack_documents(odd.dropDuplicates(["doc_id"]), GPT, P.PATTERN, with_ids=True).cache()
    made = packing.sequences(placed).collect()
    assert sum(r["n_ids"] for r in made) * 4 == sum(len(r["ids"]) for r in made) == 4 * placed.agg(F.sum("length")).first()[0]


def test_first_fit_is_first_fit():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 101, 400)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= sizes[i]


def test_toxicity_learns(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op5_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    hit = sum(r["toxic"] and r["predicted"] for r in held)
    assert hit / sum(r["predicted"] for r in held) > 0.95 and hit / sum(r["toxic"] for r in held) > 0.88


def test_toxicity_odd_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.label_toxic(odd, none).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, None), (None, 1), (5, 3)], "doc_id long, toxic int")
    assert toxicity.label_toxic(odd, one, threshold=0.3).count() == len(ODD)
    assert toxicity.drop_toxic(odd, none, threshold=0.6).columns == odd.columns
    assert toxicity.label_toxic(odd.filter("false"), none).count() == 0


def test_pairs_count_in_the_machine():
    """Two terms that are harmless alone are toxic together: only their product tells."""
    r = random.Random(4)
    both = [[a, b] for a in (0, 1) for b in (0, 1)] * 150
    x = [np.unique(np.array([10 if a else 20, 11 if b else 21, 30 + r.randrange(5)])) for a, b in both]
    m = toxicity.fit(x, np.array([float(a and b) for a, b in both]), epochs=30)
    assert m.probability(np.array([10, 11])) > 0.7 > 0.3 > max(m.probability(np.array([10, 21])), m.probability(np.array([11, 20])))


def test_neighbours_recall_and_odd_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, m = np.array([r["vec_id"] for r in v]), np.array([r["embedding"] for r in v], float)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    got = {}
    for r in queries.op7_ann(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hit += len(best & set(got[ids[q]].values()))
    assert hit >= 0.99 * 5 * len(got)
    odd = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [0.0, 3.0])]
    d = spark.createDataFrame([(i, x, 1.0) for i, x in odd] + [(2, [2.0, 0.0], 1.0)], "vec_id long, embedding array<float>, score double")
    rows = ann.search(d, lambda i: i == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in rows] == [(1, 1, 1.0), (2, 2, 1.0), (3, 8, 0.0)]
    assert ann.search(d.filter("false"), lambda i: i == 0).count() == 0


def test_neighbours_of_repeated_ids_huge_and_mixed_vectors(spark):
    """Repeated ids stand once, by their least vector; lengths don't mix; sizes don't overflow."""
    east, north = [1.0, 0.0], [0.0, 1.0]
    find = lambda rows, **kw: [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, **kw).orderBy("query_id", "rank").collect()]
    same = [(0, east)] + [(1, east)] * 7 + [(2, east), (3, east), (4, north)]
    assert find(same) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    turned = [(0, east)] + [(1, [1.0, 0.1 * k]) for k in range(7)] + [(2, [1.0, 0.05]), (3, [1.0, 2.0]), (4, north)]
    assert find(turned) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    huge = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e300, 1e299]), (3, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 2.0]), (100, [3.0]), (4, [])]
    assert find(huge) == [(0, 1, 2), (0, 2, 1), (50, 1, 3)]
    r = np.random.default_rng(5)
    v = r.standard_normal((700, 16))
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    assert find(rows, query_block=3) == find(rows)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = []
    for q in range(0, 700, 50):
        s = unit @ unit[q]
        s[q] = -9
        want += [(q, n + 1, int(c)) for n, c in enumerate(np.argsort(-s)[:5])]
    assert len(set(find(rows)) & set(want)) >= 0.95 * len(want)


def page(title, body):
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def test_page_text(spark):
    menu, foot = "<ul class='x'><li>Home</li><li>About us</li></ul>", "<div>All rights reserved</div>"
    pages = [
        (1, "http://h.example/a/1", page("", f"{menu}<p>First page tells of <b>bo</b>ats &amp; sea.</p>{foot}")),
        (2, "http://h.example/a/2", page("", f"{menu}<p>Second page tells of hills.</p>{foot}")),
        (3, "http://h.example/a/2?x=1", page("", f"{menu}<p>Second page tells of hills.</p>{foot}")),
        (4, "http://g.example/", page("", "<nav>n</nav><article><h1>T</h1><p>a\n b<p>c<div class='ad'>buy</div><section class='comments'>hi</section></article><footer>f</footer>")),
        (5, None, page("", "<div>alone</div><script>x</script><form>f</form>")),
        (6, "http://k.example/", None),
    ]
    d = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, lines string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(d).collect()}
    want = {1: "First page tells of boats & sea.", 2: "Second page tells of hills.", 3: "Second page tells of hills.", 4: "T\na b\nc", 5: "alone", 6: ""}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_text.extract(d.filter("false")).count() == 0


def test_page_articles(spark, sf):
    import html
    import re

    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", inside))
        want[r["page_id"]] = "\n".join(x for x in blocks if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op6_html(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def plain_texts(pages):
    """Brute force: every page against all pages of its host, nearest path first."""
    known = []
    for i, url, page in pages:
        host, path = html_text.path_of(url)
        known.append((i, host, path, *html_text.split_page(page or "")))
    digest = lambda lines, kinds: hashlib.blake2b(repr((list(kinds), list(lines))).encode(), digest_size=16).digest()
    order = {(h, min(p for _, g, p, l, k in known if (g, l, k) == (h, lines, kinds)), tuple(lines), tuple(kinds)) for _, h, _, lines, kinds in known}
    order = sorted(order, key=lambda x: (x[0], x[1], digest(x[2], x[3])))
    out = {}
    for i, host, _, lines, kinds in known:
        at = next(n for n, x in enumerate(order) if x[0] == host and x[2:] == (tuple(lines), tuple(kinds)))
        path = order[at][1]
        near = [n for n, x in enumerate(order) if host and x[0] == host and x[1] != path]
        common = lambda x: next((k for k, (a, b) in enumerate(zip(x, path)) if a != b), min(len(x), len(path)))  # noqa: B023, B905, E731
        near.sort(key=lambda n: (-common(order[n][1]), n > at, abs(n - at)))  # noqa: B023
        shared, total = [], sum(len(x) for x, k in zip(lines, kinds, strict=True) if k) or 1
        for n in near:
            both = html_text.common_lines(lines, list(order[n][2]))
            if sum(len(lines[k]) for k in both if kinds[k]) <= 0.8 * total:
                shared = both
                break
        out[i] = "\n".join(x for k, x in enumerate(lines) if kinds[k] == 2 or kinds[k] == 1 and k not in shared)
    return out


def test_pages_of_a_large_host(spark, monkeypatch):
    """2,000 pages of a host, no article: what pairs of near URLs share goes, wherever blocks are cut."""
    body = lambda k, side: f"<div>Site line</div><div>Section {k} line</div><p>Own words of page {k} {side}, told at some length here.</p>"
    pages = [(2 * k + s, f"http://big.example/a{k:04}/{'xy'[s]}", page("", body(k, "xy"[s]))) for k in range(1000) for s in (0, 1)]
    monkeypatch.setattr(html_text, "BLOCK_PAGES", 300)
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(d.repartition(7)).collect()}
    assert got == {2 * k + s: f"Own words of page {k} {'xy'[s]}, told at some length here." for k in range(1000) for s in (0, 1)}


def test_pages_without_article_equal_brute_force(spark, monkeypatch):
    r = random.Random(7)
    line = lambda n: " ".join(r.choice(("sea", "hill", "boat", "rain", "road", "town")) for _ in range(n))
    menus = [[f"<div>{line(3)} {k}</div>" for k in range(6)] for _ in range(3)]
    pages = []
    for k in range(160):
        menu = menus[k % 3]
        own = "".join(f"<p>{line(9)} {k}.{j}</p>" for j in range(r.randrange(1, 6)))
        if k % 5 == 0:
            own = f"<main><p>{line(4)}</p>{menu[0]}{own}</main>"
        url = f"http://{'ab'[k % 2]}.example/{r.choice('pqr')}/{r.choice('xyz')}{k % 40}" + r.choice(("", "", f"?id={k}"))
        pages.append((k, url, page("", menu[1] + menu[2] + own + menu[r.randrange(6)] + "<footer>f</footer>")))
    pages += [(1000 + k, f"http://a.example/p/x1?copy={k}", pages[4][2]) for k in range(50)] + [(2000, None, pages[3][2]), (2001, "http://a.example/p", None)]
    monkeypatch.setattr(html_text, "BLOCK_PAGES", 40)
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(d).collect()} == plain_texts(pages)


def test_longest_common_lines():
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(at) == best[-1][-1] and all(any(a[k] == y for y in rest) for k in at)


def test_token_query(spark, sf):
    """Estimates, a revision, deletes, inserts and repeated batches leave the plain totals of all documents."""
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for v in ("byte_bpe_50k", "byte_bpe_multi_50k"):
            enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(f"{v}.tiktoken")), special_tokens={})
            n, tokens = want.get((r["source"], r["lang"], v), (0, 0))
            want[r["source"], r["lang"], v] = n + 1, tokens + len(enc.encode_ordinary(r["text"] or ""))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in queries.op4_token_counts(spark, sf).collect()}
    assert got == want


def test_token_batches_are_applied_once(spark, odd, tmp_path):
    """A batch that another driver commits in the meantime is not applied again; names may hold any character."""
    counts = token_counts.signed(token_counts.count_tokens(odd, {"v": (MULTI, P.PATTERN)}), 1)
    store = token_counts.TokenTotals(spark, f"file://{tmp_path}/t")
    late = token_counts.TokenTotals(spark, f"file://{tmp_path}/t")
    late._committed = lambda: {}
    assert store.commit("day=1/a b%", counts) and not late.commit("day=1/a b%", counts)
    assert store.commit("day=1/a", counts)
    assert [r["n_docs"] for r in store.totals().collect()] == [2 * len(ODD)]
    store.compact("f/1")
    assert not store.commit("day=1/a b%", counts) and [r["n_docs"] for r in store.totals().collect()] == [2 * len(ODD)]


def test_token_totals(spark, odd, tmp_path):
    kinds = {"v": (MULTI, P.PATTERN)}
    counts = token_counts.count_tokens(odd, kinds).cache()
    enc = library()
    total = sum(len(enc.encode_ordinary(t or "")) for _, t in ODD)
    store = token_counts.TokenTotals(spark, f"file://{tmp_path}/t")
    assert store.totals().count() == 0
    now = lambda: [tuple(r) for r in store.totals().collect()]
    assert store.commit("a", token_counts.signed(counts, 1)) and now() == [("s", "en", "v", len(ODD), total)]
    assert not store.commit("a", token_counts.signed(counts, 1)) and now() == [("s", "en", "v", len(ODD), total)]
    store.compact("one")
    new = counts.filter("doc_id = 5").withColumn("n_tokens", F.col("n_tokens") + 10)
    assert store.commit("b", token_counts.revised(counts.filter("doc_id = 5"), new)) and now() == [("s", "en", "v", len(ODD), total + 10)]
    assert not store.commit("a", token_counts.signed(counts, 1))
    store.compact("two")
    assert now() == [("s", "en", "v", len(ODD), total + 10)]
    assert store.commit("c", token_counts.signed(counts.filter("false"), 1))
    store.commit("d", token_counts.signed(counts, -1))
    assert now() == [("s", "en", "v", 0, 10)]
