"""Main text of web pages by differencing pages of near URLs.

A page's lines are the texts of its blocks. Every page is paired with the page of its
host whose URL path (with the query) is nearest: the one with the longest common
beginning. The lines of both are aligned by a longest common subsequence, and shared
lines are deleted. Mark-up helps in two ways: lines in regions that mark themselves
as boilerplate (menus, headers, footers, adverts, forms, comments and the like) go
in any case, and lines in an ``article`` (else ``main``) element stay although a
neighbour repeats them, for they may quote one another.

Of paths in order, the nearest are next to each other. So a host's distinct pages are
sorted by a range shuffle, however many they are, and numbered; the order is cut into
blocks of ``BLOCK_PAGES``, each at first with ``REACH`` pages of its neighbours on both sides, so
that a page finds the same partner wherever the cuts fall. Copies of a page (with all
lines equal) are one page there, whose partner serves for all. A neighbour under the
same path, or that shares more than ``COPY_SHARE`` of the page's unmarked text, is a
copy too, and the search goes on past it. A page that would have to look farther than ``REACH`` pages on either side is put off,
and such pages are searched again with a reach ``WIDER`` times as large, until none is left. Only
hashes of lines are shuffled, and texts only of pages that lose lines.

Defined results: null html is empty and gives an empty text; a null or odd URL has
the empty host and no partner; a page with no partner but copies loses only marked
lines; very long pages are read whole; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.llm.common import materialize, small_batches

#: Pages of a block of the sorted order, and how many pages on each side are looked at.
BLOCK_PAGES, REACH = 2048, 32
#: How much farther pages look whose nearest pages are all copies.
WIDER = 16
#: Requests of up to so many rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A partner that shares more of a page's text than this is its copy, not its template.
COPY_SHARE = 0.8

# Elements and the names that mark regions.
RAW = frozenset("script style noscript template textarea iframe svg math object head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("nav footer aside form menu dialog select button fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner banners breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer gdpr "
    "header masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related "
    "replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass
class Line:
    text: str
    article: bool
    main: bool
    skipped: bool


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether attributes mark boilerplate, and whether they mark the main part."""
    boiler = main = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            boiler = True
        elif name == "style":
            boiler |= "display:none" in value.replace(" ", "")
        elif name == "role":
            main |= value in ("main", "article")
            boiler |= value in ROLES
        else:
            boiler |= not MARKS.isdisjoint(NAME.findall(value))
    return boiler, main


def lines_of(page: str) -> list[Line]:
    """The page's blocks of text in order, with where each stands."""
    out: list[Line] = []
    held: list[str] = []
    # Open elements: name, and the counts of articles, mains and skipped regions around their content.
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Line(text, *stack[-1][1:]))

    def close(name: str, within: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK:
            flush()
        if ending:
            close(name, frozenset())
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            close("p", frozenset(("button", "td", "th", "li", "div", "section", "article")))
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(name, frozenset(("ul", "ol", "dl", "table", "select", "tbody", "thead")))
        _, article, main, skipped = stack[-1]
        boiler, marks_main = _marked(attributes) if attributes.strip() else (False, False)
        if name in ("html", "body", "article", "main"):
            boiler = False
        stack.append((name, article or name == "article", main or name == "main" or marks_main, skipped or boiler or name in SKIP or name == "header" and not article))
    flush()
    return out


#: What a line is: in a region that marks itself as boilerplate, open to differencing, or part of the article.
MARKED, OPEN, ARTICLE = 0, 1, 2


def split_page(page: str) -> tuple[list[str], list[int]]:
    """The page's lines and what each is. Without an ``article`` element, ``main`` is the article."""
    lines = lines_of(page)
    has_article = any(x.article and not x.skipped for x in lines)
    kinds = [MARKED if x.skipped else ARTICLE if (x.article if has_article else x.main) else OPEN for x in lines]
    return [x.text for x in lines], kinds


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``; rows of the table are bit vectors."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def path_of(url: str | None) -> tuple[str, str]:
    """Host, and path with the query, of a URL; without fragment, last slash and extension."""
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not m:
        return "", ""
    return m[1].lower(), re.sub(r"\.\w{2,5}$", "", m[2].rstrip("/")) + (m[3] or "")


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class OutOfReach(Exception):
    """The next candidate lies beyond the pages at hand."""


def candidates(hosts: list[str], paths: list[str], at: int, reach: int = REACH, first: bool = True, last: bool = True):
    """Pages of the host with another path, nearest first: longest common beginning, then place in order, the earlier first.

    Pages farther than ``reach`` on either side are not looked at: where one may be next, :class:`OutOfReach`
    is raised. ``first`` and ``last`` tell whether the order begins and ends with the pages given.
    """
    low, high = max(0, at - reach), min(len(paths) - 1, at + reach)
    left, right = at - 1, at + 1
    while True:
        while left >= low and hosts[left] == hosts[at] and paths[left] == paths[at]:
            left -= 1
        while right <= high and hosts[right] == hosts[at] and paths[right] == paths[at]:
            right += 1
        more_left = left < low and (hosts[low - 1] == hosts[at] if low else not first)
        more_right = right > high and (hosts[high + 1] == hosts[at] if high + 1 < len(hosts) else not last)
        if more_left or more_right:
            raise OutOfReach
        has_left = left >= low and hosts[left] == hosts[at]
        has_right = right <= high and hosts[right] == hosts[at]
        if not has_left and not has_right:
            return
        if has_left and (not has_right or _prefix(paths[left], paths[at]) >= _prefix(paths[right], paths[at])):
            yield left
            left -= 1
        else:
            yield right
            right += 1


def shared_lines(own: list[int], sizes: list[int], kinds: list[int], others) -> list[int]:
    """Places of the lines shared with the first of ``others`` (lines' hashes) that is no copy of the page."""
    total = sum(n for n, kind in zip(sizes, kinds, strict=True) if kind != MARKED) or 1
    for theirs in others:
        shared = common_lines(own, theirs)
        if sum(sizes[k] for k in shared if kinds[k] != MARKED) <= COPY_SHARE * total:
            return shared
    return []


OUTLINE = "page_id long, url string, host string, path string, digest binary, hashes array<long>, sizes array<int>, kinds array<int>, lines array<string>"
ORDERED = "at long, part int, host string, path string, digest binary, hashes array<long>, sizes array<int>, kinds array<int>"
GONE = "host string, digest binary, gone array<int>, at long"


def outlines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Of every page: host and path, its lines' hashes, lengths and kinds, a digest of these, and the lines that are not marked."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                columns: tuple[list, ...] = ([], [], [], [], [], [], [])
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines, kinds = split_page(page)
                    hashes = [xxhash.xxh3_64_intdigest(x) >> 1 for x in lines]
                    digest = hashlib.blake2b(repr((kinds, lines)).encode(), digest_size=16).digest()
                    row = (*path_of(url), digest, hashes, [len(x) for x in lines], kinds, [x for x, kind in zip(lines, kinds, strict=True) if kind != MARKED])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                types = (pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    ["page_id", "url", "host", "path", "digest", "hashes", "sizes", "kinds", "lines"],
                )

    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, OUTLINE)


def in_order(distinct: DataFrame) -> DataFrame:
    """The pages sorted by host and path and numbered without gaps (``at``)."""
    sort = ["host", "path", "digest"]

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            here = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([here, pa.array([part] * batch.num_rows, pa.int32()), *batch.columns], ["at", "part", *batch.schema.names])

    numbered = materialize(distinct.select("host", "path", "digest", "hashes", "sizes", "kinds").orderBy(*sort).mapInArrow(number, ORDERED), "ordered")
    before, starts = 0, []  # a row for each partition of the sort
    for part, n in sorted(tuple(r) for r in numbered.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    starts = distinct.sparkSession.createDataFrame(starts, "part int, before long")
    return numbered.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def in_blocks(placed: DataFrame, reach: int) -> DataFrame:
    """Pages in blocks: ``block`` of each, and again in the blocks of others that it is in reach of."""
    block = lambda d: F.floor((F.col("at") + d) / BLOCK_PAGES)
    return placed.withColumn("block", F.explode(F.sequence(block(-reach), block(reach))))


def partner_losses(outlined: DataFrame) -> DataFrame:
    """``host, digest, gone`` of the distinct pages that lose lines to their partner: places among the unmarked lines."""
    known = outlined.filter("host <> ''")
    distinct = known.groupBy("host", "digest").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("hashes", "sizes", "kinds")])

    placed = in_order(distinct)
    total = placed.count()

    def difference(key, table, reach):
        table = table.sort_by([("at", "ascending")])
        wanted = table.column("wanted").to_pylist()
        hosts, paths, hashes, sizes, kinds, digests = (table.column(c).to_pylist() for c in ("host", "path", "hashes", "sizes", "kinds", "digest"))
        block, places = key[0].as_py(), table.column("at").to_pylist()
        first, last = places[0] == 0, places[-1] == total - 1
        out: tuple[list, ...] = ([], [], [], [])
        for k, at in enumerate(places):
            if at // BLOCK_PAGES != block or not wanted[k]:
                continue
            try:
                shared = set(shared_lines(hashes[k], sizes[k], kinds[k], (hashes[j] for j in candidates(hosts, paths, k, reach, first, last))))
            except OutOfReach:
                for column, value in zip(out, (hosts[k], digests[k], None, at), strict=True):
                    column.append(value)
                continue
            unmarked = [i for i, kind in enumerate(kinds[k]) if kind != MARKED]
            gone = [n for n, i in enumerate(unmarked) if i in shared and kinds[k][i] == OPEN]
            if gone:
                for column, value in zip(out, (hosts[k], digests[k], gone, at), strict=True):
                    column.append(value)
        return pa.table({"host": pa.array(out[0], pa.string()), "digest": pa.array(out[1], pa.binary()), "gone": pa.array(out[2], pa.list_(pa.int32())), "at": pa.array(out[3], pa.int64())})

    def searched(blocks: DataFrame, reach: int) -> DataFrame:
        return materialize(blocks.groupBy("block").applyInArrow(lambda key, table: difference(key, table, reach), GONE), "losses")

    reach = REACH
    found = searched(in_blocks(placed, reach).withColumn("wanted", F.lit(True)), reach)
    losses = found.filter("gone is not null")
    while not (late := found.filter("gone is null").select("at")).isEmpty():
        reach = min(reach * WIDER, total)
        blocks = late.select(F.floor(F.col("at") / BLOCK_PAGES).alias("block")).distinct()
        marked = placed.join(late.withColumn("wanted", F.lit(True)), "at", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        found = searched(in_blocks(marked, reach).join(blocks, "block", "left_semi"), reach)
        losses = losses.unionByName(found.filter("gone is not null"))
    return losses.drop("at")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; lines are joined by one newline."""
    outlined = materialize(outlines(pages, id_col, url_col, html_col), "outlines")
    losses = materialize(partner_losses(outlined), "losses")
    if losses.count() <= BROADCAST_ROWS:
        losses = F.broadcast(losses)
    rows = outlined.select("page_id", "url", "host", "digest", "lines").join(losses, ["host", "digest"], "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains(F.col("gone"), i)))
    text = rows.select("page_id", "url", F.array_join(left, "\n").alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
