"""Fuzzy deduplication of lines by MinHash.

A line's set is its distinct character shingles, hashed to 64 bits. Equal lines are
one class. The hashes' range is cut into ``BANDS`` bands; the least ``ROWS`` hashes of
a band (all, if fewer) name a bucket, in which a pair of similarity 0.8 meets with
probability 1 - 2e-4. What a line repeats changes nothing.

Sets of up to ``SMALL`` shingles have keys that miss no pair of similarity 0.8: sets
of sizes n and m that are so similar differ in at most (n + m) / 9 shingles, so of one
zone more at least one is equal in both. A zone that is empty in both tells nothing;
sets with one also have their least hashes as keys (the prefix in which any two such
sets meet).

A bucket's members are linked to its smallest alone; candidates are confirmed by the
full sets of strings (their sizes are counts of distinct 64-bit hashes). Members that
are then outside of their bucket's largest component are compared with a few of its
members, and in the end with all others, in blocks, and only such pairs as sizes and
odd sketches don't prove too different. One line of each component stays.

All are DataFrame operations without Python on the executors (figures in the README).

Defined results: a null text has no lines; lines that are empty or all white space
(of any kind) are not compared and all stay; a line shorter than a shingle is one
shingle; very long lines are compared whole; of a component the first line stays, by
(document, line number); a null id sorts first; rows that repeat an id are the same
document, and their equal places stay or go together; an empty table gives no rows;
other columns are ignored by :func:`mark_lines` and carried by :func:`drop_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight.llm.common import materialize, release_shuffles
from tidelight.llm.components import connected_components
from tidelight.llm.near_dedup import BROADCAST_ROWS, SOME, in_blocks, shared_buckets, similar_sizes

BANDS, ROWS = 12, 3
#: A pair whose smaller set has up to so many shingles is found by keys that miss none.
SMALL = 24
#: Members of a mixed bucket's largest component that the others are compared with before all that are left.
CENTRES = 3
#: Words of 64 bits of an odd sketch.
WORDS = 16
#: Where bands after the first begin, in the order of hashes.
MARKS = [(b << 64) // BANDS - (1 << 63) for b in range(1, BANDS)]


def shingles(line: str, size: int) -> str:
    """SQL for a line's shingles, by code points and with repetitions; a line shorter than ``size`` is one."""
    return f"if(length({line}) <= {size}, array({line}), regexp_extract_all({line}, '(?s)(?=(.{{{size}}})).', 1))"


def shingle_hashes(line: str, size: int) -> str:
    return f"transform({shingles(line, size)}, x -> xxhash64(x))"


def sure_keys(s: str, n: str) -> str:
    """SQL for keys of a sorted set with which any set of similarity 0.8 shares one, where the smaller has up to ``SMALL`` shingles."""
    least = f"((4 * {n} + 4) div 5)"
    most = f"if({n} > {SMALL}, {SMALL}, 5 * {n} div 4)"
    zones = f"sequence(({n} + {least}) div 9 + 1, ({n} + {most}) div 9 + 1)"
    part = f"filter({s}, x -> shiftright(shiftrightunsigned(x, 40) * z, 24) = j)"
    parts = f"flatten(transform({zones}, z -> transform(sequence(0L, z - 1), j -> struct(z, j, {part} AS part))))"
    named = "transform(filter(p, e -> size(e.part) > 0), e -> xxhash64(e.z, e.j, e.part))"
    prefix = f"transform(slice({s}, 1, cast({n} - {least} + 1 AS int)), x -> xxhash64('least', x))"
    return f"element_at(transform(array({parts}), p -> if(exists(p, e -> size(e.part) = 0), concat({named}, {prefix}), {named})), 1)"


def band_keys(lines: DataFrame, size: int) -> DataFrame:
    """``bucket, rep, n`` from ``rep, line``; ``n`` is the number of distinct shingles."""
    marks = F.array(*map(F.lit, MARKS))
    # Lambdas stand in projections: a generator that holds one is interpreted. Outer ones infer no filter that would evaluate their input twice.
    held = F.sort_array(F.array_distinct(F.concat(marks, F.expr(shingle_hashes("line", size)))))
    sets = lines.select("rep", held.alias("s"))
    at = F.array(F.lit(0), *[F.array_position("s", m).cast("int") for m in MARKS], F.size("s") + 1)
    placed = sets.select("rep", "s", (F.size("s") - len(MARKS)).cast("long").alias("n"), F.explode(F.array(at)).alias("at"))

    def band(b: int) -> str:
        first, end = f"at[{b}]", f"at[{b + 1}] - 1"
        least = ", ".join(f"if({first} + {k} < {end}, s[{first} + {k}], null)" for k in range(ROWS))
        return f"if({first} < {end}, xxhash64({b}, {least}), null)"

    bare = f"array_except(s, array({', '.join(f'{m}L' for m in MARKS)}))"
    sure = F.expr(f"CASE WHEN (4 * n + 4) div 5 <= {SMALL} THEN element_at(transform(array({bare}), t -> {sure_keys('t', 'n')}), 1) ELSE cast(array() AS array<bigint>) END")
    bands = F.expr(f"if(n > {SMALL}, array({', '.join(map(band, range(BANDS)))}), cast(array() AS array<bigint>))")
    keys = placed.select("rep", "s", "n", "at", sure.alias("sure"))
    return keys.select(F.explode_outer(F.concat(bands, "sure")).alias("bucket"), "rep", "n").filter("bucket is not null")


def few_lines(lines: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``lines`` whose ``rep`` is in ``reps``."""
    reps = materialize(reps.distinct(), "reps")
    return lines.select("rep", "line").join(F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps, "rep", "left_semi")


def confirmed(pairs: DataFrame, lines: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``a, b, both_n`` whose full shingle sets are similar; ``both_n`` is the sum of the sets' sizes."""
    asked = materialize(few_lines(lines, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))), "asked")
    x, y = (asked.select(F.col("rep").alias(c), F.col("line").alias(f"{c}_line")) for c in "ab")
    common = f"size(array_intersect({shingles('a_line', size)}, {shingles('b_line', size)}))"
    return pairs.join(y, "b").join(x, "a").filter(F.expr(f"{100 + percent} * {common} >= {percent} * both_n")).select("a", "b")


def odd_sketches(lines: DataFrame, size: int) -> DataFrame:
    """``rep, k0, k1, ...`` of ``rep, line``: parities of how many shingles fall on each bit. Where two sketches differ, the sets differ."""
    hashed = lines.select("rep", F.expr(f"array_distinct({shingle_hashes('line', size)})").alias("s")).select("rep", F.explode_outer("s").alias("h"))
    bits = hashed.select("rep", F.expr(f"cast(shiftright(h, 6) & {WORDS - 1} AS int)").alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
    words = bits.groupBy("rep", "w").agg(F.bit_xor("bit").alias("bit"))
    return words.groupBy("rep").agg(*[F.bit_xor(F.when(F.col("w") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"k{k}") for k in range(WORDS)])


def maybe_similar(percent: int) -> Column:
    """Whether sizes and sketches of ``x`` and ``y`` leave a similarity of ``percent`` possible."""
    least = " + ".join(f"bit_count(x.k{k} ^ y.k{k})" for k in range(WORDS))
    return similar_sizes("x.n", "y.n", percent) & F.expr(f"{100 + percent} * ({least}) <= {100 - percent} * (x.n + y.n)")


def as_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both_n")).distinct()


def star_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members outside of a bucket's largest component with ``CENTRES`` members of it."""
    picked = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)]
    inner = rest.filter("component = main")
    centres = inner.groupBy("bucket").agg(*picked).select("bucket", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("rep"))
    x, y = rest.filter("component <> main").alias("x"), inner.join(centres, ["bucket", "rep"], "left_semi").alias("y")
    return as_pairs(x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & maybe_similar(percent)))


def all_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in a bucket that may be similar, by pairs of blocks."""
    dealt = in_blocks(rest)
    x, y = dealt.filter("component <> main").alias("x"), dealt.alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = F.expr("x.component <> y.component AND (y.component = y.main OR x.rep < y.rep) AND (x.lo = x.hi OR x.block <> y.block)")
    return as_pairs(x.join(y, same & once & maybe_similar(percent)))


def link_lines(lines: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` of the ``rep`` of ``lines`` that are linked.

    The stars leave nothing to compare in buckets of two. In larger ones, the members of a bucket outside of its largest component are
    compared with a few members of that, and in the end with all, and each other.
    """
    sample = lines.filter(F.pmod(F.xxhash64("rep"), F.lit(SOME)) == 0)
    shared = shared_buckets(band_keys(lines, size), band_keys(sample, size))
    release_shuffles(lines.sparkSession)
    star = shared.filter("rep <> a").filter(similar_sizes("n", "a_n", percent))
    tried = materialize(star.select("a", F.col("rep").alias("b"), (F.col("n") + F.col("a_n")).alias("both_n")).distinct(), "stars")
    links = materialize(confirmed(tried, lines, size, percent), "confirmed")
    nodes = connected_components(links)
    sketches = None
    for pairs in (star_pairs, all_pairs):
        labelled = shared.join(nodes, shared["rep"] == nodes["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
        counted = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"))
        mixed = counted.groupBy("bucket").agg(F.max_by("component", "members").alias("main"), F.sum("members").alias("size"), F.count(F.lit(1)).alias("parts"))
        rest = materialize(labelled.join(mixed.filter("parts > 1 AND size > 2").drop("parts"), "bucket"), "mixed")
        if rest.isEmpty():
            break
        if sketches is None:
            sketches = materialize(odd_sketches(few_lines(lines, rest.select("rep")), size), "sketches")
        cross = materialize(pairs(rest.join(sketches, "rep"), percent).join(tried, ["a", "b"], "left_anti"), "cross")
        if cross.isEmpty():
            continue
        more = materialize(confirmed(cross, lines, size, percent), "confirmed")
        tried = tried.unionByName(cross)
        if not more.isEmpty():
            links = links.unionByName(more)
            nodes = connected_components(links)
    return nodes


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line`` of every line, from 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode_outer(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line_no", "line"))


def mark_lines(docs: DataFrame, size: int = 8, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, keep_doc_id, keep_line_no, kept`` of every line that is not blank."""
    lines = lines_of(docs, id_col, text_col).filter(F.col("line").rlike(r"(?U)\S"))
    # A place as one number, ordered like (document, line number), the null id first: what an aggregate can keep in place.
    place = F.expr("coalesce(cast(doc_id as decimal(20,0)), -9223372036854775809BD) * 4294967296BD + line_no")
    classes = lines.select("line", place.alias("place")).groupBy("line").agg(F.min("place").alias("first"))
    distinct_lines = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "first", "line"), "lines")
    release_shuffles(docs.sparkSession)
    nodes = link_lines(distinct_lines, size, percent)
    release_shuffles(docs.sparkSession)
    linked = nodes.join(distinct_lines.select(F.col("rep").alias("node"), "first"), "node")
    winners = linked.join(linked.groupBy("component").agg(F.min("first").alias("keep")), "component").select(F.col("node").alias("rep"), "keep")
    digest = F.unhex(F.sha2("line", 256)).alias("digest")
    kept = materialize(distinct_lines.select("rep", digest, "first").join(winners, "rep", "left").select("digest", F.coalesce("keep", "first").alias("keep")), "kept")
    line_no = F.expr("cast(pmod(keep, 4294967296BD) as int)")
    doc = F.expr("(keep - pmod(keep, 4294967296BD)) / 4294967296BD").cast("decimal(20,0)")
    marked = lines.select("doc_id", "line_no", digest).join(kept, "digest")
    marked = marked.select("doc_id", "line_no", F.when(doc >= F.lit(-(2**63)), doc).cast("long").alias("keep_doc_id"), line_no.alias("keep_line_no"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no"))
    return marked.select("doc_id", "line_no", "keep_doc_id", "keep_line_no", stays.alias("kept"))


def drop_lines(docs: DataFrame, size: int = 8, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that don't stay taken out of the text; other columns are unchanged."""
    gone = mark_lines(docs, size, percent, id_col, text_col).filter("not kept").groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("doc")), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNotNull(), F.array_join(left, "\n"))
    value = lambda i, c: F.coalesce(text, F.col(f"row.c{i}")) if c == text_col else F.col(f"row.c{i}")
    return joined.select(*[value(i, c).alias(c) for i, c in enumerate(docs.columns)])
