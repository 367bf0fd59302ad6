"""MinHash near-deduplication of documents by word shingles.

Signatures come from one-permutation hashing: one hash of each shingle, the
least in each of ``bands * band_rows`` bins, and empty bins filled by optimal
densification (each probes other bins in an order of its own, so that borrowed
values stay independent). Bands of the signature name buckets.

Documents with equal words are one class (by a 256-bit digest of them); only its
smallest id goes on, so copies never multiply. In a bucket all members are linked to its smallest
class alone, a star, so that candidates grow with the bucket and not with its
square. Candidates are confirmed on the full sets of words. Buckets that then
still hold several components get their remaining pairs across components, so no
link between different texts is lost. Confirmed links are joined to components.

Defined results: a null text counts as empty; empty texts have no shingles and
are linked with nothing; a text of fewer words than a shingle is one shingle; a
null id takes no part, its row is returned with a null component and kept; rows
that repeat an id and text are one document and each labelled; rows that repeat an
id with other texts are documents of their own, compared by their own words, and
:func:`drop_near` keeps all rows of an id if any of them stays; very long texts are
compared whole, their sketches end at 65,536 bits; an empty table gives no rows;
other columns are ignored by :func:`label_near` and carried by :func:`drop_near`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.llm.common import materialize, one_text_an_id, release_shuffles, text_or_empty
from tidelight.llm.components import connected_components
from tidelight.llm.words import HASHES, U, mix, ngrams

FEATURES = "doc_id long, n_shingles long, words_digest binary, bands array<long>"
#: Requests for texts up to so many rows are broadcast (16 bytes each); beyond, the texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Members of a bucket whose remaining pairs may become rows: at most so many for each.
SMALL_BUCKET = 16
#: Members of a larger bucket that are compared in one group.
BLOCK = 2048
#: Likeliest pairs of a member with each other component that are compared, round by round; in the end all.
ROUNDS = (1, None)
#: One set in so many tells which buckets are large.
SOME = 64
#: Members of a star that share a copy of their centre's text.
STAR_ROWS = 512


@functools.lru_cache(maxsize=4)
def probes(bins: int, tries: int = 256) -> np.ndarray:
    """For each bin the bins it borrows from, in order."""
    at = np.arange(bins, dtype=U)[None, :] + (np.arange(1, tries + 1, dtype=U) << U(32))[:, None]
    return (mix(mix(at)) % U(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of distinct shingle hashes (not empty), with optimal densification."""
    h = np.sort(mix(shingles ^ U(0xA0761D6478BD642F)))
    bin_of = (((h >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    full, least = bin_of[first], h[first]
    out = np.zeros(bins, U)
    out[full] = least
    has = np.zeros(bins, bool)
    has[full] = True
    left = np.flatnonzero(~has)
    if len(full) == 1:
        out[left] = least[0]
        return out
    for probe in probes(bins):
        if not len(left):
            break
        source = probe[left]
        ok = has[source]
        out[left[ok]] = out[source[ok]]
        left = left[~ok]
    if len(left):  # very few full bins: the next full one
        out[left] = least[np.searchsorted(full, left) % len(full)]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=U)
    for k in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def shingle_set(text: bytes, size: int) -> set:
    """Distinct word shingles of a lower-cased text, in full."""
    w = text.lower().split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(size)), strict=False))


def features(docs: DataFrame, shingle: int = 2, bands: int = 42, band_rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shingle count, digest of the words in order, and band keys of every whole text."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                counts, digests, keys = [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    words = text.lower().split()
                    s = shingle_hashes(HASHES.of(words), shingle)
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(b" ".join(words), digest_size=32).digest() if words else None)
                    keys.append(band_keys(signature(s, bands * band_rows), bands, band_rows) if len(s) else None)
                flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
                offsets = np.r_[0, np.cumsum([0 if k is None else bands for k in keys])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["doc_id", "n_shingles", "words_digest", "bands"],
                )

    return text_or_empty(docs, id_col, text_col).mapInArrow(run, FEATURES)


def similar_sizes(a: str, b: str, percent: int):
    """What sets must meet for a similarity of ``percent``: their sizes alone can rule a pair out."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirm(pairs: DataFrame, docs: DataFrame, full_set: Callable[[bytes], set], percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar; ``docs`` is ``doc_id, text``,
    ``full_set`` gives the set of a text.

    A centre ``a`` of many pairs is copied for every ``STAR_ROWS`` of its pairs,
    and each copy's pairs stream past it.
    """
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("copies"))
    member = pairs.join(stars, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    centre = stars.select(F.col("a").alias("doc_id"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    wanted = materialize(centre.unionByName(member), "requests")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    asked = docs.join(wanted, "doc_id").select("centre", "copy", (F.col("doc_id") != F.col("centre")).cast("int").alias("role"), "doc_id", "text")

    def run(batches):
        at, held = None, set()
        for batch in batches:
            found = []
            centres, copies, roles, ids = (batch.column(k).to_pylist() for k in (0, 1, 2, 3))
            texts = batch.column(4).cast(pa.binary())
            for k, c in enumerate(centres):
                own = full_set(texts[k].as_py())
                if not roles[k]:
                    at, held = (c, copies[k]), own
                elif at == (c, copies[k]):
                    both = len(own & held)
                    if both and 100 * both >= percent * (len(own) + len(held) - both):
                        found.append((c, ids[k]))
            a, b = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = asked.repartition("centre", "copy").sortWithinPartitions("centre", "copy", "role", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def shared_buckets(members: DataFrame, some: DataFrame) -> DataFrame:
    """``bucket, rep, n, a, a_n`` of the members of buckets of two or more, ``a`` their smallest and ``a_n`` its size; one shuffle of ``members`` (``bucket, rep, n``).

    ``some`` are the members of one set in ``SOME``. Buckets that it shows to be large
    for a partition are dealt by salts too, and their salts' smallest combined; how
    many such there are is bounded by the number of partitions. What is found doesn't
    depend on the sample.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sampled = materialize(some.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "sample")
    total = sampled.agg(F.sum("size")).first()[0] or 0
    hot = sampled.filter(F.col("size") > max(4, total / (4 * parts))).select("bucket", F.lit(parts).alias("salts"))
    hot = F.broadcast(hot)  # 4 * parts rows at most
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("salts"))).cast("int")
    dealt = members.join(hot, "bucket", "left").select("bucket", "rep", "n", salt.alias("salt")).repartition("bucket", "salt")
    # All columns are used here, so that the shuffle is the same as the join's below and is done once.
    groups = dealt.groupBy("bucket", "salt").agg(F.min("rep").alias("a"), F.min_by("n", "rep").alias("a_n"), F.max("rep").alias("z"))
    whole = groups.join(hot, "bucket").groupBy("bucket").agg(F.min("a").alias("least"), F.min_by("a_n", "a").alias("least_n"), F.max("z").alias("most"))
    centres = groups.join(F.broadcast(whole), "bucket", "left")  # rows for hot buckets alone
    centres = centres.select("bucket", "salt", F.coalesce("least", "a").alias("a"), F.coalesce("least_n", "a_n").alias("a_n"), F.coalesce("most", "z").alias("z")).filter("a < z").drop("z")
    return materialize(dealt.join(centres, ["bucket", "salt"]).select("bucket", "rep", "n", "a", "a_n"), "buckets")


def link_members(
    members: DataFrame, some: DataFrame, percent: int, confirmed: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``node, component`` of the members that are linked; ``members``: ``bucket, rep`` (an id of a distinct set) and ``n`` (its size); ``some``: see :func:`shared_buckets`.

    ``confirmed`` gives those of candidate pairs ``a, b`` that are similar. ``across``
    gets the buckets that hold several components after the stars (``bucket, rep, n,
    component`` and ``size``, the bucket's members) and a number ``k``, and gives for each
    member the ``k`` likeliest pairs with every other component, or for None all that
    may be similar, none left out. Most members join a component by their likeliest
    pair, so the rounds of ``ROUNDS`` keep pairs from growing with a family's square;
    the last one takes all pairs that are left, so no link is lost.
    """
    shared = shared_buckets(members, some)
    release_shuffles(members.sparkSession)
    star = shared.filter("rep <> a").filter(similar_sizes("n", "a_n", percent)).select("a", F.col("rep").alias("b")).distinct()
    tried = materialize(star, "stars")
    links = materialize(confirmed(tried), "confirmed")
    nodes = connected_components(links)
    for k in ROUNDS:
        labelled = shared.join(nodes, shared["rep"] == nodes["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
        rest = materialize(labelled.join(mixed.select("bucket", "size"), "bucket"), "mixed")
        if rest.isEmpty():
            break
        cross = materialize(across(rest, k).distinct().join(tried, ["a", "b"], "left_anti"), "cross")
        if cross.isEmpty():
            continue
        more = materialize(confirmed(cross), "confirmed")
        tried = tried.unionByName(cross)
        if not more.isEmpty():
            links = links.unionByName(more)
            nodes = connected_components(links)
    return nodes


def in_blocks(rest: DataFrame) -> DataFrame:
    """Members of buckets dealt to pairs of blocks: adds ``block`` and the pair ``lo, hi``, and drops ``size``.

    Any two members of a bucket meet in one pair of blocks: that of their own
    blocks. A pair of blocks holds about twice ``BLOCK`` members at most.
    """
    dealt = rest.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other", "size")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text from its words' hashes."""
    return np.unique(ngrams(words, min(size, len(words)))) if len(words) else words


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit; about four bits a shingle, a power of two.

    Where two sketches differ, the sets differ: the count of such bits is no more
    than the size of the symmetric difference. Halves combined by exclusive or are
    the sketch of half as many bits.
    """
    bits = 1 << min(16, max(8, (4 * len(shingles)).bit_length()))
    h = mix(shingles ^ U(0x8EBC6AF09C88C6E3))
    return np.packbits(np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


class OddSketches:
    """Sketches of several sizes, compared in the smaller size of each pair."""

    def __init__(self, sketches: list[bytes]):
        self.size = np.array([len(x) for x in sketches])
        self.at, self.rows = {}, {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            table = np.empty((len(own), size // 8), U)
            for r, k in enumerate(own.tolist()):
                x = np.frombuffer(sketches[k], U)
                table[r] = x if len(sketches[k]) == size else x[: len(x) // 2] ^ x[len(x) // 2 :]
            self.at[size] = np.full(len(sketches), -1)
            self.at[size][own] = np.arange(len(own))
            self.rows[size] = table

    def least_difference(self, i: int, j: np.ndarray) -> np.ndarray:
        """A lower bound of how many shingles are in one of the sets ``i`` and ``j`` alone."""
        out = np.zeros(len(j), np.int64)
        common = np.minimum(self.size[j], self.size[i])
        for size in np.unique(common).tolist():
            at = self.at[size]
            on = np.flatnonzero((common == size) & (at[j] >= 0))
            if at[i] >= 0 and len(on):
                out[on] = np.bitwise_count(self.rows[size][at[j[on]]] ^ self.rows[size][at[i]]).sum(1)
        return out


def pairs_across(rest: DataFrame, docs: DataFrame, hashes: Callable[[bytes], np.ndarray], percent: int, k: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of different components in mixed buckets that may be similar.

    In buckets of up to ``SMALL_BUCKET`` members they are rows of a join. A larger
    bucket is cut into blocks of ``BLOCK`` members and each pair of blocks is one
    task's group, so memory is bounded. There a pair becomes a row unless sizes or
    odd sketches prove it too different, of a member's pairs with a component the ``k``
    of least difference (in each block). ``docs`` is ``doc_id, text``; ``hashes`` gives a
    text's distinct shingle hashes.
    """
    few = rest.filter(F.col("size") <= SMALL_BUCKET)
    x, y = few.alias("x"), few.alias("y")
    rows = (
        x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & similar_sizes("x.n", "y.n", percent))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    many = rest.filter(F.col("size") > SMALL_BUCKET)
    if many.isEmpty():
        return rows
    reps = materialize(many.select("rep").distinct(), "reps")
    reps = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps

    def sketches(batches):
        for batch in batches:
            found = [odd_sketch(hashes(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rep", "sketch"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi").select("rep", "text")
    held = texts.mapInArrow(sketches, "rep long, sketch binary").dropDuplicates(["rep"])
    held = materialize(held, "sketches")
    dealt = in_blocks(many)

    def compare(table):
        rep, component, block, size = (table.column(c).to_numpy() for c in ("rep", "component", "block", "n"))
        apart = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        odd = OddSketches(table.column("sketch").to_pylist())
        names, where, count = np.unique(component, return_inverse=True, return_counts=True)
        passive = where == count.argmax()  # of the largest component: compared only with the rest
        order = np.arange(len(rep))
        found: list[np.ndarray] = []
        for i in np.flatnonzero(~passive).tolist():
            near = (component != component[i]) & (passive | (order > i))
            near &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            if apart:
                near &= block != block[i]
            j = np.flatnonzero(near)
            if len(j):
                least = odd.least_difference(i, j)
                ok = (100 + percent) * least <= (100 - percent) * (size[j] + size[i])
                j, least = j[ok], least[ok]
                if k is not None and len(j):
                    j = j[np.lexsort((rep[j], least, component[j]))]
                    first = np.flatnonzero(np.r_[True, component[j][1:] != component[j][:-1]])
                    j = j[np.arange(len(j)) - np.repeat(first, np.diff(np.r_[first, len(j)])) < k]
                found.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.unionByName(dealt.join(held, "rep").groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long"))


def label_near(
    docs: DataFrame, shingle: int = 2, percent: int = 80, bands: int = 42, band_rows: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    shingle sets. With 42 bands of 6 a pair of similarity 0.8 shares a bucket
    with probability 1 - 3e-6, any of more with more.
    """
    texts, names = one_text_an_id(text_or_empty(docs, id_col, text_col))
    feats = materialize(features(texts, shingle, bands, band_rows), "features")
    sets = feats.filter("doc_id is not null and n_shingles > 0")
    classes = sets.groupBy("words_digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    classes = materialize(classes.select("words_digest", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")), "classes")
    members = lambda of: of.select(F.explode("bands").alias("bucket"), "rep", "n")
    nodes = link_members(
        members(classes),
        members(classes.filter(F.pmod(F.xxhash64("rep"), F.lit(SOME)) == 0)),
        percent,
        lambda pairs: confirm(pairs, texts, lambda t: shingle_set(t, shingle), percent),
        lambda rest, k: pairs_across(rest, texts, lambda t: shingle_hashes(HASHES.of(t.lower().split()), shingle), percent, k),
    )

    named = classes.select("words_digest", "rep").join(nodes, F.col("rep") == F.col("node"), "left").select("words_digest", F.coalesce("component", "rep").alias("component_id"))
    plain = feats.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "words_digest").join(named, "words_digest").select("doc_id", "n_shingles", "component_id").unionByName(plain)
    if names is not None:
        for c in ("doc_id", "component_id"):
            out = out.join(names.select(F.col("key").alias(c), F.col("named").alias("_" + c)), c, "left").drop(c).withColumnRenamed("_" + c, c)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    labels = label_near(docs, shingle, percent, id_col=id_col, text_col=text_col, **kw)
    gone = labels.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias("gone"))
    gone = materialize(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    stay = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    return stay.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
