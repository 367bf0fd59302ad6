"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``size`` consecutive words; a word goes if a window that covers it
starts earlier elsewhere. Indexing every window would cost more than the texts,
so the index holds the window fingerprints that winnowing picks: the least hash
among a window's ``gram``-word grams. Equal windows pick equal grams, so every
repeated window has a fingerprint that occurs twice, and none is lost.

``FingerprintIndex`` keeps sorted immutable runs, bucketed by fingerprint. Each
batch is reduced to one sorted run of distinct fingerprints, merge-joined with
the earlier runs bucket by bucket (no shuffle), and runs are compacted by merging
when ``fan_in`` of them have gathered; merged runs are deleted. Windows whose
fingerprint was hit are then verified: their whole word sequences are compared by a
collision-resistant digest (BLAKE2b, 128 bits), and the earliest of each stays.

An index that is carried from call to call also remembers the documents it has seen,
and where their fingerprints stand. Fingerprints of a later batch that hit the runs
lead to those documents, whose windows are verified with the batch's own: what the
history holds counts as earlier than anything in the batch, whatever the ids.

Documents whose whole text equals an earlier one's need no windows: all of
theirs start earlier.

Defined results: null text has no words; documents under ``size`` words lose
nothing; very long texts are cut whole; rows with a null id are returned unchanged;
rows that repeat an id and text are the same document, lose the same words and don't
repeat each other; rows that repeat an id with other texts are documents of their
own, in the order of their texts' digests; an empty table gives no rows; other
columns are ignored by :func:`mark_repeats` and carried by :func:`cut_repeats`.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.llm.common import delete_path, drop_table, materialize, new_path, one_text_an_id, release_shuffles, small_batches, text_or_empty
from tidelight.llm.words import HASHES, U, ngrams

SKETCH = "doc_id long, n_words long, text_digest binary, fps array<long>, starts array<int>"
REPEATS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each run of ``width`` values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def grams_and_minima(words: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams, and the least of each window's grams; ``words``: hashes of at least ``size`` words."""
    g = ngrams(words, gram)
    return g, _slide(g, size - gram + 1, np.minimum)


def picked_in_all(words: np.ndarray, begin: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the least of some window, ties included.

    The texts' words stand one after another, text ``k`` from ``begin[k]``;
    windows that would cross from one text into the next pick nothing.
    """
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, U)
    g, least = grams_and_minima(words, size, gram)
    left = np.repeat(begin[1:], np.diff(begin))[: len(least)] - np.arange(len(least))
    least[left < size] = 0
    width = len(g) - len(least)
    top = _slide(np.concatenate([np.zeros(width, U), least, np.zeros(width, U)]), width + 1, np.maximum)
    at = np.flatnonzero((top == g) & (top > 0))
    return at, g[at]


def windows_hit(g: np.ndarray, least: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Starts of the windows whose fingerprint stands at one of the gram positions ``hits``."""
    top = np.full(len(g), np.iinfo(U).max, U)
    top[hits] = g[hits]
    return np.flatnonzero((_slide(top, len(g) - len(least) + 1, np.minimum) == least))


def sketch(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """For each document: words, digest of the text, and its picked fingerprints with their positions. ``docs``: ``doc_id, text``."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                words = [t.split() for t in texts]
                counts = np.array([len(w) for w in words], np.int64)
                begin = np.r_[0, np.cumsum(counts)]
                at, fps = picked_in_all(HASHES.of([w for more in words for w in more]), begin, size, gram)
                owner = np.searchsorted(begin, at, side="right") - 1
                offsets = pa.array(np.searchsorted(at, begin).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts),
                        pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(fps.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((at - begin[owner]).astype(np.int32))),
                    ],
                    ["doc_id", "n_words", "text_digest", "fps", "starts"],
                )

    return docs.mapInArrow(run, SKETCH)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints (``fp``, and ``n``: in how many places).

    With ``carry``, documents are remembered for later calls: a batch's texts are
    read again when a later batch hits them, so they should be a written table.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = 2, carry: bool = True):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fan_in = fan_in
        self.carry = carry
        self.runs: list[tuple[int, DataFrame]] = []
        #: Of earlier calls: ``doc_id, text`` and ``doc_id, text_digest, fps, starts``.
        self.seen: list[tuple[DataFrame, DataFrame]] = []
        self._stored: dict[int, tuple[str, str]] = {}

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"fingerprints_{uuid.uuid4().hex}"
        path = new_path(self.spark, name)
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        self._stored[id(run)] = name, path
        return run

    def _delete(self, run: DataFrame) -> None:
        name, path = self._stored.pop(id(run))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, path)

    def close(self) -> None:
        """Delete all runs and what is remembered of documents, but not their texts."""
        for _, run in self.runs:
            self._delete(run)
        for _, own in self.seen:
            drop_table(own)
        self.runs, self.seen = [], []

    def add(self, sketches: DataFrame) -> DataFrame:
        """Append a batch as a run; the fingerprints of the batch that now stand in two places or more."""
        places = sketches.select(F.explode("fps").alias("fp"))
        run = self._write(places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
        hits = [run.filter("n > 1").select("fp")]
        hits += [run.select("fp").join(old.select("fp"), "fp", "left_semi") for _, old in self.runs]
        found = hits[0]
        for more in hits[1:]:
            found = found.unionByName(more)
        found = materialize(found, "hits")
        self.runs.append((0, run))
        self._compact()
        return found

    def _compact(self) -> None:
        while len(self.runs) >= self.fan_in and len({level for level, _ in self.runs[-self.fan_in :]}) == 1:
            level, merged = self.runs[-1]
            for _, old in self.runs[-self.fan_in : -1]:
                both = F.coalesce(merged["n"], F.lit(0)) + F.coalesce(old["n"], F.lit(0))
                merged = merged.join(old, "fp", "full_outer").select("fp", both.alias("n"))
            merged = self._write(merged)
            for _, old in self.runs[-self.fan_in :]:
                self._delete(old)
            self.runs[-self.fan_in :] = [(level + 1, merged)]


def _batches(sketches: DataFrame, n: int) -> list[DataFrame]:
    """The sketches by ascending ranges of ``doc_id``, about as many in each."""
    if n <= 1:
        return [sketches]
    cuts = sorted(set(sketches.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.01)))
    edges = [None, *map(int, cuts), None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = sketches
        part = part if lo is None else part.filter(F.col("doc_id") >= lo)
        out.append(part if hi is None else part.filter(F.col("doc_id") < hi))
    return out


def find_repeats(
    docs: DataFrame, size: int = 20, gram: int = 6, batches: int = 3, index: FingerprintIndex | None = None, repeated: bool = True
) -> tuple[DataFrame, DataFrame]:
    """What to cut from ``docs`` (``doc_id, text``, ids that stand for one text each and aren't null), which enters the index in ``batches``.

    Other columns of ``docs`` aren't used, but stay beside the text so that the
    caller's own join of ``docs`` by ``doc_id`` can share one shuffle of it. Rows
    must not be ``repeated`` where that is False.

    Gives ``doc_id, copy, hits`` (gram positions) for the documents that may
    lose words, and ``doc_id, firsts``: the starts of windows that stay.
    """
    spark = docs.sparkSession
    own_index = index is None
    index = index or FingerprintIndex(spark, carry=False)
    sketches = materialize(sketch(docs.select("doc_id", "text"), size, gram), "sketches")
    long = sketches.filter(F.col("n_words") >= size)
    long = long.dropDuplicates(["doc_id"]) if repeated else long
    first = long.groupBy("text_digest").agg(F.min("doc_id").alias("first"))
    copy = F.col("doc_id") != F.col("first")
    for _, old in index.seen:
        known = old.select("text_digest", F.lit(True).alias("known"))
        first = first.join(known, "text_digest", "left").withColumn("first", F.when(F.col("known"), F.lit(None)).otherwise(F.col("first"))).drop("known")
        copy = ~F.col("doc_id").eqNullSafe(F.col("first"))
    copies = materialize(long.select("doc_id", "text_digest").join(first, "text_digest").filter(copy).select("doc_id"), "copies")
    own = materialize(long.join(copies, "doc_id", "left_anti").select("doc_id", "text_digest", "fps", "starts"), "own")
    drop_table(sketches)
    hit = None
    for batch in _batches(own, batches):
        found = index.add(batch)
        hit = found if hit is None else hit.unionByName(found)
    hit = materialize(hit.distinct(), "hit")
    release_shuffles(spark)

    def places(sketched: DataFrame) -> DataFrame:
        each = sketched.select("doc_id", F.explode(F.arrays_zip("fps", "starts")).alias("p")).select("doc_id", F.col("p.fps").alias("fp"), F.col("p.starts").alias("at"))
        return each.join(hit, "fp", "left_semi").groupBy("doc_id").agg(F.collect_list("at").alias("hits"))

    todo = materialize(
        places(own).select("doc_id", F.lit(False).alias("copy"), "hits").unionByName(copies.select("doc_id", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("hits"))),
        "todo",
    )
    earlier = [materialize(texts.join(places(old), "doc_id").select("doc_id", "text", "hits"), "earlier") for texts, old in index.seen]
    drop_table(hit)
    if index.carry:
        index.seen.append((docs.select("doc_id", "text"), own))
    else:
        drop_table(own)
    if own_index:
        index.close()
    release_shuffles(spark)

    blake = hashlib.blake2b

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                digests, owners, places = [], [], []
                hits = part.column("hits")
                for k, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = text.split()
                    g, least = grams_and_minima(HASHES.of(words), size, gram)
                    starts = windows_hit(g, least, hits[k].values.to_numpy())
                    flat = b" ".join(words)
                    offset = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
                    ends = (offset[starts + size] - 1).tolist()
                    # Of a sequence that the document itself repeats, the first start only.
                    first = dict(zip([blake(flat[i:j], digest_size=16).digest() for i, j in zip(offset[starts].tolist()[::-1], ends[::-1], strict=True)], starts.tolist()[::-1], strict=True))
                    digests += first.keys()
                    places += first.values()
                    owners.append(len(first))
                d = np.frombuffer(b"".join(digests), [("d1", "<i8"), ("d2", "<i8")])
                ids = np.repeat(part.column("doc_id").to_numpy(), owners)
                yield pa.RecordBatch.from_arrays([pa.array(d["d1"].copy()), pa.array(d["d2"].copy()), pa.array(ids), pa.array(places, pa.int32())], ["d1", "d2", "doc_id", "start"])

    found = "d1 long, d2 long, doc_id long, start int"
    may = docs.join(todo.filter("not copy").select("doc_id", "hits"), "doc_id").select(*docs.columns, "hits")
    windows = may.mapInArrow(run, found)
    if earlier:
        windows = windows.withColumn("new", F.lit(1))
        for old in earlier:
            windows = windows.unionByName(old.mapInArrow(run, found).withColumn("new", F.lit(0)))
        firsts = windows.groupBy("d1", "d2").agg(F.min("new").alias("new"), F.min("doc_id").alias("first_doc"), F.min_by("start", "doc_id").alias("start")).filter("new = 1")
    else:
        firsts = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.min_by("start", "doc_id").alias("start"))
    return todo, firsts.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list("start").alias("firsts"))


def _removed(words: list[bytes], hits: np.ndarray, firsts: np.ndarray | None, size: int, gram: int) -> np.ndarray:
    """Which words go from a text that is no copy."""
    g, least = grams_and_minima(HASHES.of(words), size, gram)
    starts = windows_hit(g, least, hits)
    gone = np.zeros(len(words) + 1, np.int64)
    gone[starts] = 1
    if firsts is not None:
        gone[firsts] = 0
    covered = np.cumsum(gone)
    covered[size:] -= covered[:-size].copy()
    return covered[:-1] > 0


def _joined(docs: DataFrame, size: int, gram: int, batches: int, index: FingerprintIndex | None) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with what to cut, and what its ids stand for (see :func:`one_text_an_id`); rows with a null id have nothing to cut."""
    docs, names = one_text_an_id(docs)
    named, rest = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    todo, firsts = find_repeats(named, size, gram, batches, index, names is not None)
    joined = named.join(todo, "doc_id", "left").join(firsts, "doc_id", "left").select(*docs.columns, "copy", "hits", "firsts")
    nothing = [F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("copy", "hits", "firsts")]
    return joined.unionByName(rest.select(*docs.columns, *nothing)), names


def mark_repeats(
    docs: DataFrame, size: int = 20, gram: int = 6, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document; kept words are joined by one space.

    With an ``index`` of earlier calls, what those documents hold goes too.
    """

    def run(parts):
        for batch in parts:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, removed, kept = [], [], []
                hits, firsts = part.column(3), part.column(4)
                for k, (text, copy) in enumerate(zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    words = left = text.split()
                    if copy:
                        left = []
                    elif hits[k].is_valid:
                        gone = _removed(words, hits[k].values.to_numpy(), firsts[k].values.to_numpy() if firsts[k].is_valid else None, size, gram)
                        left = list(compress(words, (~gone).tolist()))
                    counts.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined, names = _joined(text_or_empty(docs, id_col, text_col), size, gram, batches, index)
    marked = joined.mapInArrow(run, REPEATS)
    if names is None:
        return marked
    back = marked.join(names.select(F.col("key").alias("doc_id"), "named"), "doc_id", "left")
    return back.select(F.col("named").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cut_repeats(
    docs: DataFrame, size: int = 20, gram: int = 6, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None
) -> DataFrame:
    """``docs`` with repeated words cut from the text, each with the white space after it; other columns are unchanged."""
    rest = [c for c in docs.columns if c != text_col]
    packed = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"), F.col(text_col).isNull().alias("none"))

    @F.pandas_udf("string")
    def cut(text, copy, hits, firsts):
        out = []
        for t, c, h, f in zip(text, copy, hits, firsts, strict=True):
            if c is True:
                out.append("")
                continue
            if h is None:
                out.append(t)
                continue
            raw = t.encode()
            words = raw.split()
            gone = _removed(words, np.asarray(h), None if f is None else np.asarray(f), size, gram)
            if not gone.any():
                out.append(t)
                continue
            begin, at = [], 0
            for w in words:
                at = raw.index(w, at)
                begin.append(at)
                at += len(w)
            begin.append(len(raw))
            kept = raw[: begin[0]] + b"".join(raw[begin[k] : begin[k + 1]] for k in np.flatnonzero(~gone).tolist())
            out.append(kept.decode())
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined, _ = _joined(packed, size, gram, batches, index)
    touched = F.col("copy").isNotNull()
    text = F.when(F.col("none"), F.lit(None)).when(touched, cut("text", "copy", "hits", "firsts")).otherwise(F.col("text"))
    value = {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)} | {text_col: text}
    return joined.select(*[value[c].alias(c) for c in docs.columns])
