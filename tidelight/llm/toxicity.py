"""Toxicity scores from a factorization machine over hashed terms.

Terms are words, word beginnings (4 and 6 characters), and marks of how often and
how densely a beginning recurs, hashed to ``2**20``. The machine gives each term
a weight and a factor vector; products of factors score pairs of terms, so terms
that are harmless alone (an insult, a mention of a group) can count together.

Fitting uses at most ``sample`` labelled documents, the first by a hash of their
id, and keeps the ``terms`` terms that divide the labels best; both are bounds on
what reaches the driver. Scoring reads every whole text in one pass with no
shuffle; only the model, of fixed size, is broadcast.

Defined results: a null text counts as empty; an empty text scores as the prior;
labels that are null or not 0 or 1 are ignored, an id with several labels is
toxic if any is; without both labels in the sample every score is the share of
toxic rows, or 0.5 without rows; repeated rows get repeated scores; a null id is
scored and not held out; other columns are ignored by :func:`score` and carried
by :func:`drop_toxic`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight.llm.common import small_batches, text_or_empty
from tidelight.llm.words import U, mix

SPACE = 1 << 20
#: Entries of a worker's memo of term hashes before it is emptied.
MEMO_ENTRIES = 1 << 17
#: Punctuation parts words; bytes of other scripts and letters stay.
PARTS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
BEGINNINGS = (4, 6)


class TermHashes(dict):
    """Hashes of a word and of its beginnings (0 where the word is no longer than that), remembered."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        s = word.decode("utf-8", "replace").lower()
        one = xxhash.xxh3_64_intdigest
        out = (one("w" + s), *(one("p" + s[:n]) if len(s) > n else 0 for n in BEGINNINGS))
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


#: A worker's memo, shared by its tasks.
TERMS = TermHashes()


def terms(text: str, hashes: TermHashes) -> np.ndarray:
    """Distinct hashed terms of a text."""
    words = Counter(text.encode().translate(PARTS).split())
    if not words:
        return np.empty(0, np.int64)
    h = np.array([hashes[w] for w in words], U)
    count = np.fromiter(words.values(), np.int64, len(words))
    starts, where = np.unique(h[:, 1:].ravel(), return_inverse=True)
    times = np.bincount(where, np.repeat(count, len(BEGINNINGS)))
    times[starts == 0] = 0
    dense = times * 64 / count.sum()
    marks = [h[:, 0]]
    for tag, on in enumerate((times >= 1, times >= 2, times >= 3, (times >= 2) & (dense >= 1), (times >= 2) & (dense >= 0.25))):
        marks.append(starts[on] + U(tag * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return np.unique(mix(np.concatenate(marks)) % U(SPACE)).astype(np.int64)


@dataclass
class FactorizationMachine:
    """``bias + sum w + sum over pairs <v_i, v_j>`` over the present terms, as log-odds."""

    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.empty(0))
    v: np.ndarray = field(default_factory=lambda: np.empty((0, 1)))

    def rows(self, found: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        return at[self.ids[at] == found]

    def log_odds(self, rows: np.ndarray) -> float:
        v = self.v[rows]
        s = v.sum(0)
        return float(self.bias + self.w[rows].sum() + 0.5 * (s @ s - (v * v).sum()))

    def probability(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(self.rows(found)), -30, 30))))


def g_statistic(with_: np.ndarray, without: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """Likelihood-ratio statistic of presence against label, for each term."""
    total, out = positive + negative, 0
    present = with_ + without
    for seen, row, column in ((with_, present, positive), (without, present, negative), (positive - with_, total - present, positive), (negative - without, total - present, negative)):
        expected = row * (column / total)
        out = out + 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)
    return out


def fit(
    examples: list[np.ndarray], labels: np.ndarray, n_terms: int = 8192, least_gain: float = 11.0, factors: int = 8, epochs: int = 8, least_docs: int = 3, seed: int = 42
) -> FactorizationMachine:
    """AdaGrad on the logistic loss over the terms whose presence divides the labels best.

    Terms whose likelihood-ratio statistic is under ``least_gain`` could divide
    the sample by chance and are left out.
    """
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    if n and labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    if not n or labels.min() == labels.max():
        return FactorizationMachine(bias=bias)
    with_, without = (np.bincount(np.concatenate([x for x, y in zip(examples, labels, strict=True) if y == k] or [np.empty(0, np.int64)]), minlength=SPACE) for k in (1, 0))
    gain = np.where(with_ + without >= least_docs, g_statistic(with_, without, labels.sum(), n - labels.sum()), 0)
    ids = np.argsort(-gain, kind="stable")[:n_terms]
    ids = np.sort(ids[gain[ids] >= least_gain])
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(ids, bias, np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), factors)))
    rows = [m.rows(x) for x in examples]
    gw, gv, gb, decay = np.full(len(ids), 1e-8), np.full((len(ids), factors), 1e-8), 1e-8, 1e-3
    for _ in range(epochs):
        for i in rng.permutation(n).tolist():
            r = rows[i]
            v = m.v[r]
            s = v.sum(0)
            z = m.bias + m.w[r].sum() + 0.5 * (s @ s - (v * v).sum())
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            dw = e + decay * m.w[r]
            gw[r] += dw * dw
            m.w[r] -= 0.1 * dw / np.sqrt(gw[r])
            dv = e * (s - v) + decay * v
            gv[r] += dv * dv
            m.v[r] = v - 0.03 * dv / np.sqrt(gv[r])
            gb += e * e
            m.bias -= 0.1 * e / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = 12_000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", **kw) -> FactorizationMachine:
    """Fit on at most ``sample`` rows of ``labels`` that are ``allowed`` (a condition on ``doc_id``)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            found = [terms(t.as_py(), TERMS).astype(np.int32) for t in batch.column(1)]
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "y", "terms"])

    chosen = text_or_empty(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    table = chosen.mapInArrow(run, "doc_id long, y int, terms array<int>").toArrow().sort_by("doc_id")
    examples = [np.array(x.values.to_numpy(zero_copy_only=False), np.int64) for x in table.column("terms")]
    return fit(examples, table.column("y").to_numpy().astype(float), **kw)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.probability(terms(t.as_py(), TERMS)) for t in part.column(1)], pa.float64())], ["doc_id", "score"])

    return text_or_empty(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(id_: Column) -> Column:
    """Rows that labels are never learnt from: a quarter, by the CRC of the id as text."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def label_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kw) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, by a model trained on rows that aren't held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), **kw)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held_out(F.col("doc_id")), text_col=text_col, **kw))
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for batch in batches:
            ok = [m.probability(terms(t.as_py() or "", TERMS)) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
