"""Packing of tokenised documents into fixed-length training sequences.

Each document's ids (its tokens and one end id) are cut into pieces of at most
``capacity`` ids. Documents are dealt by a hash of their row into randomised groups
of about ``group_pieces`` pieces; each group is packed on its own by first-fit
decreasing, where a tournament tree over bin capacities finds the leftmost bin with
room in logarithmic time. Only piece descriptions are shuffled, never texts or ids.
Each row is dealt for itself, whatever its id or text, so copies of one row spread
over all groups and no group is hot.

Defined results: a null text counts as empty; an empty document is the end id
alone, and so still takes one piece; the strings of the vocabulary's added tokens
become their ids, as ``tokenizers`` does by default; a very long text is many pieces
of its group, most of them full sequences of their own; repeated rows are packed
once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.llm.bpe import _texts, read_json_ranks
from tidelight.llm.common import materialize, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Sequence ids of a group start at its number times this.
GROUP_STRIDE = 1 << 32


@functools.lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str):
    """The vocabulary of a byte-level ``tokenizer.json``, with its added tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    ranks = {piece: rank for piece, rank in read_json_ranks(path).items() if rank not in added.values()}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


class TournamentTree:
    """Room left in each bin; a node holds the most of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the leftmost bin with room: the bin, and the offset there."""
        most, node = self.most, 1
        if most[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        offset = self.capacity - most[node]
        bin_, most[node] = node - self.leaves, most[node] - size
        while node > 1:
            node //= 2
            m = max(most[2 * node], most[2 * node + 1])
            if most[node] == m:
                break
            most[node] = m
        return bin_, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, largest first; equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = TournamentTree(len(sizes) - full, capacity)
    for i in order[full:].tolist():
        b, offsets[i] = tree.place(int(sizes[i]))
        bins[i] = full + b
    return bins, offsets


def cut_documents(
    docs: DataFrame, path: str, pattern: str, end_id: int = 1, capacity: int = 2048, with_ids: bool = False, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document: where each starts, its length and the CRC of its ids; ``with_ids`` adds ``ids`` (binary).

    ``deal`` is a random number of the document's row, the same on all its pieces.
    """

    def run(batches):
        enc = tokenizer(path, pattern)
        end = np.array([end_id], "<u4")
        for batch in batches:
            deals = batch.column(2).to_pylist()
            for doc_ids, texts in _texts([batch]):
                rows: tuple[list, ...] = ([], [], [], [], [], [], [])
                for doc_id, text in zip(doc_ids.to_pylist(), texts, strict=True):
                    deal = deals.pop(0)
                    ids = np.concatenate([np.asarray(enc.encode(text.as_py(), allowed_special="all"), "<u4"), end])
                    for s in range(0, len(ids), capacity):
                        piece = ids[s : s + capacity].tobytes()
                        for column, value in zip(rows, (doc_id, s, len(piece) // 4, zlib.crc32(piece), len(ids), deal, piece if with_ids else None), strict=True):
                            column.append(value)
                arrays = [pa.array(c, pa.int64()) for c in rows[:6]] + [pa.array(rows[6], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids"][: 6 + with_ids])

    dealt = text_or_empty(docs, id_col, text_col).withColumn("deal", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    return dealt.mapInArrow(run, PIECES + ", deal long" + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """Place each piece: adds ``sequence_id``, unique over all groups, and ``offset``, and drops ``deal``.

    The pieces are counted to set the number of groups, and their deals must not
    change, so they should be a written table; see :func:`pack_documents`.
    """
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in ("deal", "doc_id", "start", "length")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        table = table.drop_columns(["_group", "deal"])
        table = table.append_column("sequence_id", pa.array(bins + key[0].as_py() * GROUP_STRIDE))
        return table.append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("_group", F.pmod(F.col("deal"), F.lit(groups)).cast("long"))
    extra = ", ids binary" * ("ids" in pieces.columns)
    return dealt.groupBy("_group").applyInArrow(run, PIECES + extra + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    end_id: int = 1,
    capacity: int = 2048,
    group_pieces: int = 8192,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut and pack all documents; one row for each piece."""
    pieces = materialize(cut_documents(docs, path, pattern, end_id, capacity, with_ids, id_col=id_col, text_col=text_col), "pieces")
    return pack_pieces(pieces, capacity, group_pieces)


def sequences(placed: DataFrame) -> DataFrame:
    """Token arrays of the sequences from pieces packed ``with_ids``: ``sequence_id``, ``ids`` (binary), ``n_ids``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_ids"))
