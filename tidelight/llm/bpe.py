"""Byte-level BPE encoding and decoding without a merge loop.

``BacktrackEncoder`` walks forward over the longest tokens that start where the
last one ended; pyahocorasick finds them in a trie of the vocabulary's bytes,
mapped to Latin-1. A token may follow another
only if the merge procedure would leave exactly these two side by side; that
adjacency test is memoised. Where no token fits, the walk steps back and takes a
shorter prefix token; each position is given up once, so work is linear.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; repeated rows give repeated results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelight.llm.common import text_or_empty

#: Entries of a worker's memo before it is emptied; bounds a worker's memory.
MEMO_ENTRIES = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_json_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE ``tokenizer.json``, whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        byte_of[chr(256 + n)] = b
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


class BacktrackEncoder:
    """Encodes pieces of bytes to the ids that byte-pair merges by rank would give."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        reachable = {}
        for t, i in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(t) == 1:
                self.parts[i] = (i, i)
            else:
                ends = self._merge(t, i)
                if len(ends) != 2:
                    continue  # no merge ends in this token; only a whole piece can be it
                self.parts[i] = ends
                self.joined[ends] = i
            reachable[t] = i
        self.shorter: dict[int, int] = {}
        trie = ahocorasick.Automaton()
        self.begins: dict[str, int] = {}
        for t, i in reachable.items():
            trie.add_word(key := t.decode("latin-1"), i)
            self.begins[key] = i
            for n in range(len(t) - 1, 0, -1):
                if (p := reachable.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.longest_prefix = trie.longest_prefix
        self.reach = max(map(len, reachable), default=1)
        self.size = {i: len(t) for t, i in reachable.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    def _merge(self, piece: bytes, below: int) -> tuple[int, ...]:
        """Plain merges of ``piece`` by ranks under ``below``; used to split the vocabulary itself."""
        ids = [self.ranks[piece[k : k + 1]] for k in range(len(piece))]
        while len(ids) > 2:
            best = min((self.joined.get(p, below), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] >= below:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return tuple(ids)

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merges leave ``left`` next to ``right`` when both stand alone.

        The two are unmerged step by step, latest merge first; if a pair that
        meets at the border was mergeable before the step that used it up, the
        merges would have crossed the border.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, until, ok = left, right, 1 << 62, True
        while True:
            if self.joined.get((a, b), until) < until:
                ok = False
                break
            inner_a, inner_b = self.parts[a][1], self.parts[b][0]
            if a == inner_a and b == inner_b:
                break
            # A tie in rank merges from the left, so the left token's step counts as earlier.
            if b == inner_b or (a != inner_a and a > b):
                until, a = a, inner_a
            else:
                until, b = b + 1, inner_b
        if len(self.fits) >= 2 * MEMO_ENTRIES:
            self.fits.clear()
        self.fits[(left, right)] = ok
        return ok

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        text = piece.decode("latin-1")
        begins, prefix, reach = self.begins, self.longest_prefix, self.reach
        fits, size, shorter, adjacent = self.fits, self.size, self.shorter, self.adjacent

        def longest(at: int) -> int:
            ahead = text[at : at + reach]
            k = prefix(ahead)
            while (i := begins.get(ahead[:k])) is None:
                k -= 1
            return i

        out: list[int] = []
        ends = [0]
        dead: set[int] = set()
        at, last, i = 0, -1, longest(0)
        while True:
            end = at + size[i]
            if end not in dead and (last < 0 or (adjacent(last, i) if (ok := fits.get((last, i))) is None else ok)):
                out.append(i)
                if end == n:
                    return out
                ends.append(end)
                at, last = end, i
                i = longest(at)
                continue
            nxt = shorter.get(i)
            while nxt is None:  # nothing fits here: give the position up and shorten what leads to it
                dead.add(at)
                i = out.pop()
                ends.pop()
                at = ends[-1]
                nxt = shorter.get(i)
            i, last = nxt, out[-1] if out else -1


class PieceBytes(dict):
    """Ids of a piece of text as little-endian unsigned 32-bit integers, remembered."""

    def __init__(self, encoder: BacktrackEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode(piece.encode()), "<u4").tobytes()
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec for one rank file."""
    return Codec(read_ranks(path), pattern)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.encoder = BacktrackEncoder(ranks)
        self.pieces = PieceBytes(self.encoder)
        self.find = regex.compile(pattern).findall
        self.token = np.empty(max(ranks.values(), default=-1) + 1, object)
        for t, i in ranks.items():
            self.token[i] = t

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.token[np.frombuffer(ids, "<u4")].tolist())


ENCODED = "doc_id long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """Slices of a few MB, so that results of very long texts don't pile up."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            yield part.column(0), part.column(1)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches):
        c = codec(path, pattern)
        for ids, texts in _texts(batches):
            out = [c.encode(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["doc_id", "ids"])

    return text_or_empty(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes`` of ids made by :func:`encode_documents`; null ids decode to nothing."""

    def run(batches):
        c = codec(path, pattern)
        for ids, coded in _texts(batches):
            out = [c.decode(x.as_py() or b"") for x in coded]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def roundtrip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass, keeping only counts and digests."""

    def run(batches):
        c = codec(path, pattern)
        sha = hashlib.sha256
        for doc_ids, texts in _texts(batches):
            counts, coded, plain = [], [], []
            for t in texts:
                ids = c.encode(t.as_py())
                counts.append(len(ids) // 4)
                coded.append(sha(ids).hexdigest())
                plain.append(sha(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(counts, pa.int64()), pa.array(coded), pa.array(plain)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return text_or_empty(docs, id_col, text_col).mapInArrow(run, DIGESTS)
