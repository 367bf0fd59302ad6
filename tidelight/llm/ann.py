"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are rotated by one seeded orthogonal matrix for each length and reduced
to their signs, packed to bits, with one correction scalar (the inner product of the
vector with its code). The codes are written once, as an index. They give an unbiased
estimate of the inner product with a rotated query and a bound on its error. In each
partition of the index a vector is reranked on the original components only if its
upper bound reaches the k-th best score found so far for that query; partition
winners are then merged.

Queries go out in blocks of ``query_block`` vectors on average (dealt by a hash of
their distinct ids), which bounds what is broadcast; a block's broadcast is destroyed
and its result written before the next block, so neither memory nor the plan grows
with the number of queries. Each block reads the index once and shuffles ``k`` rows
for each query and partition.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id; a query's candidates are the
vectors of its own length; ties go to the smaller id; of rows that repeat an id the
least vector that can take part stands for all; vectors are scaled by powers of two,
so sizes up to the greatest double are compared exactly; fewer candidates than ``k``
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.llm.common import materialize, new_path

FOUND = "query_id long, vec_id long, score double"
INDEX = "vec_id long, dim int, bits binary, correction double, v array<double>"


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and each one's inner product with its code."""
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def estimate(bits: np.ndarray, correction: np.ndarray, queries: np.ndarray, dim: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (vectors x queries) and each vector's error bound."""
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    about = (signs @ queries.T.astype(np.float32)) / np.sqrt(dim) / correction[:, None]
    bound = eps * np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(max(1, dim - 1))
    return about, bound


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, each row by the same order of additions."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as doubles, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is from 0.5 to 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def index_vectors(vectors: DataFrame, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, dim, bits, correction, v`` of every vector that takes part, one row an id."""
    usable = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable)
    if not rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                column = part.column(1)
                lengths = np.diff(column.offsets.to_numpy())
                for dim in np.unique(lengths).tolist():
                    at = pa.array(np.flatnonzero(lengths == dim))
                    v = scaled(matrix(column.take(at), dim))
                    if dim not in turns:
                        turns[dim] = rotation(dim, seed)
                    bits, correction = encode(v / np.sqrt((v * v).sum(1))[:, None], turns[dim])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                    coded = pa.array([x.tobytes() for x in bits], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.full(len(v), dim, np.int32)), coded, pa.array(correction), flat], ["vec_id", "dim", "bits", "correction", "v"])

    return rows.mapInArrow(run, INDEX)


def search(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 5,
    eps: float = 3.0,
    query_block: int = 4096,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest other rows by cosine.

    ``is_query`` says from the id which rows are queries. Ids are distinct in the
    index, so a block holds about ``query_block`` queries whatever the data.
    """
    spark = vectors.sparkSession
    index = materialize(index_vectors(vectors, seed, id_col, vector_col), "codes")
    asked = index.filter(is_query(F.col("vec_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    paths = []
    for dim, n in sorted(tuple(r) for r in asked.groupBy("dim").count().collect()):
        blocks = -(-n // query_block)
        for b in range(blocks):
            table = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v").toArrow().sort_by("vec_id")
            if not table.num_rows:
                continue
            held = spark.sparkContext.broadcast((table.column("vec_id").to_numpy(), matrix(table.column("v"), dim), rotation(dim, seed)))
            found = index.filter(F.col("dim") == dim).select("vec_id", "bits", "correction", "v").mapInArrow(_scan(held, k, eps), FOUND)
            ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
            paths.append(new_path(spark, "nearest"))
            ranked.select("query_id", "rank", "vec_id", "score").write.parquet(paths[-1])
            held.destroy()
    return spark.read.schema(NEAREST).parquet(*paths) if paths else spark.createDataFrame([], NEAREST)


NEAREST = "query_id long, rank int, vec_id long, score double"


#: Vectors and queries that are compared at once, and pairs that are reranked at once; they bound a worker's memory.
ROWS, COLUMNS, PAIRS = 2048, 256, 32768


def _scan(held, k: int, eps: float):
    def run(batches):
        q_ids, q, turn = held.value
        dim = q.shape[1]
        turned = (q / np.sqrt((q * q).sum(1))[:, None]) @ turn
        best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        floor = np.full(len(q_ids), -np.inf)  # no vector under it can still be among the k nearest
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, v, at = _distinct(part.column("vec_id").to_numpy(), matrix(part.column("v"), dim), k)
                bits = np.frombuffer(b"".join(part.column("bits").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                correction = part.column("correction").to_numpy()[at]
                for lo in range(0, len(q_ids), COLUMNS):
                    own = slice(lo, lo + COLUMNS)
                    about, bound = estimate(bits, correction, turned[own], dim, eps)
                    kth = min(k + 1, len(v))  # the query itself may be among the rows
                    if len(v) > k:
                        floor[own] = np.maximum(floor[own], np.partition(about - bound[:, None], len(v) - kth, axis=0)[len(v) - kth])
                    cols, rows = np.nonzero((about + bound[:, None] >= floor[own][None, :]).T)
                    other = ids[rows] != q_ids[lo + cols]
                    cols, rows = cols[other], rows[other]
                    for c in range(0, len(cols), PAIRS):
                        some, them = lo + cols[c : c + PAIRS], rows[c : c + PAIRS]
                        _merge(best, floor, some, ids[them], cosine(v[them], q[some]), k)
        out = [(int(q_ids[i]), vec, -s) for i, top in enumerate(best) for s, vec in top]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"]
        )

    return run


def _distinct(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without those of equal vectors that can't be among the k nearest of any query: all but the k + 1 smallest ids."""
    order = np.lexsort((ids, *v.T[::-1]))
    ids, v = ids[order], v[order]
    same = np.r_[False, (v[1:] == v[:-1]).all(1)]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))
    keep = np.arange(len(v)) - first <= k
    return ids[keep], v[keep], order[keep]


def _merge(best: list, floor: np.ndarray, at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> None:
    """Put scored pairs into the queries' best; ``at`` is ascending."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.array([], int)
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=False):
        i, top = int(at[s]), []
        for x in zip((-score[s:e]).tolist(), ids[s:e].tolist(), strict=True):
            if not top or top[-1] != x:
                top.append(x)
                if len(top) == k:
                    break
        best[i] = sorted({*best[i], *top})[:k]
        if len(best[i]) == k:
            floor[i] = max(floor[i], -best[i][-1][0])
