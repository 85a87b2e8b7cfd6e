"""Nearest neighbours by a block matrix join (operator 1).

Queries and candidates are cut into bands by a hash of their ids; a tile is one band of each.  A tile multiplies
int8 codes of its vectors, bounds the distance of every pair from both sides with the exact length of what quantising
left out, and keeps a heap for each query.  Only pairs whose lower bound does not exceed the query's tenth-best upper
bound are computed again in double precision.  Tiles return their heaps, which are merged over all tiles of a query.
The result is exact: a bound can only let too many pairs through.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = 1024  # dimensions whose int8 products add up exactly in float32
HELD = 24  # bytes that a task holds for each component


class Coded:
    """Vectors of one length with int8 codes, as float32 for the matrix product, and what quantising left out."""

    def __init__(self, x: np.ndarray):
        self.x = x  # double
        self.norm = np.einsum("ij,ij->i", x, x)
        scale = np.abs(x).max(axis=1) / 127.0
        self.scale = np.where(scale > 0, scale, 1.0)
        codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        back = codes * self.scale[:, None]
        self.left = np.sqrt(np.einsum("ij,ij->i", x - back, x - back))
        self.length = np.sqrt(np.einsum("ij,ij->i", back, back))
        self.codes = codes.astype(np.float32)

    def bounds(self, other: Coded, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances in a tile."""
        product = np.zeros((rows.stop - rows.start, cols.stop - cols.start))
        for d in range(0, self.codes.shape[1], EXACT):
            product += self.codes[rows, d : d + EXACT] @ other.codes[cols, d : d + EXACT].T
        product *= self.scale[rows, None] * other.scale[None, cols]
        error = self.left[rows, None] * (other.length + other.left)[None, cols] + self.length[rows, None] * other.left[None, cols]
        error = error * (1 + 1e-9) + 1e-12 * (self.norm[rows, None] + other.norm[None, cols])
        middle = self.norm[rows, None] + other.norm[None, cols] - 2 * product
        # where squares leave the range of doubles nothing is known
        return np.nan_to_num(middle - 2 * error, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(middle + 2 * error, nan=np.inf, posinf=np.inf, neginf=np.inf)


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances, dimension after dimension in double precision, so that any engine gets the same."""
    total = np.zeros(len(c))
    for d in range(len(q)):
        diff = c[:, d] - q[d]
        total += diff * diff
    return np.sqrt(total)


def tile(q_ids, q, c_ids, c, k: int, width: int = 2048, height: int = 512):
    """The k nearest distinct candidates of each query within a tile."""
    with np.errstate(over="ignore", invalid="ignore"):
        return search(q_ids, Coded(q), c_ids, Coded(c), k, width, height)


def search(q_ids, queries: Coded, c_ids, cands: Coded, k: int, width: int, height: int):
    q, c = queries.x, cands.x
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]  # heaps with the worst in front, as negatives
    limit = np.full(len(q_ids), np.inf)
    for a in range(0, len(c_ids), width):
        cols = slice(a, min(len(c_ids), a + width))
        for b in range(0, len(q_ids), height):
            rows = slice(b, min(len(q_ids), b + height))
            low, high = queries.bounds(cands, rows, cols)
            own = q_ids[rows, None] == c_ids[None, cols]
            low[own], high[own] = np.inf, np.inf
            if high.shape[1] > k:
                # candidates are distinct by now, so k of them lie within the k-th smallest upper bound
                limit[rows] = np.minimum(limit[rows], np.partition(high, k - 1, axis=1)[:, k - 1])
            for i, js in survivors((low <= limit[rows, None] * (1 + 1e-9) + 1e-12) & ~own):
                heap, js = best[b + i], js + a
                ds = distances(q[b + i], c[js])
                for d, j in sorted(zip(ds.tolist(), c_ids[js].tolist(), strict=True))[:k]:
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -j))
                    elif (-d, -j) > heap[0]:
                        heapq.heapreplace(heap, (-d, -j))
                if len(heap) == k:
                    limit[b + i] = min(limit[b + i], heap[0][0] ** 2)
    return best


def survivors(keep: np.ndarray):
    rows, cols = np.nonzero(keep)
    edge = np.searchsorted(rows, np.arange(keep.shape[0] + 1))
    for i in range(keep.shape[0]):
        if edge[i] < edge[i + 1]:
            yield i, cols[edge[i] : edge[i + 1]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", band_bytes: int = 64 << 20) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries`` by Euclidean distance.

    Returns query_id, rank (from 1), vec_id and score: nearest first, ties to the smaller vec_id, all candidates if
    they are fewer.  A tile holds ``band_bytes`` of either side at most, so each side travels once for so much of the
    other, and not more often.  Rows with the query's own id are no candidates.  Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do null ids.  Distances are taken between vectors of one length only.  Of several
    vectors with one id, a query uses the smallest and a result the nearest.  Distances beyond the range of doubles are
    infinite and tie.  Other columns are not read.  Empty
    tables: no rows.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(x, lambda v: v != 0)
    cand = vectors.where(usable).select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))
    ask = queries.where(usable).select(F.col(id_col).cast("bigint").alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    n_cand, length = cand.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    n_ask = ask.count()
    most = max(1, band_bytes // (HELD * length))  # rows of a band
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide, high = max(-(-n_cand // most), min(tasks, n_cand // 512), 1), max(1, -(-n_ask // most))

    def band(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = ask.withColumn("r", band(high)).withColumn("c", each(wide))
    right = cand.withColumn("c", band(wide)).withColumn("r", each(high))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(q) and len(c):
            sets = [by_length(t) for t in (q, c)]
            for n in sorted(sets[0].keys() & sets[1].keys()):
                (q_ids, qx), (c_ids, cx) = sets[0][n], sets[1][n]
                for layer in layers(c_ids):
                    for i, heap in zip(q_ids.tolist(), tile(q_ids, qx, c_ids[layer], cx[layer], k), strict=True):
                        out += [(i, -j, -d) for d, j in heap]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    heaps = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    once = heaps.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    ids, lists = t.column("id").to_numpy(), t.column("x").combine_chunks()
    n = lists.value_lengths().to_numpy()
    flat, start = lists.flatten().to_numpy(), np.append(0, np.cumsum(n)[:-1])
    out = {}
    for size in np.unique(n).tolist():
        own = np.nonzero(n == size)[0]
        out[size] = ids[own], flat[start[own, None] + np.arange(size)]
    return out


def layers(ids: np.ndarray):
    """Places split so that no id comes twice in a layer; one layer where ids are unique."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.nonzero(np.append(True, s[1:] != s[:-1]))[0]
    turn = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    for t in range(int(turn.max()) + 1):
        yield order[turn == t]
